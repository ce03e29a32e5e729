"""k-means with seeds by distance, restarts and a sweep of k. Vectors stay in their partitions; the driver holds centroids only.

All restarts, and all k of a sweep, go through the data together: a pass chooses the next seed of every restart, a pass makes a Lloyd step of every (k,
restart). A seed is drawn with a chance in proportion to its squared distance from the seeds so far, as the largest of keyed hashes (an exponential race), so the
draw needs no order of rows and repeats itself. The first k seeds of a restart are its seeds for k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64)


def _d2(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :])


def seeds(vectors: DataFrame, id_col: str, vector_col: str, k: int, restarts: int, seed: int = 42) -> np.ndarray:
    """(restarts, k, size): the seeds. With fewer different vectors than k the last ones repeat."""
    chosen: list[list[np.ndarray]] = [[] for _ in range(restarts)]
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    hashes = [(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(r)), F.lit(1 << 52)) + 1) / float((1 << 52) + 2) for r in range(restarts)]
    rows = rows.withColumn("u", F.array(*hashes))
    for step in range(k):
        known = [np.stack(c) if c else None for c in chosen]

        def best(batches: Iterator[pd.DataFrame], known=known, step=step) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                x, u = _matrix(pdf["v"]), _matrix(pdf["u"])
                u = np.modf(u + step * 0.6180339887498949)[0].clip(1e-15, 1 - 1e-15)  # another draw each step
                for r, c in enumerate(known):
                    w = np.ones(len(x)) if c is None else _d2(x, c).min(axis=1)
                    key = np.where(w > 0, np.log(u[:, r]) / np.maximum(w, 1e-300), -np.inf)
                    i = int(key.argmax())
                    yield pd.DataFrame({"r": [r], "key": [key[i]], "id": [str(pdf["id"].iloc[i])], "v": [pdf["v"].iloc[i]]})

        found = rows.mapInPandas(best, "r int, key double, id string, v array<double>").groupBy("r").agg(F.max_by("v", F.struct("key", "id")).alias("v")).collect()
        for row in found:
            chosen[row.r].append(np.array(row.v))
    return np.array(chosen)


def sweep(vectors: DataFrame, id_col: str, vector_col: str, ks: list[int], restarts: int = 3, steps: int = 10, seed: int = 42) -> dict[int, tuple[float, np.ndarray]]:
    """For each k (wcss, centroids) of its best restart, after so many Lloyd steps or when none moves.

    An empty cluster's centroid moves to the row farthest from its own; of several empty ones each takes the next farthest.
    """
    first = seeds(vectors, id_col, vector_col, max(ks), restarts, seed)
    centres = {(k, r): first[r][:k].copy() for k in ks for r in range(restarts)}
    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    wcss = dict.fromkeys(centres, np.inf)
    for step in range(steps + 1):
        now = dict(centres)

        def sums(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            total: dict = {}
            far: dict = {}
            for pdf in batches:
                if not len(pdf):
                    continue
                x = _matrix(pdf["v"])
                for key, c in now.items():
                    d = _d2(x, c)
                    own = d.argmin(axis=1)
                    n, s = np.bincount(own, minlength=len(c)), np.zeros_like(c)
                    np.add.at(s, own, x)
                    near = d[np.arange(len(x)), own]
                    last = np.argsort(-near, kind="stable")[: len(c)]
                    far[key] = sorted([*far.get(key, []), *((float(near[i]), tuple(x[i])) for i in last)], reverse=True)[: len(c)]
                    part = (n, s, np.bincount(own, d[np.arange(len(x)), own], minlength=len(c)))
                    total[key] = part if key not in total else tuple(a + b for a, b in zip(total[key], part, strict=True))
            for (k, r), (n, s, w) in total.items():
                yield pd.DataFrame({"k": k, "r": r, "c": np.arange(k), "n": n, "s": list(s), "w": w, "far": None})
                yield pd.DataFrame([(k, r, -1, 0, list(v), 0.0, d) for d, v in far[k, r]], columns=["k", "r", "c", "n", "s", "w", "far"])

        parts = rows.mapInPandas(sums, "k int, r int, c int, n long, s array<double>, w double, far double")
        moved = False
        added = parts.where("c >= 0").select("k", "r", "c", "n", "w", F.posexplode("s").alias("i", "x"))
        # as many numbers as the centroids have come to the driver; a position is summed up before and after the shuffle
        got = added.groupBy("k", "r", "c", "i").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("x").alias("x")).toPandas()
        wcss = {key: float(got[(got.k == key[0]) & (got.r == key[1]) & (got.i == 0)].w.sum()) for key in centres}
        if step == steps:
            break
        size = got[got.i == 0].groupby(["k", "r", "c"]).n.sum()
        for (k, r), c in now.items():
            own = got[(got.k == k) & (got.r == r)]
            new = c.copy()
            sums_of = np.zeros_like(c)
            sums_of[own.c, own.i] = own.x
            n = np.array([size.get((k, r, j), 0) for j in range(k)])
            new[n > 0] = sums_of[n > 0] / n[n > 0, None]
            if len(own) and (n == 0).any():
                empty = np.nonzero(n == 0)[0]
                farthest = parts.where((F.col("k") == k) & (F.col("r") == r) & F.col("far").isNotNull()).orderBy(F.desc("far"), F.desc("s")).limit(len(empty)).collect()
                for j, row in zip(empty, farthest):
                    new[j] = row.s
            moved |= bool(len(own)) and bool(np.abs(new - c).max() > 1e-12)
            centres[k, r] = new
        if not moved:
            break
    best = {k: min((wcss[k, r], r) for r in range(restarts)) for k in ks}
    return {k: (w, now[k, r]) for k, (w, r) in best.items()}


def final(vectors: DataFrame, id_col: str, vector_col: str, k: int, restarts: int = 3, steps: int = 10, seed: int = 1337) -> tuple[float, np.ndarray]:
    """(wcss, centroids) for the k that was chosen, from twice as many restarts and other seeds."""
    return sweep(vectors, id_col, vector_col, [k], 2 * restarts, steps, seed)[k]


def assigned(vectors: DataFrame, vector_col: str, centres: np.ndarray, name: str = "cluster") -> DataFrame:
    """vectors with the number of the nearest centroid; null where there is no vector."""

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        ok = v.notna()
        out = pd.Series([None] * len(v), dtype="Int32")
        if ok.any():
            out[ok.to_numpy()] = _d2(_matrix(v[ok]), centres).argmin(axis=1)
        return out

    return vectors.withColumn(name, nearest(F.col(vector_col).cast("array<double>")))


def elbow(wcss: dict[int, float]) -> int:
    """The k farthest from the line between the first and the last, both axes scaled to 0..1; the smallest of equal ones."""
    ks = sorted(wcss)
    low, high = wcss[ks[-1]], wcss[ks[0]]
    far = {k: abs((k - ks[0]) / max(1, ks[-1] - ks[0]) + (wcss[k] - low) / ((high - low) or 1.0) - 1) for k in ks}
    return min(ks, key=lambda k: (-round(far[k], 12), k))

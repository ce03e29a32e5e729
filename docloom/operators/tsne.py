"""t-SNE of a table of vectors: affinities to near neighbours only, repulsion by interpolation on a grid, everything by partial sums.

Attraction follows the edges of a neighbour list, so its work goes with rows times neighbours. For the repulsion each task spreads its rows as charges over the nodes of a grid (three
a cell and axis, Lagrange weights); the charges of all tasks add up to an array whose size depends on the map's span, not on the rows. The driver convolves it
with the kernel by FFT, and each task reads its rows' forces from the result by the same weights. No step holds N x N numbers, nor all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.pairs import Nearest, pair_map

#: Width of a cell of the grid, and the least and most cells along an axis of a map of so many dimensions.
CELL, LEAST, MOST = 0.3, 10, {1: 4000, 2: 500, 3: 40}


def neighbours(vectors: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """(i, j, d2): the k nearest others of every row, ties to the smaller id. All pairs are computed, block by block."""
    kind = dict(vectors.dtypes)[id_col]
    near = pair_map(vectors, id_col, vector_col, id_col, lambda ids, groups: Nearest(ids, groups, k, ["i", "j", "d2"], True), f"i {kind}, j {kind}, d2 double", True)
    near = near.withColumn("d2", F.abs("d2"))
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d2", "j"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def bandwidths(d2: np.ndarray, perplexity: float, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(beta, p) for rows of squared distances, inf where there is no neighbour: p goes with exp(-beta * d2) and has the perplexity, or as near as the row allows."""
    shift = d2 - d2.min(axis=1, keepdims=True)
    known = np.isfinite(d2)
    scale = np.where(known, shift, 0).sum(axis=1) / np.maximum(known.sum(axis=1), 1)
    beta, low, high = 1.0 / np.maximum(scale, 1e-12), np.zeros(len(d2)), np.full(len(d2), np.inf)
    for _ in range(steps):
        w = np.where(known, np.exp(-beta[:, None] * np.where(known, shift, 0)), 0.0)
        p = w / w.sum(axis=1, keepdims=True)
        entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)
        wide = entropy > np.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return beta, p


def affinities(near: DataFrame, perplexity: float) -> DataFrame:
    """(i, j, p, beta, perplexity): the chances with which each row picks its neighbours, and what its bandwidth comes to."""
    kind = dict(near.dtypes)["i"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            k = max(map(len, part["n"]))
            d2 = np.full((len(part), k), np.inf)
            for row, n in enumerate(part["n"]):
                d2[row, : len(n)] = [x["d2"] for x in n]
            beta, p = bandwidths(d2, perplexity)
            got = np.exp(-(p * np.log(np.maximum(p, 1e-300))).sum(axis=1))
            sizes = [len(n) for n in part["n"]]
            rows = np.repeat(np.arange(len(part)), sizes)
            yield pd.DataFrame({"i": part["i"].to_numpy()[rows], "j": [x["j"] for n in part["n"] for x in n], "p": p[np.isfinite(d2)], "beta": beta[rows], "perplexity": got[rows]})

    grouped = near.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("d2", "j"))).alias("n"))  # k neighbours a row
    return grouped.mapInPandas(run, f"i {kind}, j {kind}, p double, beta double, perplexity double")


def symmetric(p: DataFrame, n: int) -> DataFrame:
    """(i, j, p) both ways, all of them summing up to 1."""
    both = p.select("i", "j", "p").union(p.select(F.col("j").alias("i"), F.col("i").alias("j"), "p"))
    return both.groupBy("i", "j").agg((F.sum("p") / (2 * n)).alias("p"))


def principal(vectors: DataFrame, id_col: str, vector_col: str, dims: int, spread: float = 1e-4) -> DataFrame:
    """(id, y): the first principal components, the first scaled to that spread. Sums of products come to the driver, as many as the vectors have numbers, squared."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for part in parts:
            if len(part):
                x = np.column_stack([np.ones(len(part)), np.stack(part["v"].to_numpy())])
                total = total + x.T @ x
        if not np.isscalar(total):
            yield pd.DataFrame({"at": np.arange(total.size), "x": total.ravel()})

    got = rows.mapInPandas(sums, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    if not len(got):
        return rows.select("id", F.array().cast("array<double>").alias("y"))
    size = int(round(len(got) ** 0.5))
    m = np.zeros(size * size)
    m[got["at"]] = got["x"]
    m = m.reshape(size, size)
    mean = m[0, 1:] / m[0, 0]
    values, axes = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :dims]
    axes *= np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1, 1)  # a sign that doesn't depend on the solver
    axes *= spread / np.sqrt(max(values[-1], 1e-300))

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(v.to_numpy()) - mean) @ axes)) if len(v) else pd.Series([], dtype=object)

    return rows.select("id", project("v").alias("y"))


class Grid:
    """The grid over a map from low to high: charges of rows, what they come to by a kernel, and what a row reads from that."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.dims = len(low)
        span = max(float((high - low).max()), 1e-9) * 1.0001
        self.low, self.cells = low, int(np.clip(np.ceil(span / CELL), LEAST, MOST[self.dims]))
        self.width, self.side = span / self.cells, 3 * self.cells

    def _weights(self, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(nodes, weights) of rows, for each of the 3 ** dims nodes of their cells."""
        t = (y - self.low) / self.width
        cell = np.clip(np.floor(t), 0, self.cells - 1).astype(np.int64)
        u = 3 * (t - cell)  # nodes of a cell stand at 0.5, 1.5 and 2.5
        lagrange = [(u - 1.5) * (u - 2.5) / 2, -(u - 0.5) * (u - 2.5), (u - 0.5) * (u - 1.5) / 2]
        for offset in product(range(3), repeat=self.dims):
            node, weight = 0, 1.0
            for d, o in enumerate(offset):
                node, weight = node * self.side + 3 * cell[:, d] + o, weight * lagrange[o][:, d]
            yield node, weight

    def charges(self, y: np.ndarray, q: np.ndarray) -> np.ndarray:
        """(nodes, charges): q of the rows, spread over the nodes."""
        out = np.zeros((self.side**self.dims, q.shape[1]))
        for node, weight in self._weights(y):
            for c in range(q.shape[1]):
                out[:, c] += np.bincount(node, weight * q[:, c], minlength=len(out))
        return out

    def read(self, potentials: np.ndarray, y: np.ndarray) -> np.ndarray:
        return sum(weight[:, None] * potentials[node] for node, weight in self._weights(y))

    def convolved(self, charges: np.ndarray, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """What the kernel, a function of squared distance, makes of the charges at every node."""
        n, axes = self.side, tuple(range(self.dims))
        far = np.minimum(np.arange(2 * n), 2 * n - np.arange(2 * n)) * self.width / 3
        d2 = sum(far.reshape([-1 if a == b else 1 for b in axes]) ** 2 for a in axes)
        spectrum = np.fft.rfftn(kernel(d2), axes=axes)
        out = np.empty_like(charges)
        for c in range(charges.shape[1]):
            whole = np.fft.irfftn(spectrum * np.fft.rfftn(charges[:, c].reshape([n] * self.dims), s=[2 * n] * self.dims, axes=axes), s=[2 * n] * self.dims, axes=axes)
            out[:, c] = whole[tuple(slice(0, n) for _ in axes)].ravel()
        return out


def gradient(state: DataFrame, edges: DataFrame, exaggeration: float = 1.0) -> DataFrame:
    """state (id, y, ...) with ``grad``. edges: (i, j, p), both ways."""
    dims = len(state.first().y)
    ends = state.agg(*[f(F.get("y", F.lit(d))).alias(f"{n}{d}") for d in range(dims) for f, n in ((F.min, "a"), (F.max, "b"))]).first()
    grid = Grid(np.array([ends[f"a{d}"] for d in range(dims)]), np.array([ends[f"b{d}"] for d in range(dims)]))
    named = [f"c{c}" for c in range(dims + 1)]

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for part in parts:
            if len(part):
                y = np.stack(part["y"].to_numpy())
                total = total + grid.charges(y, np.column_stack([np.ones(len(y)), y]))
        if not np.isscalar(total):
            node = np.nonzero(total.any(axis=1))[0]
            yield pd.DataFrame(total[node], columns=named).assign(node=node)[["node", *named]]

    got = state.select("y").mapInPandas(spread, "node long, " + ", ".join(f"{c} double" for c in named)).groupBy("node").agg(*[F.sum(c).alias(c) for c in named]).toPandas()
    charges = np.zeros((grid.side**dims, dims + 1))
    charges[got["node"]] = got[named]
    rows = charges[:, 0].sum()
    total = float((charges[:, :1] * grid.convolved(charges[:, :1], lambda d2: 1 / (1 + d2))).sum() - rows)
    shared = state.sparkSession.sparkContext.broadcast(grid.convolved(charges, lambda d2: 1 / (1 + d2) ** 2) / max(total, 1e-300))

    @F.pandas_udf("array<double>")
    def repulsion(y: pd.Series) -> pd.Series:
        if not len(y):
            return pd.Series([], dtype=object)
        y = np.stack(y.to_numpy())
        r = grid.read(shared.value, y)
        return pd.Series(list(y * r[:, :1] - r[:, 1:]))

    there = state.select(F.col("id").alias("j"), F.col("y").alias("yj"))
    pulls = edges.join(there, "j").groupBy("i").agg(F.collect_list(F.struct("p", "yj")).alias("pulls"))  # a row's neighbours, both ways
    both = state.withColumn("__push", repulsion("y")).join(pulls.withColumnRenamed("i", "id"), "id", "left")
    d2 = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, x: s + x)
    zero = F.array(*[F.lit(0.0)] * dims)
    pull = F.aggregate(F.coalesce("pulls", F.array().cast("array<struct<p:double,yj:array<double>>>")), zero, lambda s, n: F.zip_with(s, F.zip_with("y", n["yj"], lambda a, b: (a - b) * n["p"] / (1 + d2(F.col("y"), n["yj"]))), lambda a, b: a + b))
    return both.select(*state.columns, F.zip_with(pull, "__push", lambda a, b: 4 * (exaggeration * a - b)).alias("grad"))


def layout(vectors: DataFrame, id_col: str, vector_col: str, write: Callable[[DataFrame, str], DataFrame], dims: int = 2, perplexity: float | None = None, steps: int = 500, early: int = 250, exaggeration: float = 12.0, rate: float | None = None) -> DataFrame:
    """(id, y): the map after so many steps from a start by principal components; gains and momentum as usual.

    ``write`` stores a table under a name and reads it again; it is called once a step, so that a lost executor costs one step. Perplexity: by default a twentieth
    of the rows, from 5 to 30. Vectors that are null take no part.
    """
    vectors = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull())
    n = vectors.count()
    perplexity = perplexity or min(30, max(5, n // 20))
    edges = write(symmetric(affinities(neighbours(vectors, id_col, vector_col, min(n - 1, int(3 * perplexity))), perplexity), n), "edges") if n > 1 else None
    state = principal(vectors, id_col, vector_col, dims)
    if edges is None:
        return state
    zeros, ones = F.array(*[F.lit(0.0)] * dims), F.array(*[F.lit(1.0)] * dims)
    state = write(state.select("id", "y", zeros.alias("v"), ones.alias("gain")), "map-0")
    rate = rate or max(n / exaggeration / 4, 50.0)
    for step in range(1, steps + 1):
        momentum = 0.5 if step <= early else 0.8
        g = gradient(state, edges, exaggeration if step <= early else 1.0)
        gain = F.zip_with("gain", F.zip_with("grad", "v", lambda a, b: a * b), lambda x, same: F.greatest(F.when(same < 0, x + 0.2).otherwise(x * 0.8), F.lit(0.01)))
        moved = g.select("id", "y", "v", "grad", gain.alias("gain"))
        v = F.zip_with(F.transform("v", lambda x: x * momentum), F.zip_with("gain", "grad", lambda a, b: a * b * rate), lambda a, b: a - b)
        state = write(moved.select("id", "y", v.alias("v"), "gain").select("id", F.zip_with("y", "v", lambda a, b: a + b).alias("y"), "v", "gain"), f"map-{step}")
    return state.select("id", "y")

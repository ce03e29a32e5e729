"""All pairs of vectors, block by block: every task holds one block, reads the others in turn and returns only what its report needs.

The work is quadratic by definition; what is shuffled and written is not. The vectors are dealt into blocks of up to ``BLOCK`` rows once, as Parquet in the
shared folder, and a task reads there the blocks that its own one meets, so no row is shuffled twice, memory is bounded by two blocks, a tile
of scores and what the report keeps for the rows of a block, and no pair is written out unless a report asks for it. Blocks are large, as all of them are read
once a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.matrices import _at, scratch

#: Rows and bytes of a block at most, and rows below which a block isn't cut for the sake of more tasks.
BLOCK, BLOCK_BYTES, LEAST = 1 << 15, 1 << 24, 256
#: Rows of a tile of scores and of the other side's, few enough for a processor's cache.
TILE, WIDE = 512, 256
#: Pairs whose vectors are gathered at a time.
GATHER = 1 << 13
#: Sums that a report on groups holds at most before it returns them, and that it returns at a time.
CELLS, RETURNED = 1 << 22, 1 << 16
#: Scores are ranked as rounded to so many decimals, ties to the smaller ids, so that the order of summation doesn't matter.
DECIMALS = 6


def _usable(id_col: str, vector_col: str) -> Column:
    """A vector that is null, or holds a null or a number that isn't finite, is in no pair, and so is one without an id."""
    return F.col(id_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def pair_map(vectors: DataFrame, id_col: str, vector_col: str, group_col: str, report: Callable, schema: str, both: bool = False, block: int = BLOCK) -> DataFrame:
    """Rows of a report over all pairs. With ``both`` a block meets every block, so that its rows see all others; else each pair comes once.

    ``report(ids, groups)`` makes what a block keeps: ``meet(x, y, ids, groups, which)`` takes the pairs of its rows x with the rows y of the same or another block, where ``which(at, to)``
    marks the pairs of two slices that count (None: all), and may return tables of rows; ``rows()`` returns the rest, as tables too.
    """
    spark = vectors.sparkSession
    vectors = vectors.where(_usable(id_col, vector_col))
    n, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vector_col)), F.lit(1))).first()
    most = max(1, min(block, BLOCK_BYTES // (8 * max(width, 1))))
    blocks = max(1, -(-n // most), min(-(-n // LEAST), 2 * spark.sparkContext.defaultParallelism))
    held = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    own = vectors.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), F.col(vector_col).cast(held).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("block"))
    path = f"{scratch(spark)}/blocks"
    own.repartition(blocks, "block").sortWithinPartitions("block", "id").write.partitionBy("block").parquet(path)
    # the numbers of blocks that have rows, as many as there are tasks
    known = sorted(r.block for r in spark.read.schema(f"id {own.schema['id'].dataType.simpleString()}, block long").parquet(path).select("block").distinct().collect())

    def read(number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        files, root = _at(path)
        t = pq.read_table(f"{root}/block={number}", filesystem=files, columns=["id", "grp", "v"], partitioning=None).combine_chunks()
        v, grp = t["v"].combine_chunks(), t["grp"]
        if len(set(v.value_lengths().to_pylist())) > 1:
            raise ValueError("vectors of different lengths")
        groups = np.array(grp.to_pylist(), dtype=object) if pa.types.is_list(grp.type) else grp.to_numpy()
        return t["id"].to_numpy(), groups, v.flatten().to_numpy().astype(np.float64, copy=False).reshape(len(t), -1)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for place in (p for part in parts for p in part["id"]):
            ia, ga, x = read(known[place])
            kept, half = report(ia, ga), len(known) // 2
            # a ring: each block meets the half of the blocks that follows it, and of two opposite ones the first meets the second
            ahead = len(known) if both else half + 1 if len(known) % 2 or place < half else half
            for step in range(ahead):
                ib, gb, y = (ia, ga, x) if not step else read(known[(place + step) % len(known)])
                yield from kept.meet(x, y, ib, gb, (lambda at, to, ib=ib: ia[at, None] != ib[None, to] if both else ia[at, None] < ib[None, to]) if not step else lambda at, to: None)
            yield from kept.rows()

    return spark.range(0, len(known), 1, max(1, len(known))).mapInPandas(run, schema)


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a's and b's groups are equal; an unknown one equals none."""
    codes = pd.factorize(np.concatenate([a, b]))[0]
    return np.where(codes[: len(a)] < 0, -2, codes[: len(a)])[:, None] == codes[None, len(a) :]


class _Sums:
    """What adds up the scores of all pairs: ``add(at, ids, groups, scores, valid)`` takes (and may overwrite) those of a tile."""

    def meet(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray, groups: np.ndarray, which: Callable) -> Iterator[pd.DataFrame]:
        for c in range(0, len(y), WIDE):
            for r in range(0, len(x), TILE):
                at, to = slice(r, r + TILE), slice(c, c + WIDE)
                valid = which(at, to)
                if valid is None or valid.any():
                    self.add(at, ids[to], groups[to], x[at] @ y[to].T, valid)
        return iter(())


class _Picks:
    """What keeps a few pairs of largest key, ``k`` a tile or (``each``) a row of it.

    A key is the product of the two ``sides`` of a pair. A tile's keys are worked out in 32 bits, with a bound on what they may be wrong by, and in 64 bits if those leave too many pairs; the pairs left are
    worked out one by one by ``exact(a, b)``, so that pairs of equal vectors have equal keys, wherever they stand, and ids decide. ``bar(at)`` is the least key that still counts,
    ``slack`` the most by which ranked keys differ from exact ones; ``take`` keeps pairs.
    """

    k: int
    each: bool
    slack: float
    left: np.ndarray | None = None

    def sides(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return v, v

    def exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", a, b)

    def _left(self, key: np.ndarray, wrong: np.ndarray, at: slice, valid: np.ndarray | None) -> np.ndarray:
        """Places in the tile of the pairs that may count. Keys that are no numbers stay, for ``exact`` to tell."""
        if valid is not None:
            key[~valid] = -np.inf
        slack = wrong[:, None] + self.slack
        low = self.bar(at) - slack
        found = np.flatnonzero(~(key < np.nextafter(low.astype(key.dtype), -np.inf, dtype=key.dtype)))
        size = key.shape[1] if self.each else key.size
        if len(found) > 8 * self.k * key.size // size and size > self.k:
            best = np.partition(key, size - self.k, axis=1)[:, size - self.k, None] if self.each else np.partition(key, size - self.k, axis=None)[size - self.k]
            best = np.where(np.isfinite(best), best.astype(np.float64), -np.inf)
            # a row's bound for each of its own pairs; over a whole tile the largest bound of all
            low = np.maximum(low, best - 2 * (slack if self.each else slack.max()))
            found = np.flatnonzero(~(key < np.nextafter(low.astype(key.dtype), -np.inf, dtype=key.dtype)))
        return found if valid is None else found[valid.ravel()[found]]

    def meet(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray, groups: np.ndarray, which: Callable) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore", invalid="ignore"):
            if self.left is None:
                left = self.sides(x)[0]
                self.left, self.norms = left.astype(np.float32), np.linalg.norm(left, axis=1)
            right = self.sides(y)[1]
            norm, right = np.linalg.norm(right, axis=1).max(), right.astype(np.float32)
            # rounding of the numbers, of their products and of the sum over them, and what is too small for 32 bits
            wrong = (right.shape[1] + 16) * norm * self.norms
            for r in range(0, len(x), TILE):
                at, found, many = slice(r, r + TILE), [], 0
                for c in range(0, len(y), WIDE):
                    to = slice(c, c + WIDE)
                    valid = which(at, to)
                    if valid is not None and not valid.any():
                        continue
                    key = self.left[at] @ right[to].T
                    near = self._left(key, wrong[at] * 2.0**-23 + 1e-30, at, valid)
                    if len(near) > key.size // 8:
                        near = self._left(self.sides(x[at])[0] @ self.sides(y[to])[1].T, wrong[at] * 2.0**-52 + 1e-300, at, valid)
                    if len(near):
                        rows, cols = np.divmod(near, key.shape[1])
                        found.append((rows, cols + c))
                        many += len(near)
                    if many > 4 * self.k * (key.shape[0] if self.each else 1):
                        self._settle(at, x, y, ids, found)
                        found, many = [], 0
                if many:
                    self._settle(at, x, y, ids, found)
        return iter(())

    def _settle(self, at: slice, x: np.ndarray, y: np.ndarray, ids: np.ndarray, found: list) -> None:
        rows, cols = (np.concatenate(f) for f in zip(*found))
        key = np.concatenate([self.exact(x[at.start + rows[i : i + GATHER]], y[cols[i : i + GATHER]]) for i in range(0, len(rows), GATHER)])
        self.take(at, rows, ids[cols], key)


class _Extremes(_Picks):
    """The ``top`` pairs of largest sign * similarity, ties to the smaller ids."""

    each, slack = False, 10.0**-DECIMALS

    def __init__(self, ids: np.ndarray, groups: np.ndarray, top: int, sign: int):
        self.ids, self.k, self.sign = ids, top, sign
        self.best = (np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))

    def sides(self, v):
        return self.sign * v, v

    def exact(self, a, b):
        return self.sign * np.einsum("ij,ij->i", a, b)

    def bar(self, at):
        return self.best[0][-1] if len(self.best[0]) == self.k else -np.inf

    def take(self, at, rows, ids, key):
        key, own = np.round(key, DECIMALS) + 0.0, self.ids[at]
        a, b = np.minimum(own[rows], ids), np.maximum(own[rows], ids)
        if len(self.best[0]) == self.k:
            bar, *last = (x[-1] for x in self.best)
            keep = (key > bar) | ((key == bar) & ((a < last[0]) | ((a == last[0]) & (b < last[1]))))
            key, a, b = key[keep], a[keep], b[keep]
        key, a, b = (np.concatenate(x) for x in zip(self.best, (key, a, b)))
        order = np.lexsort((b, a, -key))[: self.k]
        self.best = key[order], a[order], b[order]

    def rows(self) -> Iterator[pd.DataFrame]:
        key, a, b = self.best
        yield pd.DataFrame({"id_a": a, "id_b": b, "similarity": self.sign * key + 0.0})


def extreme_pairs(vectors: DataFrame, id_col: str, vector_col: str, group_col: str, top: int = 50, largest: bool = True) -> DataFrame:
    """(id_a, id_b, similarity) of the ``top`` most (or least) similar pairs."""
    every = pair_map(vectors, id_col, vector_col, group_col, lambda ids, groups: _Extremes(ids, groups, top, 1 if largest else -1), "id_a long, id_b long, similarity double")
    return every.orderBy(F.desc("similarity") if largest else F.asc("similarity"), "id_a", "id_b").limit(top)


class Nearest(_Picks):
    """For each row of a block the k others of largest key, ties to the smaller id: similarity, ranked as rounded, or with ``distance`` the squared distance below zero."""

    each = True

    def __init__(self, ids: np.ndarray, groups: np.ndarray, k: int, names: list[str], distance: bool = False):
        self.ids, self.k, self.names, self.distance, self.slack = ids, k, names, distance, 0.0 if distance else 10.0**-DECIMALS
        self.keys, self.near = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), ids.dtype)

    def sides(self, v):
        if not self.distance:
            return v, v
        squared, one = np.einsum("ij,ij->i", v, v)[:, None], np.ones((len(v), 1))
        return np.concatenate([2 * v, squared, one], axis=1), np.concatenate([v, -one, -squared], axis=1)

    def exact(self, a, b):
        if self.distance:
            a = a - b
            return -np.einsum("ij,ij->i", a, a)
        return np.round(np.einsum("ij,ij->i", a, b), DECIMALS) + 0.0

    def bar(self, at):
        return self.keys[at, -1:]

    def take(self, at, rows, ids, key):
        bar, last = self.keys[at, -1], self.near[at, -1]
        keep = (key > bar[rows]) | ((key == bar[rows]) & (ids < last[rows]))
        if not keep.any():
            return
        rows, key, ids = rows[keep], key[keep], ids[keep]
        some = np.unique(rows)
        row = np.concatenate([rows, np.repeat(some, self.k)])
        key, ids = np.concatenate([key, self.keys[at][some].ravel()]), np.concatenate([ids, self.near[at][some].ravel()])
        real = np.isfinite(key)
        row, key, ids = row[real], key[real], ids[real]
        order = np.lexsort((ids, -key, row))
        row, key, ids = row[order], key[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.keys[at.start + row[keep], place[keep]], self.near[at.start + row[keep], place[keep]] = key[keep], ids[keep]

    def rows(self) -> Iterator[pd.DataFrame]:
        row, place = np.nonzero(np.isfinite(self.keys))
        yield pd.DataFrame(dict(zip(self.names, (self.ids[row], self.near[row, place], self.keys[row, place])))).drop_duplicates(self.names[:2])


def knn_edges(vectors: DataFrame, id_col: str, vector_col: str, group_col: str, k: int = 4) -> DataFrame:
    """(id_a, id_b, similarity): undirected edges from every row to its k nearest others."""
    near = pair_map(vectors, id_col, vector_col, group_col, lambda ids, groups: Nearest(ids, groups, k, ["i", "j", "similarity"]), "i long, j long, similarity double", True)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("similarity"), "j"))).where(F.col("rank") <= k)
    return ranked.groupBy(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).agg(F.max("similarity").alias("similarity"))


class _Ends(_Sums):
    def __init__(self, ids: np.ndarray, groups: np.ndarray):
        self.lo, self.hi = np.inf, -np.inf

    def add(self, at, ids, groups, scores, valid):
        s = scores if valid is None else scores[valid]
        self.lo, self.hi = min(self.lo, s.min()), max(self.hi, s.max())

    def rows(self) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"lo": [self.lo], "hi": [self.hi]} if self.lo <= self.hi else {"lo": [], "hi": []}, dtype=float)


class _Counts(_Sums):
    def __init__(self, ids: np.ndarray, groups: np.ndarray, lo: float, hi: float, bins: int):
        self.groups, self.lo, self.hi, self.bins = groups, lo, hi, bins
        self.counts = np.zeros(2 * bins, np.int64)

    def add(self, at, ids, groups, scores, valid):
        if self.hi == self.lo:
            bin_ = np.zeros(scores.shape, np.int32)
        else:
            scores -= self.lo
            scores /= self.hi - self.lo
            scores *= self.bins
            bin_ = scores.astype(np.int32)
            np.clip(bin_, 0, self.bins - 1, out=bin_)
        bin_ += ~_same(self.groups[at], groups) * np.int32(self.bins)
        self.counts += np.bincount(bin_.ravel() if valid is None else bin_[valid], minlength=2 * self.bins)

    def rows(self) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"bin": np.arange(1, self.bins + 1), "intra": self.counts[: self.bins], "inter": self.counts[self.bins :]})


def pair_histogram(vectors: DataFrame, id_col: str, vector_col: str, group_col: str, bins: int = 50) -> DataFrame:
    """(bin, intra_count, inter_count) from the least to the largest similarity; the last bin holds its upper edge."""
    lo, hi = pair_map(vectors, id_col, vector_col, group_col, _Ends, "lo double, hi double").agg(F.min("lo"), F.max("hi")).first()
    parts = pair_map(vectors, id_col, vector_col, group_col, lambda ids, groups: _Counts(ids, groups, lo, hi, bins), "bin int, intra long, inter long")
    return parts.groupBy("bin").agg(F.sum("intra").alias("intra_count"), F.sum("inter").alias("inter_count")).where("intra_count + inter_count > 0")


class _Inside(_Sums):
    """Number, sum and sum of squares of similarities inside the groups, by rows first."""

    def __init__(self, ids: np.ndarray, groups: np.ndarray):
        self.groups, self.n, self.s, self.q = groups, np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))

    def add(self, at, ids, groups, scores, valid):
        same = _same(self.groups[at], groups)
        if valid is not None:
            same &= valid
        scores *= same
        self.n[at] += np.count_nonzero(same, axis=1)
        self.s[at] += scores.sum(axis=1)
        self.q[at] += np.einsum("ij,ij->i", scores, scores)

    def rows(self) -> Iterator[pd.DataFrame]:
        some = self.n > 0
        yield pd.DataFrame({"grp": self.groups[some], "n": self.n[some], "s": self.s[some], "q": self.q[some]}).groupby("grp", as_index=False).sum()


def within_group(vectors: DataFrame, id_col: str, vector_col: str, group_col: str) -> DataFrame:
    """(grp, n, mean, std) of the similarities of pairs inside each group; std of the population."""
    parts = pair_map(vectors, id_col, vector_col, group_col, _Inside, f"grp {dict(vectors.dtypes)[group_col]}, n long, s double, q double").groupBy("grp").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    return parts.select("grp", "n", F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))), 6).alias("std"))


class _Distances:
    """Sums of each row's distances to the groups of every labelling; with very many groups they are returned in parts."""

    def __init__(self, ids: np.ndarray, groups: np.ndarray):
        self.ids, self.groups = ids, groups
        self._clear()

    def _clear(self):
        self.place: dict[tuple[int, str], int] = {}
        self.sums = np.zeros((len(self.ids), 0))

    def meet(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray, groups: np.ndarray, which: Callable) -> Iterator[pd.DataFrame]:
        twice = -2.0 * x
        for c in range(0, len(y), WIDE):
            to = slice(c, c + WIDE)
            found = [pd.factorize(groups[to, k]) for k in range(groups.shape[1])]
            places = [self.place.setdefault((k, g), len(self.place)) for k, (_, names) in enumerate(found) for g in names]
            of = np.concatenate([codes[:, None] == np.arange(len(names)) for codes, names in found], axis=1).astype(float)
            if len(self.place) > self.sums.shape[1]:
                self.sums = np.pad(self.sums, ((0, 0), (0, len(self.place) - self.sums.shape[1])))
            part, held = np.empty((len(x), of.shape[1])), np.empty((TILE, len(of)))
            for r in range(0, len(x), TILE):
                at = slice(r, r + TILE)
                d = np.matmul(twice[at], y[to].T, out=held[: len(x) - r])  # overwritten step by step, as a tile fits a processor's cache
                d += 2.0
                np.sqrt(np.maximum(d, 0.0, out=d), out=d)
                valid = which(at, to)
                if valid is not None:
                    d[~valid] = 0.0
                np.matmul(d, of, out=part[at])
            self.sums[:, places] += part
            if self.sums.size > CELLS:
                yield from self.rows()
                self._clear()

    def rows(self) -> Iterator[pd.DataFrame]:
        k, other = np.array([k for k, _ in self.place], np.int64), np.array([g for _, g in self.place], object)
        step = max(1, RETURNED // max(1, len(k)))
        for at in range(0, len(self.ids), step):
            sums = self.sums[at : at + step]
            rows, cols = np.repeat(np.arange(at, at + len(sums)), len(k)), np.tile(np.arange(len(k)), len(sums))
            yield pd.DataFrame({"k": k[cols], "id": self.ids[rows], "own": self.groups[rows, k[cols]], "other": other[cols], "d": sums.ravel()})


def silhouettes(vectors: DataFrame, id_col: str, vector_col: str, labellings: list[str]) -> DataFrame:
    """(labelling, n, silhouette): the mean silhouette of unit vectors under Euclidean distance, for each of several columns of groups. Rows alone in their group take no part.

    The distances of two blocks are worked out once, for all labellings. A null group is one of its own.
    """
    labels = {c: k for k, c in enumerate(labellings)}
    rows = vectors.select(F.col(id_col), F.col(vector_col), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in labellings]).alias("__groups"))
    kind = dict(rows.dtypes)[id_col]
    sums = pair_map(rows, id_col, vector_col, "__groups", _Distances, f"k int, id {kind}, own string, other string, d double", True).repartition("k", "id").groupBy("k", "id", "own", "other").agg(F.sum("d").alias("d"))
    sizes = rows.where(_usable(id_col, vector_col)).select(F.posexplode("__groups").alias("k", "other")).groupBy("k", "other").agg(F.count(F.lit(1)).alias("size"))
    # Spark takes the sums for as few rows as there are blocks, and would send them all to the driver to broadcast them; they are rows times groups, the sizes one row a group
    mean = sums.join(F.broadcast(sizes), ["k", "other"]).select("k", "id", F.when(F.col("own") == F.col("other"), F.col("d") / F.nullif(F.col("size") - 1, F.lit(0))).alias("a"), F.when(F.col("own") != F.col("other"), F.col("d") / F.col("size")).alias("b"))
    per = mean.groupBy("k", "id").agg(F.max("a").alias("a"), F.min("b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    every = vectors.sparkSession.createDataFrame([(k, c) for c, k in labels.items()], "k int, labelling string")
    found = per.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b")), 6).alias("silhouette"))
    return every.join(found, "k", "left").select("labelling", F.coalesce("n", F.lit(0)).alias("n"), "silhouette")


def silhouette(vectors: DataFrame, id_col: str, vector_col: str, group_col: str) -> DataFrame:
    """One row (n, silhouette) for one column of groups."""
    return silhouettes(vectors, id_col, vector_col, [group_col]).select("n", "silhouette")

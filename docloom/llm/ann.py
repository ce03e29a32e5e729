"""Approximate nearest neighbours by an inverted multi-index.

Two codebooks, each for one half of the vectors, are fitted by k-means on a bounded sample of ``SAMPLE`` rows. A vector's cell is the pair
of its nearest centroids; every row is indexed. A query walks the pairs in order of summed distance with a heap until
the cells passed hold as many different vectors as ``CANDIDATES``, or ``CANDIDATE_SHARE`` of all rows if that is more; their rows, copies
too, are scored exactly, in double precision, and the best stay.

Largest inner product becomes least distance by one more component, sqrt(M**2 - |v|**2) for M the longest length (0 in
queries), which only steers the walk. The directory of cells holds at most ``MAX_CODES`` ** 2 counts.

A cell is stored in units of at most about ``UNIT_ROWS`` rows, so copies of one vector do not meet in one task; units are dealt over
shards of about ``SHARD_ROWS`` rows, and each shard meets the queries that visit it, a row for each with the units it visits there, ``QUERY_BLOCK`` at a time, in one Python call that
returns at most k rows per query.

Defined results: vectors that are null, empty, of another length than most, all zero, or that hold a null or non-finite component take no part, as
query or candidate, nor do rows without id. Rows that share the query's id are its own and no candidates of it; an id asked for by several
rows is one query, that of its least vector. Other rows that repeat are candidates each. Copies tie and are ordered by id. An empty table gives
no rows. Columns other than the two named, whatever they are called, are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

SAMPLE = 20_000
MAX_CODES = 256
#: Rows that a cell should hold on average.
CELL_ROWS = 12
CANDIDATES = 8_000
#: Vectors without cluster structure need a share of all rows for a recall of 0.9; clustered ones need far less.
CANDIDATE_SHARE = 0.4
UNIT_ROWS = 2_000
SHARD_ROWS = 20_000
QUERY_BLOCK = 4_000
#: Queries that one task walks the cells for.
WALKS = 128
TOP = 20


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Plain Lloyd from k distinct rows; an empty centroid moves to the row farthest from its own."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        d = _square_distances(x, centres)
        own = d.argmin(axis=1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        far = np.argsort(-d[np.arange(len(x)), own], kind="stable")
        centres[np.flatnonzero(n == 0)] = x[far[: (n == 0).sum()]]
    return centres


def _square_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :]


def walk(left: np.ndarray, right: np.ndarray, held: np.ndarray, want: int) -> list[int]:
    """Non-empty cells (i * codes + j) by left[i] + right[j], until they hold ``want`` rows in all."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, found, total = [(left[a[0]] + right[b[0]], 0, 0)], [], 0
    while heap and total < want:
        _, i, j = heapq.heappop(heap)
        n = held[a[i], b[j]]
        if n:
            found.append(int(a[i]) * len(right) + int(b[j]))
            total += int(n)
        if j + 1 < len(b):
            heapq.heappush(heap, (left[a[i]] + right[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (left[a[i + 1]] + right[b[0]], i + 1, 0))
    return found


def usable(vector: Column, size: int) -> Column:
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce((F.size(vector) == size) & ok, F.lit(False))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 0))


def search(vectors: DataFrame, is_query: Column, top: int = TOP, candidates: int = CANDIDATES, share: float = CANDIDATE_SHARE, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 9) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` best candidates found for each row where is_query."""
    spark = vectors.sparkSession
    out = "query_id long, vec_id long, score double"
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("vec_id").isNotNull())
    sizes = rows.groupBy(F.size("v").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return empty
    rows = rows.where(usable(F.col("v"), sizes["n"]))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    total, longest = rows.agg(F.count(F.lit(1)), F.max(norm)).first()
    if not total:
        return empty
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) <= (1 << 30) * min(1.0, 1.2 * SAMPLE / total)).orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(SAMPLE).select("v").toPandas()
    if not len(sample):
        sample = rows.orderBy("vec_id").limit(SAMPLE).select("v").toPandas()
    want = max(candidates, int(np.ceil(share * total)))
    half = sizes["n"] // 2
    codes = int(np.clip(np.sqrt(total / CELL_ROWS), 1, MAX_CODES))

    def halves(x: np.ndarray, is_q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        more = np.where(is_q, 0.0, np.sqrt(np.maximum(0.0, longest - (x * x).sum(axis=1))))
        return x[:, :half], np.concatenate([x[:, half:], more[:, None]], axis=1)

    x = _matrix(sample["v"])
    left, right = halves(x, np.zeros(len(x), dtype=bool))
    books = spark.sparkContext.broadcast((kmeans(left, codes, seed), kmeans(right, codes, seed + 1)))
    n_right = len(books.value[1])

    @F.pandas_udf("long")
    def cell_of(v: pd.Series) -> pd.Series:
        x = _matrix(v)
        if not len(x):
            return pd.Series([], dtype="int64")
        a, b = halves(x, np.zeros(len(x), dtype=bool))
        return pd.Series(_square_distances(a, books.value[0]).argmin(axis=1) * n_right + _square_distances(b, books.value[1]).argmin(axis=1))

    index = materialize(rows.select("vec_id", "v", "q", cell_of("v").alias("cell")), "cells")
    # the walk counts different vectors, so copies use up no query's candidates; units are cut by rows
    copies = index.groupBy("cell", F.xxhash64("v").alias("h")).count()
    directory = copies.groupBy("cell").agg(F.count(F.lit(1)).alias("different"), F.sum("count").alias("count")).toPandas()
    held, different = (np.zeros((len(books.value[0]), n_right), dtype=np.int64) for _ in range(2))
    held.ravel()[directory["cell"].to_numpy(dtype=np.int64)] = directory["count"].to_numpy()
    different.ravel()[directory["cell"].to_numpy(dtype=np.int64)] = directory["different"].to_numpy()
    n_shards = max(1, -(-total // SHARD_ROWS))
    parts = np.maximum(1, -(-held // UNIT_ROWS))
    first = (np.cumsum(parts.ravel()) - parts.ravel()).reshape(parts.shape)
    plan = spark.sparkContext.broadcast((different, parts, first))

    @F.pandas_udf("long")
    def unit_of(cell: pd.Series, h: pd.Series) -> pd.Series:
        _, parts, first = plan.value
        c = cell.to_numpy()
        return pd.Series(first.ravel()[c] + (h.to_numpy().view(np.uint64) % parts.ravel()[c].astype(np.uint64)).astype(np.int64))

    stored = index.select("vec_id", "v", unit_of("cell", F.xxhash64("vec_id")).alias("unit")).withColumn("shard", F.col("unit") % n_shards)

    def visits(batches):
        different, parts, first = plan.value
        for pdf in batches:
            x = _matrix(pdf["v"])
            if not len(x):
                continue
            a, b = halves(x, np.ones(len(x), dtype=bool))
            da, db = _square_distances(a, books.value[0]), _square_distances(b, books.value[1])
            for i in range(len(pdf)):
                cells = walk(da[i], db[i], different, want)
                units = np.array([int(first.ravel()[c]) + p for c in cells for p in range(parts.ravel()[c])], dtype=np.int64)
                shards = units % n_shards
                own = np.unique(shards)
                yield pd.DataFrame({"query_id": pdf["vec_id"].iloc[i], "shard": own, "units": [units[shards == k] for k in own]})

    asked_for = materialize(index.where("q").groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n_queries = asked_for.count()
    # a walk costs time, not bytes, so queries are dealt by their number
    walked = asked_for.repartition(max(1, -(-n_queries // WALKS)), "vec_id")
    per_shard = walked.mapInPandas(visits, "query_id long, shard long, units array<long>")
    n_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(n_blocks))
    asked = per_shard.join(asked_for.select(F.col("vec_id").alias("query_id"), "v"), "query_id").withColumn("block", block)
    stored = stored.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))

    def rerank(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        rows = rows.sort_values(["unit", "vec_id"], ignore_index=True)
        x, ids = _matrix(rows["v"]), rows["vec_id"].to_numpy()
        units, own = np.unique(rows["unit"].to_numpy(), return_inverse=True)
        found = []
        for s in range(0, len(queries), 128):
            part = queries.iloc[s : s + 128]
            q = _matrix(part["v"])
            rough = q @ x.T
            for i, (query, seen) in enumerate(zip(part["query_id"], part["units"], strict=True)):
                visited = np.zeros(len(units), dtype=bool)
                visited[np.searchsorted(units, np.intersect1d(seen, units))] = True
                at = np.flatnonzero(visited[own] & (ids != query))
                if len(at) > top:  # the product rounds as its blocking wants: what is close to the last place stays for the exact sum
                    r = rough[i, at]
                    bound = np.partition(r, len(at) - top)[len(at) - top]
                    at = at[r >= bound - 1e-9 * max(1.0, abs(bound), longest)]
                score = (x[at] * q[i]).sum(axis=1)
                best = np.lexsort([ids[at], -score])[:top]
                found.append((np.full(len(best), query), ids[at][best], score[best]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    near = stored.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(rerank, out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op9_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)

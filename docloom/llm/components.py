"""Connected components by alternating large-star and small-star steps; edges never leave the executors.

Each step takes the least neighbour of every node as an aggregate and joins it back, so a hub with a large share of all
edges is pre-aggregated and its join is split; no neighbourhood is gathered. Steps number about log of the size squared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_shuffles, materialize


def _mark(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: (u, v) longs, any direction. Returns (node, root), root the least node of the component, for nodes with an edge."""
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark, steps = _mark(e), 0
    while mark[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.when(F.col("v") == F.col("m"), F.array(F.struct("u", F.col("m").alias("v")))).otherwise(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).alias("x")).select("x.*").where("u <> v").distinct()
        new = materialize(small, "edges")
        discard(e)
        e, old, mark, steps = new, mark, _mark(new), steps + 1
        if steps % 3 == 0:
            free_shuffles(e.sparkSession)
        if mark == old:
            break
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out._docloom_path = e._docloom_path
    return out

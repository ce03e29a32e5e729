"""Similarity of vectors by group, in time linear in the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_gap(vectors: DataFrame, vector_col: str, group_col: str) -> DataFrame:
    """One row: number and mean of inner products of pairs inside groups and across, and the gap between the means.

    The sum over pairs of a group is (|sum of vectors|^2 - sum of |vector|^2) / 2, so no pair is formed.
    """
    parts = vectors.select(F.col(group_col).alias("g"), F.posexplode(F.col(vector_col).cast("array<double>")).alias("d", "x")).groupBy("g", "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    by_dim = parts.groupBy("d").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("gs"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    one = by_dim.agg((F.sum(F.col("gs") - F.col("q")) / 2).alias("intra"), (F.sum(F.col("s") * F.col("s") - F.col("q")) / 2).alias("all"), F.max("pairs").cast("long").alias("intra_n"), F.max(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("all_n"))
    intra, inter = F.col("intra") / F.col("intra_n"), (F.col("all") - F.col("intra")) / (F.col("all_n") - F.col("intra_n"))
    return one.select("intra_n", (F.col("all_n") - F.col("intra_n")).alias("inter_n"), F.round(intra, 6).alias("intra_mean"), F.round(inter, 6).alias("inter_mean"), F.round(intra - inter, 6).alias("gap"))

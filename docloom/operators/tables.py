"""Group reports, ordered look-backs and distances of distributions, as plans of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.keywords import small


def rollup_rates(df: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """(keys, n, passed, rate) by every prefix of the keys; a null key means all."""
    return df.rollup(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("passed")).withColumn("rate", F.round(F.col("passed") / F.col("n"), 6))


def pivot_counts(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).na.fill(0)


def segments(df: DataFrame, group: str, order: str, starts: Column) -> DataFrame:
    """df with segment: how many starts lie at or before the row in its group (0 before the first)."""
    return df.withColumn("segment", F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def last_before(df: DataFrame, group: str, order: list[str], value: Column, when: Column, name: str) -> DataFrame:
    """df with the value of the group's latest row at or before this one for which ``when`` holds."""
    over = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(F.when(when, value), ignorenulls=True).over(over))


def interleaved(labels: DataFrame, bodies: DataFrame, group: str, at: str, order: str) -> DataFrame:
    """Labels and bodies of each group in one order: a label comes before the first body that stands at its place or after; labels without one come last.

    Both have the columns (group, at, order, ...); order parts rows of one kind at one place. The result has ``place`` (from 1), ``is_label`` and, for labels, ``opens``:
    the order of the body that it opens, or null.
    """
    both = labels.withColumn("is_label", F.lit(True)).unionByName(bodies.withColumn("is_label", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(group).orderBy(F.col(at), F.desc("is_label"), F.col(order))
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    opens = F.first(F.when(~F.col("is_label"), F.col(order)), ignorenulls=True).over(ahead)
    return both.select(*both.columns, F.row_number().over(w).alias("place"), F.when(F.col("is_label"), opens).alias("opens"))


def cosine_to_mean(vectors: DataFrame, group: str, vector: str, *cols: str) -> DataFrame:
    """(cols, grp, cosine): each row's cosine with the mean of its group. A mean is one array, so a vector stays in its row."""
    rows = vectors.select(*cols, F.col(group).alias("grp"), F.col(vector).cast("array<double>").alias("v"))
    parts = rows.select("grp", F.posexplode("v").alias("d", "x")).groupBy("grp", "d").agg(F.avg("x").alias("m"))
    mean = parts.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda x: x["m"]).alias("m"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return rows.join(small(mean, 10_000), "grp").select(*cols, "grp", (dot("v", "m") / F.sqrt(dot("v", "v") * dot("m", "m"))).alias("cosine"))


def representatives(vectors: DataFrame, id_col: str, group: str, vector: str, top: int = 2) -> DataFrame:
    """(group, rank, id, cosine): each group's rows nearest to its mean, ties to the smaller id."""
    near = cosine_to_mean(vectors, group, vector, id_col).select("grp", F.col(id_col).alias("id"), F.round("cosine", 6).alias("cosine"))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("cosine"), "id"))).where(F.col("rank") <= top)


def js_distance(df: DataFrame, key: str, side: Column) -> DataFrame:
    """One row: Jensen-Shannon distance, in bits, between the distributions of key where side holds and where it doesn't."""
    n = df.groupBy(key).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    total = n.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    p, q = F.col("a") / F.col("na"), F.col("b") / F.col("nb")
    m = (p + q) / 2
    part = F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)
    return n.join(F.broadcast(total)).agg(F.round(F.sqrt(F.greatest(F.sum(part) / 2, F.lit(0.0))), 6).alias("distance"))

"""Assignment to centroids and Lloyd steps. Centroids are k rows by a parameter, so they become literals of the plan; vectors stay put."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups whose means may become literals of a plan.
MOST_GROUPS = 1_000


def _table(pairs: list[tuple[int, list[float]]]):
    return F.array(*[F.struct(F.lit(int(c)).cast("long").alias("c"), F.array(*[F.lit(float(x)) for x in v]).alias("m")) for c, v in pairs])


def assign(vectors: DataFrame, vector_col: str, centroids: list[tuple[int, list[float]]]) -> DataFrame:
    """vectors with (cluster, d2): the nearest centroid, ties to the smaller number."""
    v = F.col(vector_col).cast("array<double>")
    d2 = F.transform(_table(centroids), lambda c: F.struct(F.aggregate(F.zip_with(v, c["m"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x).alias("d2"), c["c"].alias("cluster")))
    return vectors.withColumn("__near", F.array_min(d2)).select(*vectors.columns, F.col("__near.cluster").alias("cluster"), F.col("__near.d2").alias("d2"))


def means(vectors: DataFrame, vector_col: str, group: str) -> list[tuple[int, list[float]]]:
    """(group, mean vector) of every group, in order. More groups than MOST_GROUPS are refused, for the means come to the driver and into the plan."""
    if vectors.select(group).distinct().limit(MOST_GROUPS + 1).count() > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    parts = vectors.select(F.col(group).alias("g"), F.posexplode(F.col(vector_col).cast("array<double>")).alias("i", "x")).groupBy("g", "i").agg(F.avg("x").alias("m"))
    rows = parts.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("m")).orderBy("g").select("g", "m.m").collect()
    return [(r.g, list(r.m)) for r in rows]


def lloyd(vectors: DataFrame, id_col: str, vector_col: str, k: int = 5, steps: int = 3) -> DataFrame:
    """vectors with (cluster, d2) after so many steps from the k rows of least id. An empty cluster keeps its centroid.

    d2 and cluster are of the assignment before the last update, as in the usual order of the two half-steps.
    """
    first = vectors.orderBy(id_col).limit(k).select(F.col(vector_col).cast("array<double>").alias("v")).collect()
    centroids = [(i, list(r.v)) for i, r in enumerate(first)]
    for _ in range(steps - 1):
        centroids = sorted((dict(centroids) | dict(means(assign(vectors, vector_col, centroids), vector_col, "cluster"))).items())
    return assign(vectors, vector_col, centroids)

"""Queries on matrices and rows joined by position, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.sources import matrices


def matrix_beside_rows(spark, d):
    """The embeddings written as a matrix and read again beside the table they are from: per row its vector's length, square and first number."""
    table = matrices.numbered_parquet(spark, f"{d}/embeddings.parquet")
    path = matrices.scratch(spark)
    matrices.write_matrix(table.where("embedding is not null"), path, "embedding", ["row"])
    both = matrices.joined_by_row(table.where("embedding is not null").select("row", "vec_id", "label"), matrices.read_matrix(spark, path, task_bytes=1 << 24))
    square = F.aggregate(F.transform("vector", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    return both.select("vec_id", "label", F.size("vector").alias("width"), F.round(square, 6).alias("square"), F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"))


QUERIES = {"matrix_beside_rows": matrix_beside_rows}
SQL = {"matrix_beside_rows": "SELECT vec_id, label, len(embedding)::INT AS width, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS square, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE embedding IS NOT NULL"}

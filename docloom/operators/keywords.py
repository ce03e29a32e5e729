"""Frequent and distinctive words of groups, and lexical retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.retrieval import best_documents, by_join


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: F.length(w) >= 2)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df, broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def distinctive_words(docs: DataFrame, group_col: str, text_col: str, min_freq: int = 3, top: int = 20) -> DataFrame:
    """(group, rank, keyword, freq, score): share in the group over share in all, of words that the group has min_freq times."""
    tf = docs.select(F.col(group_col).alias("grp"), F.explode(words(F.col(text_col))).alias("keyword")).groupBy("grp", "keyword").agg(F.count(F.lit(1)).alias("freq"))
    # a group's total is the sum of its counts, which are there already
    in_group = tf.groupBy("grp").agg(F.sum("freq").alias("group_total"))
    total = in_group.agg(F.sum("group_total").alias("total"))
    tf = tf.withColumn("all_freq", F.sum("freq").over(Window.partitionBy("keyword")))
    score = F.round((F.col("freq") / F.col("group_total")) / (F.col("all_freq") / F.col("total")), 3)
    scored = tf.where(F.col("freq") >= min_freq).join(in_group, "grp").join(F.broadcast(total)).withColumn("score", score)
    order = Window.partitionBy("grp").orderBy(F.desc("score"), F.desc("freq"), "keyword")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("grp", "rank", "keyword", "freq", "score")


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, top: int = 5, k1: float = 1.5, b: float = 0.75, bonus: Column | None = None) -> DataFrame:
    """(query_id, rank, id, score): best documents for each query; a query's repeated words count as often as they occur. ``bonus`` is added to a document's score where it has one."""
    extra = F.lit(0.0) if bonus is None else F.coalesce(bonus.cast("double"), F.lit(0.0))
    w = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"), extra.alias("bonus"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(words(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    n, average = w.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.size("w")), F.lit(1.0))).first()
    met = w.select(F.explode(F.array_distinct("w")).alias("term")).join(small(asked.select("term").distinct()), "term", "left_semi")
    df = met.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = asked.join(df, "term").select("query_id", "term", (F.col("times") * F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("weight"))
    part = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / (average or 1.0)))
    found = best_documents(w, weighed, part, top)
    return by_join(w, weighed, part, top) if found is None else found


def overlap(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, top: int = 5) -> DataFrame:
    """(query_id, rank, id, score): the documents that share most different words with each query."""
    w = docs.select(F.col(id_col).alias("id"), F.array_distinct(words(F.col(text_col))).alias("w"), F.lit(0.0).alias("bonus"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(words(F.col(query_text)))).alias("term")).withColumn("weight", F.lit(1.0))
    part = lambda tf, dl: tf * 1.0
    found = best_documents(w, asked, part, top)
    return by_join(w, asked, part, top) if found is None else found

"""Queries on stored calls, with their SQL. The model is a rule, so that SQL can tell its replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import calls
from docloom.sources import cells
from docloom.sources.matrices import scratch


def _rule():
    """Says a text's first word and number of characters; texts with a z in front are refused."""

    def answer(requests: list[dict]) -> list[dict]:
        if any((r["text"] or "")[:1] in ("Z", "z") for r in requests):
            raise ValueError("refused")
        return [{"first": (r["text"] or "").split(" ")[0], "chars": len(r["text"] or "")} for r in requests]

    return answer


def stored_replies(spark, d):
    """A reply for every document, equal texts asked once."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    path = scratch(spark)
    kept = lambda df, name: (df.write.parquet(f"{path}/{name}"), spark.read.parquet(f"{path}/{name}"))[1]
    found = calls.call_model(docs, F.struct("text"), _rule, f"{path}/store", "struct<first:string,chars:int>", write=kept)
    return found.select("doc_id", "reply.first", "reply.chars", "error")


def resumed_grid(spark, d):
    """Sources by languages as cells: the first pass fails those of odd counts, the second does them; saved cells aren't run again."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source")
    grid = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    path, seen = scratch(spark), [0]

    def run(todo):
        seen[0] += 1
        return todo.withColumn("run", F.lit(seen[0]))

    langs = grid.select("lang").distinct().count()
    good = (F.col("n") % 2 == 0) | (F.col("run") > langs)
    return cells.run_grid(grid, ["lang", "source"], ["lang"], run, good, path, "source string, n long, run int, lang string").select("lang", "source", "n", (F.col("run") > langs).alias("second"))


QUERIES = {f.__name__: f for f in (stored_replies, resumed_grid)}
SQL = {
    "stored_replies": "SELECT doc_id, CASE WHEN NOT bad THEN string_split(t, ' ')[1] END AS first, CASE WHEN NOT bad THEN length(t)::INT END AS chars, CASE WHEN bad THEN 'ValueError: refused' END AS error FROM (SELECT doc_id, coalesce(text, '') AS t, left(coalesce(text, ''), 1) IN ('Z', 'z') AS bad FROM documents)",
    "resumed_grid": "SELECT lang, source, count(*) AS n, count(*) % 2 = 1 AS second FROM documents GROUP BY 1, 2",
}

"""Queries on walks over JSON, with their SQL. A conversation, put into nested JSON, is what is walked."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import jsonwalk


def _replies(spark, d):
    """A JSON text for each conversation: its turns under their speakers' ids, of which a system turn has none."""
    t = spark.read.parquet(f"{d}/conversations.parquet")
    turn = F.struct("turn", F.struct(F.when(F.col("role") == "system", "").otherwise(F.col("role")).alias("speaker_id"), F.array("text").alias("said")).alias("by"))
    body = F.to_json(F.struct(F.lit("").alias("reply_id"), F.array_sort(F.collect_list(turn)).alias("turns")), {"ignoreNullFields": "false"})
    return t.groupBy("conv_id").agg(body.alias("body"))


def json_walk_shape(spark, d):
    """How many values stand at each depth of the replies, and how many of them are members."""
    nodes = _replies(spark, d).select(F.explode(jsonwalk.walk(F.col("body"))).alias("n"))
    return nodes.groupBy("n.depth", "n.key").agg(F.count(F.lit(1)).alias("n"), F.count_if("n.member").alias("members"), F.max(F.length(jsonwalk.text_of(F.col("n.value")))).alias("longest"))


def json_walk_faults(spark, d):
    """Per reply: its blank ids, and whether a text in it has drifted."""
    nodes = _replies(spark, d).select("conv_id", jsonwalk.walk(F.col("body")).alias("nodes"))
    return nodes.select("conv_id", F.array_join(jsonwalk.empty_ids(F.col("nodes")), " ").alias("empty_ids"), jsonwalk.drifted(F.col("nodes")).isNotNull().alias("drifted"))


QUERIES = {f.__name__: f for f in (json_walk_shape, json_walk_faults)}

_BODY = """b AS (SELECT conv_id, json_object('reply_id', '', 'turns', list(json_object('turn', turn, 'by', json_object('speaker_id', CASE WHEN role = 'system' THEN '' ELSE role END, 'said', [text])) ORDER BY turn, role, text)) AS body FROM conversations GROUP BY 1),
n AS (SELECT conv_id, t.* FROM b, json_tree(body) t)"""
SQL = {
    "json_walk_shape": f"""WITH {_BODY}, p AS (SELECT a.conv_id, a.id, a.key, a.type, a.atom, len(string_split(replace(a.fullkey, '[', '.'), '.')) - 1 AS depth, p.type AS above, p.key AS above_key FROM n a LEFT JOIN n p ON p.conv_id IS NOT DISTINCT FROM a.conv_id AND p.id = a.parent)
SELECT depth::INT AS depth, key, count(*) AS n, count(*) FILTER (member) AS members, max(length(text))::INT AS longest FROM (SELECT depth, CASE WHEN above = 'ARRAY' THEN above_key ELSE key END AS key, coalesce(above = 'OBJECT', false) AS member, CASE WHEN type = 'VARCHAR' THEN atom->>'$' END AS text FROM p) GROUP BY 1, 2""",
    "json_walk_faults": f"""WITH {_BODY}, f AS (SELECT conv_id, string_agg(replace(replace(fullkey, '"', ''), '''', ''), ' ' ORDER BY len(string_split(replace(fullkey, '[', '.'), '.')), try_cast(regexp_extract(fullkey, '\\[(\\d+)\\]', 1) AS INT) NULLS FIRST) FILTER (key LIKE '%\\_id' ESCAPE '\\' AND type = 'VARCHAR' AND trim(atom->>'$') = '') AS empty_ids,
bool_or(type = 'VARCHAR' AND contains(trim(atom->>'$', ' '), ' ') AND length(regexp_replace(atom->>'$', '\\s+', '', 'g')) >= 15 AND length(regexp_replace(atom->>'$', '[^A-Za-z]+', '', 'g')) / length(regexp_replace(atom->>'$', '\\s+', '', 'g')) >= 0.6) AS drifted FROM n GROUP BY 1)
SELECT conv_id, coalesce(empty_ids, '') AS empty_ids, coalesce(drifted, false) AS drifted FROM f""",
}

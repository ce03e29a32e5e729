"""Queries on runs under conditions and on second readings, with their SQL. A conversation's turns stand for replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import runs


def _replies(spark, d):
    """Turns as replies: the role is the stage, even turns are under the condition; a text without a full stop isn't valid, one with a comma was parsed."""
    t = F.coalesce("text", F.lit(""))
    raw = F.when(F.col("turn") % 5 == 0, F.concat(F.lit("<think>so</think>"), t)).otherwise(t)
    columns = {"schema_valid": F.contains(t, F.lit(".")), "semantic_valid": F.when(F.col("turn") > 0, F.length(t) > 80), "parsed": F.when(F.contains(t, F.lit(",")), t), "raw": raw, "tokens": F.length(t)}
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", F.floor(F.col("turn") / 2).alias("pair"), F.col("role").alias("stage"), F.when(F.col("turn") % 2 == 0, "on").otherwise("off").alias("condition"), *[c.alias(n) for n, c in columns.items()])


def _rates(spark, d):
    return runs.rates(_replies(spark, d), ["stage", "condition"], "schema_valid", "semantic_valid", "parsed", "raw", "tokens")


def reply_rates(spark, d):
    return _rates(spark, d)


def stage_averages(spark, d):
    return runs.averages(_rates(spark, d), "stage")


def paired_replies(spark, d):
    """Pairs of turns under both conditions, and how often they differ in validity."""
    both = runs.paired(_replies(spark, d), ["conv_id", "pair"], "condition", "on", "off", ["stage", "schema_valid", "tokens"])
    return both.groupBy("stage_on", "stage_off").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("schema_valid_on") & ~F.col("schema_valid_off")).alias("on_only"), F.sum(F.col("tokens_on") - F.col("tokens_off")).alias("difference"))


def determinism_of_runs(spark, d):
    """Documents read twice: some come with blanks at the end, some without their first line, some as null."""
    one = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text")
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" \n"))).when(F.col("doc_id") % 11 == 0, F.concat(F.lit("x"), "text")).when(F.col("doc_id") % 13 != 0, F.col("text"))
    two = one.where("doc_id % 17 <> 0").select("doc_id", "lang", changed.alias("text"))
    return runs.determinism_rates(runs.determinism(one, two, ["doc_id", "lang"], "text"), ["lang"])


def first_rows_by_map(spark, d):
    """The first documents of each language by id: as many as a map says."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("lang", "doc_id")
    return runs.first_rows(docs, "lang", ["doc_id"], {"de": 2, "en": 7, "fr": 0})


def second_reading(spark, d):
    """Pages whose title comes from the first heading where they have none, if that is adopted."""
    html = F.coalesce("html", F.lit(""))
    inner = lambda tag: F.trim(F.regexp_extract(html, f"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1))
    r = runs.taken_over({"title": inner("title"), "lead": inner("h2")}, {"title": inner("h1"), "lead": inner("p")}, inner("p"), F.regexp_replace(html, "<[^>]*>", ""), letters="A-Za-z")
    x = spark.read.parquet(f"{d}/pages.parquet").select("page_id", r.alias("r"))
    return x.select("page_id", F.md5("r.fields.title").alias("title"), F.md5("r.fields.lead").alias("lead"), F.array_join("r.added", ",").alias("added"), "r.adopted", "r.richer")


QUERIES = {f.__name__: f for f in (reply_rates, stage_averages, paired_replies, determinism_of_runs, first_rows_by_map, second_reading)}

_R = """r AS (SELECT conv_id, floor(turn / 2)::BIGINT AS pair, role AS stage, CASE WHEN turn % 2 = 0 THEN 'on' ELSE 'off' END AS condition, coalesce(text, '') AS t, turn, contains(coalesce(text, ''), '.') AS valid FROM conversations)"""
_Q = f"""{_R}, q AS (SELECT stage, condition, count(*) AS n, round(avg(valid::INT), 6) AS schema_validity_rate, round(avg(CASE WHEN turn > 0 THEN (length(t) > 80)::INT END), 6) AS semantic_validity_rate,
round(avg((NOT valid AND NOT contains(t, ','))::INT), 6) AS parse_failure_rate, round(avg((turn % 5 = 0)::INT), 6) AS think_leak_rate,
round(avg(regexp_matches(lower(t), '죄송|답변할 수 없|i cannot|i can''t|as an ai')::INT), 6) AS refusal_rate, round(avg(length(t)), 6) AS mean_completion_tokens FROM r GROUP BY 1, 2)"""
_NAMES = ("schema_validity_rate", "semantic_validity_rate", "parse_failure_rate", "think_leak_rate", "refusal_rate", "mean_completion_tokens")
_INNER = "trim(regexp_extract(coalesce(html, ''), '(?s)<{0}[^>]*>(.*?)</{0}>', 1), ' ')"
_HAS = "trim(regexp_replace({}, '\\s+', ' ', 'g'), ' ') <> ''"
SQL = {
    "reply_rates": f"WITH {_Q} SELECT * FROM q",
    "stage_averages": f"WITH {_Q} SELECT stage, {', '.join(f'round(avg({n}), 6) AS {n}' for n in _NAMES)} FROM q GROUP BY 1",
    "paired_replies": f"WITH {_R} SELECT a.stage AS stage_on, b.stage AS stage_off, count(*) AS n, count(*) FILTER (a.valid AND NOT b.valid) AS on_only, sum(length(a.t) - length(b.t))::BIGINT AS difference FROM r a JOIN r b USING (conv_id, pair) WHERE a.condition = 'on' AND b.condition = 'off' GROUP BY 1, 2",
    "determinism_of_runs": """SELECT lang, count(*) AS n, round(avg(same::INT), 6) AS identical_rate, round(avg((same OR doc_id % 7 = 0)::INT), 6) AS stripped_identical_rate, count(*) FILTER (NOT same) AS mismatches
FROM (SELECT lang, doc_id, text IS NULL OR (doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0) AS same FROM documents WHERE doc_id % 17 <> 0 AND lang IS NOT NULL) GROUP BY 1""",
    "first_rows_by_map": "SELECT lang, doc_id, rank::INT AS rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents) WHERE rank <= CASE lang WHEN 'de' THEN 2 WHEN 'en' THEN 7 WHEN 'fr' THEN 0 ELSE 5 END",
    "second_reading": f"""WITH p AS (SELECT page_id, {_INNER.format('title')} AS title, {_INNER.format('h2')} AS lead, {_INNER.format('h1')} AS title2, {_INNER.format('p')} AS lead2, regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g') AS t FROM pages),
f AS (SELECT *, {_HAS.format('title')} AS ht, {_HAS.format('lead')} AS hl, {_HAS.format('title2')} AS ht2, {_HAS.format('lead2')} AS hl2, length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) > 1.2 * length(regexp_replace(lead2, '[^A-Za-z]+', '', 'g')) AS rich FROM p),
g AS (SELECT *, NOT ht AND ht2 AS nt, NOT hl AND hl2 AS nl FROM f)
SELECT page_id, md5(CASE WHEN nt THEN title2 ELSE title END) AS title, md5(CASE WHEN nl THEN lead2 ELSE lead END) AS lead, concat_ws(',', CASE WHEN nt THEN 'title' END, CASE WHEN nl THEN 'lead' END) AS added, nt OR nl OR (NOT (ht AND hl) AND rich) AS adopted, (nt OR nl OR (NOT (ht AND hl) AND rich)) AND rich AS richer FROM g""",
}

"""Queries on flags, guards, records and round trips, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import checks, validation
from docloom.sources import outputs, records
from docloom.sources.matrices import scratch


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _page_fields(html):
    inner = lambda tag: F.trim(F.regexp_extract(html, f"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1))
    return {"title": inner("title"), "paragraph": inner("p")}


def native_quality(spark, d):
    """Pages whose title and first paragraph are there and whose text is long enough, also in Latin letters."""
    html = F.coalesce("html", F.lit(""))
    ok = checks.native_quality_ok(F.regexp_replace(html, "<[^>]*>", ""), *_page_fields(html).values(), letters="A-Za-z")
    return _t(spark, d, "pages").select("page_id", ok.alias("ok"))


def page_review(spark, d):
    """Why a page's fields should be looked at; a long paragraph is trusted less."""
    values = _page_fields(F.coalesce("html", F.lit("")))
    origins = {"title": F.lit("native"), "paragraph": F.when(F.length(values["paragraph"]) > 200, "other").otherwise("native")}
    r = _t(spark, d, "pages").select("page_id", checks.review(values, origins).alias("r"))
    return r.select("page_id", F.array_join("r.reasons", ", ").alias("reasons"), "r.needs_review", F.col("r.confidence")["paragraph"].alias("confidence"))


def kept_word_counts(spark, d):
    """Words of at least four letters that stand at a sentence's beginning, without the commonest: per language."""
    w = F.transform(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}]+"), lambda x: F.struct(F.lower(x).alias("term"), F.when(F.regexp_like(x, F.lit(r"^\p{Lu}")), "NNG").otherwise("X").alias("tag")))
    kept = _t(spark, d, "documents").select("lang", F.explode(checks.kept_terms(w, least=4, stopwords=("this", "that", "from", "dans"))).alias("term"))
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("term").alias("terms"))


def stage_records(spark, d):
    """Records made of documents whose lines stand for the fields."""
    line = lambda n: F.get(F.split("text", "\n", -1), F.lit(n))
    name = F.concat(F.coalesce("source", F.lit("none")), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".a.txt"))
    x = _t(spark, d, "documents").select("doc_id", checks.stage_record(name, line(0), line(1), line(2), line(3)).alias("r")).where("r.embedding_text <> ''")
    return x.select("doc_id", "r.id", "r.category", F.md5("r.embedding_text").alias("embedded"), F.md5(F.concat_ws("|", "r.overview", "r.occurred", "r.place")).alias("fields"))


def audit_payloads(spark, d):
    """What an auditor gets of each document."""
    p = checks.audit_payload(F.col("text"), source=F.col("source"), lang=F.col("lang"))
    x = _t(spark, d, "documents").where("text is not null").select("doc_id", p.alias("p"))
    return x.select("doc_id", F.md5(F.get_json_object("p", "$.text")).alias("text"), F.get_json_object("p", "$.fields.source").alias("source"), F.get_json_object("p", "$.fields.lang").alias("lang"))


def guarded_labels(spark, d):
    """Labels with their documents, none of which may be missing."""
    found = checks.joined_or_fail(_t(spark, d, "labels"), _t(spark, d, "documents").select("doc_id", "lang"), "doc_id", "document")
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"))


def cited_turns(spark, d):
    """A conversation's turns as causes that cite turns: what is wrong with them where only even turns may be cited."""
    turn = F.col("turn").cast("string")
    cause = F.struct("turn", F.when(F.col("role") == "system", "").otherwise(F.col("role")).alias("cause_name"), F.when(F.col("turn") % 3 == 0, "HIGH").otherwise("LOW").alias("support_level"), F.when(F.col("turn") % 4 > 0, F.array(turn)).alias("fact_ids"), F.array().cast("array<string>").alias("evidence_ids"))
    even = F.transform(F.sequence(F.lit(0), F.lit(50), F.lit(2)), lambda x: x.cast("string"))
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(cause)).alias("causes"))
    return c.select("conv_id", F.array_join(validation.cause_errors(F.col("causes"), even), " ").alias("errors"))


def attempts_in_turn(spark, d):
    """Documents shortened in turns until they are short enough: how many turns it takes."""
    docs = _t(spark, d, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    path = scratch(spark)
    kept = lambda df, name: (df.write.parquet(f"{path}/{name}"), spark.read.parquet(f"{path}/{name}"))[1]
    shorter = lambda by: lambda x: x.withColumn("left", F.floor(F.col("n") / by))
    out = validation.escalate(docs, "doc_id", [shorter(1), shorter(4), shorter(16)], F.col("left") <= 200, kept)
    return out.select("doc_id", "left", "attempts_used", "succeeded")


def json_and_csv_round_trip(spark, d):
    """Documents written as JSON lines, read, written as CSV and read again."""
    path = scratch(spark)
    records.write_json_lines(_t(spark, d, "documents").select("doc_id", "text", "lang"), f"{path}/a")
    read = records.read_json_lines(spark, f"{path}/a", "doc_id long, text string, lang string")
    records.write_csv(read.where(F.col(records.BAD).isNull()).select("doc_id", "text", "lang"), f"{path}/b")
    back = records.read_csv(spark, f"{path}/b", "doc_id long, text string, lang string")
    return back.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "lang")


def replaced_table(spark, d):
    """A table written, replaced, and what stands in its place and in its backup."""
    path = f"{scratch(spark)}/table"
    labels = _t(spark, d, "labels")
    outputs.replace_table(labels.where("quality = 0"), path)
    backup = outputs.replace_table(labels.where("quality = 1"), path)
    both = [spark.read.parquet(p).select("doc_id", F.lit(k).alias("where")) for k, p in (("now", path), ("backup", backup))]
    return both[0].union(both[1])


QUERIES = {f.__name__: f for f in (native_quality, page_review, kept_word_counts, stage_records, audit_payloads, guarded_labels, cited_turns, attempts_in_turn, json_and_csv_round_trip, replaced_table)}

_INNER = "trim(regexp_extract(coalesce(html, ''), '(?s)<{0}[^>]*>(.*?)</{0}>', 1), ' ')"
_BARE = "regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g')"
_HAS = "trim(regexp_replace({}, '\\s+', ' ', 'g'), ' ') <> ''"
SQL = {
    "native_quality": f"SELECT page_id, {_HAS.format(_INNER.format('title'))} AND {_HAS.format(_INNER.format('p'))} AND length(regexp_replace({_BARE}, '\\s+', '', 'g')) >= 300 AND length(regexp_replace({_BARE}, '[^A-Za-z]+', '', 'g')) >= 50 AS ok FROM pages",
    "page_review": f"""WITH p AS (SELECT page_id, {_INNER.format('title')} AS t, {_INNER.format('p')} AS p FROM pages), f AS (SELECT *, {_HAS.format('t')} AS has_t, {_HAS.format('p')} AS has_p FROM p)
SELECT page_id, concat_ws(', ', CASE WHEN NOT has_t THEN 'missing title' END, CASE WHEN NOT has_p THEN 'missing paragraph' END, CASE WHEN has_p AND length(p) > 200 THEN 'doubtful paragraph' END) AS reasons, NOT has_t OR NOT has_p OR length(p) > 200 AS needs_review, (CASE WHEN trim(p, ' ') = '' THEN 0.0 WHEN length(p) > 200 THEN 0.5 ELSE 1.0 END)::DOUBLE AS confidence FROM f""",
    "kept_word_counts": "SELECT lang, count(*) AS n, count(DISTINCT lower(w)) AS terms FROM (SELECT lang, unnest(regexp_split_to_array(coalesce(text, ''), '[^\\p{L}]+')) AS w FROM documents) WHERE regexp_matches(w, '^\\p{Lu}') AND length(w) >= 4 AND lower(w) NOT IN ('this', 'that', 'from', 'dans') GROUP BY 1",
    "stage_records": """WITH l AS (SELECT doc_id, coalesce(source, 'none') || '_' || doc_id || '.a' AS id, string_split(text, chr(10)) AS l FROM documents), f AS (SELECT doc_id, id, coalesce(l[1], '') AS a, coalesce(l[2], '') AS b, coalesce(l[3], '') AS c, coalesce(l[4], '') AS e FROM l)
SELECT doc_id, id, string_split(id, '_')[1] AS category, md5(CASE WHEN e <> '' THEN e ELSE a END) AS embedded, md5(a || '|' || b || '|' || c) AS fields FROM f WHERE CASE WHEN e <> '' THEN e ELSE a END <> ''""",
    "audit_payloads": "SELECT doc_id, md5(substr(text, 1, 7000)) AS text, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents WHERE text IS NOT NULL",
    "guarded_labels": "SELECT lang, count(*) AS n, sum(quality)::BIGINT AS good FROM labels JOIN documents USING (doc_id) GROUP BY 1",
    "cited_turns": """SELECT conv_id, coalesce(string_agg(e, ' ' ORDER BY turn, o), '') AS errors FROM (SELECT conv_id, turn, unnest([1, 2, 3]) AS o, unnest([CASE WHEN trim(coalesce(CASE WHEN role = 'system' THEN '' ELSE role END, ''), ' ') = '' THEN 'P02_EMPTY_CAUSE_NAME' END, CASE WHEN turn % 4 > 0 AND turn % 2 = 1 THEN 'P02_HALLUCINATED_SOURCE_ID' END, CASE WHEN turn % 3 = 0 AND turn % 4 = 0 THEN 'P02_UNSUPPORTED_HIGH_CONFIDENCE' END]) AS e FROM conversations) GROUP BY 1""",
    "attempts_in_turn": "SELECT doc_id, (n // CASE WHEN n <= 200 THEN 1 WHEN n // 4 <= 200 THEN 4 ELSE 16 END)::BIGINT AS \"left\", CASE WHEN n <= 200 THEN 1 WHEN n // 4 <= 200 THEN 2 ELSE 3 END::INT AS attempts_used, n // 16 <= 200 AS succeeded FROM (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents)",
    "json_and_csv_round_trip": "SELECT doc_id, length(coalesce(text, ''))::INT AS chars, md5(coalesce(text, '')) AS digest, lang FROM documents",
    "replaced_table": "SELECT doc_id, CASE quality WHEN 1 THEN 'now' ELSE 'backup' END AS \"where\" FROM labels WHERE quality IN (0, 1)",
}

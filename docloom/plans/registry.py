"""All queries outside the training-data subpackage, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import CONTROLS, MEANINGFUL, SPACES, is_refusal, quality, strip_reasoning
from docloom.operators.keywords import bm25, distinctive_words
from docloom.operators.paired import kappa, mcnemar, transitions
from docloom.operators.similarity import group_gap
from docloom.operators.tables import js_distance, last_before, pivot_counts, representatives, rollup_rates, segments
from docloom.plans import articles, calls, checks, extraction, fields, jsonwalk, matrices, narrative, pairs, passages, reports, runs


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def similarity_gap(spark, d):
    return group_gap(_t(spark, d, "embeddings"), "embedding", "label")


def keywords_distinctive(spark, d):
    return distinctive_words(_t(spark, d, "documents"), "lang", "text")


def retrieval_bm25(spark, d):
    return bm25(_t(spark, d, "documents"), _t(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")


def category_top3(spark, d):
    n = _t(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "source"))).where("rank <= 3")


def documents_left_labels(spark, d):
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


def duplicate_content(spark, d):
    h = _t(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return h.join(h.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1"), "sha256").select("doc_id", "sha256", "copies", "first_id")


def text_quality(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.round(quality(F.col("text")), 6).alias("quality"))


def conversation_flags(spark, d):
    c = _t(spark, d, "conversations")
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_refusal(F.col("text"))).alias("refusals"), F.count_if(strip_reasoning(F.col("text")) != F.trim("text")).alias("leaks"))


def paired_mcnemar(spark, d):
    return mcnemar(_t(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 1)


def paired_kappa(spark, d):
    return kappa(_t(spark, d, "labels"), F.col("quality"), F.col("toxic"))


def paired_transitions(spark, d):
    return transitions(_t(spark, d, "labels"), F.col("quality"), F.col("toxic"))


def compliance_rollup(spark, d):
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")
    return rollup_rates(docs, ["lang", "source"], F.col("quality") == 1)


def label_pivot(spark, d):
    return pivot_counts(_t(spark, d, "documents"), "source", "lang", ["de", "en", "es", "fr"])


def segment_bounds(spark, d):
    c = segments(_t(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user")
    return c.groupBy("conv_id", "segment").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


def asof_label_rows(spark, d):
    e = last_before(_t(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_id"), F.col("event_type") == "click", "click_id")
    return e.where("event_type <> 'click'").select("event_id", "click_id")


def label_representatives(spark, d):
    return representatives(_t(spark, d, "embeddings"), "vec_id", "label", "embedding")


def quality_source_distance(spark, d):
    return js_distance(_t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id"), "source", F.col("quality") == 1)


def json_props(spark, d):
    k = F.from_json("props", "k long").getField("k")
    return _t(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.min(k).alias("least"), F.max(k).alias("most"))


def first_n_per_group(spark, d):
    r = _t(spark, d, "documents").select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rank"))
    return r.where("rank <= 3")


FLAGSHIP = "keywords_distinctive"
QUERIES = {f.__name__: f for f in (similarity_gap, keywords_distinctive, retrieval_bm25, category_top3, documents_left_labels, duplicate_content, text_quality, conversation_flags, paired_mcnemar, paired_kappa, paired_transitions, compliance_rollup, label_pivot, segment_bounds, asof_label_rows, label_representatives, quality_source_distance, json_props, first_n_per_group)}

_W = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 2)"
_COUNT = "length(regexp_replace(text, '[{}]+', '', 'g'))"
_VISIBLE, _REPLACED, _CONTROLS = (_COUNT.format(x) for x in (SPACES + CONTROLS + r"\x{FFFD}", r"\x{FFFD}", CONTROLS))
SQL = {
    "text_quality": f"SELECT doc_id, round(greatest(0, least(1, 0.55 * {_COUNT.format('^' + MEANINGFUL)} / greatest({_VISIBLE}, 1) + 0.45 * least(1, ln(1 + {_VISIBLE}) / ln(1201)) - 1.5 * (length(text) - {_REPLACED}) / greatest(length(text), 1) - (length(text) - {_CONTROLS}) / greatest(length(text), 1))), 6) AS quality FROM documents",
    "compliance_rollup": "SELECT lang, source, n, passed, round(passed / n, 6) AS rate FROM (SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS passed FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, source))",
    "label_pivot": "SELECT source, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'es') AS es, count(*) FILTER (WHERE lang = 'fr') AS fr FROM documents GROUP BY 1",
    "segment_bounds": "SELECT conv_id, segment, min(turn) AS first_turn, max(turn) AS last_turn FROM (SELECT *, (count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS segment FROM conversations) GROUP BY 1, 2",
    "asof_label_rows": "SELECT event_id, click_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS click_id FROM events) WHERE event_type <> 'click'",
    "label_representatives": """WITH l AS (SELECT vec_id AS id, label AS grp, unnest(range(1, len(embedding) + 1)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT grp, d, avg(x) AS m FROM l GROUP BY 1, 2),
c AS (SELECT grp, id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) AS cosine FROM l JOIN m USING (grp, d) GROUP BY 1, 2)
SELECT grp, rank::INT AS rank, id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY cosine DESC, id) AS rank FROM c) WHERE rank <= 2""",
    "quality_source_distance": """WITH n AS (SELECT source, count(*) FILTER (WHERE quality = 1) AS a, count(*) FILTER (WHERE quality <> 1) AS b FROM documents JOIN labels USING (doc_id) GROUP BY 1),
p AS (SELECT a / (SELECT sum(a) FROM n) AS p, b / (SELECT sum(b) FROM n) AS q FROM n)
SELECT round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)), 6) AS distance FROM p""",
    "json_props": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, min(k) AS least, max(k) AS most FROM (SELECT event_type, (props->>'$.k')::BIGINT AS k FROM events) GROUP BY 1",
    "first_n_per_group": "SELECT source, doc_id, rank::INT AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 3",
    "similarity_gap": """WITH p AS (SELECT a.label = b.label AS same, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
SELECT count(*) FILTER (WHERE same) AS intra_n, count(*) FILTER (WHERE NOT same) AS inter_n, round(avg(s) FILTER (WHERE same), 6) AS intra_mean, round(avg(s) FILTER (WHERE NOT same), 6) AS inter_mean, round(avg(s) FILTER (WHERE same) - avg(s) FILTER (WHERE NOT same), 6) AS gap FROM p""",
    "keywords_distinctive": f"""WITH tf AS (SELECT grp, keyword, count(*) AS freq FROM (SELECT lang AS grp, unnest({_W}) AS keyword FROM documents) GROUP BY 1, 2),
s AS (SELECT grp, keyword, freq, round((freq / sum(freq) OVER (PARTITION BY grp)) / (sum(freq) OVER (PARTITION BY keyword) / sum(freq) OVER ()), 3) AS score FROM tf),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, freq DESC, keyword) AS rank FROM s WHERE freq >= 3)
SELECT grp, rank::INT AS rank, keyword, freq, score FROM r WHERE rank <= 20""",
    "retrieval_bm25": f"""WITH w AS (SELECT doc_id AS id, {_W} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
p AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM w) GROUP BY 1, 2, 3), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_W}) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT query_id, id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM p JOIN q USING (term) JOIN f USING (term), st GROUP BY 1, 2)
SELECT query_id, rank::INT AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""",
    "category_top3": "SELECT lang, source, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS rank FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)) WHERE rank <= 3",
    "documents_left_labels": "SELECT doc_id, lang, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "duplicate_content": "SELECT doc_id, sha256, copies, first_id FROM (SELECT doc_id, sha256(text) AS sha256, count(*) OVER (PARTITION BY text) AS copies, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents) WHERE copies > 1",
    "paired_mcnemar": "SELECT b, c, round(CASE WHEN b + c = 0 THEN 0 ELSE (abs(b - c) - 1) ** 2 / (b + c) END, 6) AS statistic FROM (SELECT count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS b, count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS c FROM labels)",
    "paired_transitions": "SELECT coalesce(quality::VARCHAR, 'NULL') AS label_off, coalesce(toxic::VARCHAR, 'NULL') AS label_on, count(*) AS n FROM labels GROUP BY 1, 2",
    "conversation_flags": """SELECT role, count(*) AS n, count(*) FILTER (WHERE regexp_matches(lower(text), '죄송|답변할 수 없|i cannot|i can''t|as an ai')) AS refusals,
count(*) FILTER (WHERE trim(split_part(regexp_replace(text, '(?s)<think>.*?</think>', '', 'g'), '<think>', 1)) <> trim(text)) AS leaks FROM conversations GROUP BY 1""",
    "paired_kappa": "SELECT n, round((same / n - pe) / (1 - pe), 6) AS kappa FROM (SELECT count(*) AS n, count(*) FILTER (WHERE quality = toxic) AS same, (count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE toxic = 1) + count(*) FILTER (WHERE quality = 0) * count(*) FILTER (WHERE toxic = 0)) / (count(*) * count(*)) AS pe FROM labels)",
}

for _module in (pairs, reports, narrative, jsonwalk, matrices, articles, calls, checks, runs):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
QUERIES |= passages.QUERIES
SQL |= passages.sql(SQL["split_sentences"])
QUERIES |= fields.QUERIES
SQL |= fields.sql(SQL["split_sentences"])
QUERIES |= extraction.QUERIES
SQL |= extraction.sql(SQL["split_sentences"])

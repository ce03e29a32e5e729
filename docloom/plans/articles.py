"""Queries on chunks, selections and encodings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import articles
from docloom.operators.paired import bootstrap
from docloom.operators.tables import interleaved
from docloom.sources import corpus

#: Where a chunk of the test documents begins, for they have no articles.
HEAD = "((?:the|der|que) [a-z]{3,})"
#: src1 has no hits and its first document stands in for it; nowhere has no documents at all.
KINDS, MOST, BUDGET = ("src3", "src1", "nowhere", "src12", "src7"), 7, 12_000


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def article_chunks(spark, d):
    """Every chunk of every document: where it stands, what it is called, what is kept of it."""
    x = _docs(spark, d).select("doc_id", F.posexplode(articles.chunks(F.col("text"), HEAD)).alias("pos", "c"))
    return x.select("doc_id", "pos", "c.article", "c.start", "c.end", F.md5("c.text").alias("digest"))


def grounding_select(spark, d):
    """Per language the documents that cover the sources, then the longest, under a budget."""
    docs = _docs(spark, d).select("doc_id", "lang", "source", F.length("text").alias("n")).where("text is not null and lang is not null")
    hits = docs.where("source <> 'src1'")
    first = docs.groupBy("source").agg(F.min(F.struct("doc_id", "n")).alias("x")).select("source", "x.*")
    return articles.grounding(hits, first, "lang", "source", "doc_id", "n", [F.desc("n"), "doc_id"], list(KINDS), MOST, BUDGET)


def decoded_texts(spark, d):
    """Texts from bytes: with a mark in front, in UTF-16LE, and cut in the middle."""
    raw = _docs(spark, d).select("doc_id", F.col("text").cast("binary").alias("b"), F.encode("text", "UTF-16LE").alias("w"))
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(bytes([0xEF, 0xBB, 0xBF])), "b")).otherwise(F.col("b"))
    x = raw.select("doc_id", corpus.decoded(marked).alias("d"), corpus.lenient(F.col("w"), "utf-16-le").alias("wide"), corpus.lenient(F.concat(F.col("b"), F.lit(bytes([0xC3])))).alias("cut"))
    return x.select("doc_id", "d.encoding", "d.error", F.md5(F.col("d.text")).alias("digest"), F.md5(F.col("wide")).alias("wide"), F.md5(F.col("cut")).alias("cut"))


def interleaved_rows(spark, d):
    """Clicks as labels among a user's other events: the order of all, and the event that each click opens."""
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    both = interleaved(e.where("event_type = 'click'"), e.where("event_type <> 'click'"), "user_id", "ts", "event_id")
    return both.select("user_id", "event_id", "is_label", "place", "opens")


def bootstrap_by_language(spark, d):
    """Per language the difference of mean lengths of good and bad documents, with its interval."""
    docs = _docs(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("quality is not null")
    good, n = F.col("quality") == 1, F.col("n_chars")
    parts = {"a": F.when(good, n), "na": good.cast("int"), "b": F.when(~good, n), "nb": (~good).cast("int")}
    out = bootstrap(docs, ["lang"], ["doc_id"], parts, lambda s: s["a"] / F.nullif(s["na"], F.lit(0.0)) - s["b"] / F.nullif(s["nb"], F.lit(0.0)), 500)
    return out.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("value", "low", "high")])


QUERIES = {f.__name__: f for f in (interleaved_rows, bootstrap_by_language, article_chunks, grounding_select, decoded_texts)}

_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
SQL = {
    "article_chunks": f"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '{HEAD}') AS m, regexp_split_to_array(text, '{HEAD.replace('((?:', '(?:(?:')}') AS p FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, m, p, unnest(range(len(m))) AS pos FROM t),
c AS (SELECT doc_id, pos, m[pos + 1] AS article, m[pos + 1] || p[pos + 2] AS chunk, length(p[1]) + coalesce(sum(length(m[pos + 1] || p[pos + 2])) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM r)
SELECT doc_id, pos::INT AS pos, article, start::INT AS start, (start + length(chunk))::INT AS "end", md5(substr({_TRIM.format('chunk')}, 1, 1200)) AS digest FROM c
UNION ALL SELECT doc_id, 0, '전문', 0, length(text)::INT, md5(substr(text, 1, 2000)) FROM t WHERE len(m) = 0""",
    "grounding_select": f"""WITH a AS (SELECT doc_id, lang, source, length(text) AS n FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, doc_id) AS rank FROM a WHERE source <> 'src1') WHERE rank <= 30),
w AS (SELECT DISTINCT l.lang, v.place, v.source FROM (SELECT DISTINCT lang FROM h) l, (VALUES {', '.join(f"({i}, '{k}')" for i, k in enumerate(KINDS))}) v(place, source)),
f AS (SELECT source, min(doc_id) AS doc_id, arg_min(n, doc_id) AS n FROM a GROUP BY 1), b AS (SELECT lang, source, arg_min(doc_id, rank) AS doc_id, arg_min(n, rank) AS n FROM h GROUP BY 1, 2),
c AS (SELECT * FROM (SELECT w.lang, w.source, place, coalesce(b.doc_id, f.doc_id) AS doc_id, sum(least(coalesce(b.n, f.n), 1800)) OVER (PARTITION BY w.lang ORDER BY place) AS spent FROM w LEFT JOIN b USING (lang, source) LEFT JOIN f ON f.source = w.source WHERE coalesce(b.doc_id, f.doc_id) IS NOT NULL) WHERE spent <= {BUDGET}),
s AS (SELECT lang, max(spent) AS spent, count(*) AS taken FROM c GROUP BY 1),
r AS (SELECT * FROM (SELECT h.*, coalesce(taken, 0) AS taken, coalesce(spent, 0) + sum(least(n, 2800)) OVER (PARTITION BY h.lang ORDER BY rank) AS upto, row_number() OVER (PARTITION BY h.lang ORDER BY rank) AS nth FROM h LEFT JOIN s USING (lang) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = h.lang AND c.doc_id = h.doc_id)) WHERE upto <= {BUDGET} AND nth <= greatest({MOST} - taken, 1))
SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY pass, o))::INT AS place, doc_id, source, covers FROM (SELECT lang, 0 AS pass, place AS o, doc_id, source, true AS covers FROM c UNION ALL SELECT lang, 1, rank, doc_id, source, false FROM r)""",
    "interleaved_rows": """WITH l AS (SELECT * FROM events WHERE event_type = 'click'), b AS (SELECT user_id, ts, min(event_id) AS event_id FROM events WHERE event_type <> 'click' GROUP BY 1, 2),
o AS (SELECT l.event_id, b.event_id AS opens FROM l ASOF LEFT JOIN b ON l.user_id = b.user_id AND l.ts <= b.ts)
SELECT user_id, e.event_id, event_type = 'click' AS is_label, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type <> 'click', e.event_id))::INT AS place, opens FROM events e LEFT JOIN o ON o.event_id = e.event_id WHERE event_type IS NOT NULL""",
    "decoded_texts": """SELECT doc_id, CASE WHEN text IS NOT NULL AND (text <> '' OR doc_id % 3 = 0) THEN 'utf-8-sig' END AS encoding, CASE WHEN text = '' AND doc_id % 3 <> 0 THEN 'empty' END AS error, CASE WHEN text <> '' OR doc_id % 3 = 0 THEN md5(text) END AS digest, md5(text) AS wide, md5(text || chr(65533)) AS cut FROM documents""",
}

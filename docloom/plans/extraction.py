"""Queries on labelled fields, tiers, schemas, codes, variants and manifests, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import extraction, validation
from docloom.operators.sentences import sentences
from docloom.sources import outputs

#: Labels and headings of the test documents, which have no labels of their own: two words that stand together.
RULES = {"one": ("ofthe", "de la", "der die"), "two": ("and the", "la de")}
HEADINGS = ("the", "un", "ein")
WORDS = extraction.Layout(rules=tuple(extraction.Rule(k, a) for k, a in RULES.items()), headings=HEADINGS)
SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 90, "multipleOf": 2}}, "additionalProperties": False}
KNOWN = ("the", "of", "and", "de", "la", "der", "die")


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def labelled_fields(spark, d):
    """Per document and field: number and digest of its sentences."""
    two = lambda c, digits: F.length(c) >= 2
    parts = _t(spark, d, "documents").select("doc_id", sentences(F.coalesce("text", F.lit(""))).alias("parts"))
    rows = parts.select("doc_id", F.inline(F.array(*[F.struct(F.lit(r.label).alias("label"), extraction.collect(F.col("parts"), r, WORDS, two).alias("found")) for r in WORDS.rules])))
    return rows.select("doc_id", "label", F.size("found").alias("n"), F.md5(F.array_join("found", "|")).alias("digest"))


def tiered_page_text(spark, d):
    """What a page says, by tiers: its first paragraph, its title, all its text; the first of enough characters."""
    html = F.coalesce("html", F.lit(""))
    inner = lambda tag: F.trim(F.regexp_extract(html, f"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1))
    tiers = {"paragraph": inner("p"), "title": inner("title"), "text": F.trim(F.regexp_replace(html, "<[^>]*>", ""))}
    x = _t(spark, d, "pages").select("page_id", extraction.tiered(tiers, {n: F.length(c) >= least for (n, c), least in zip(tiers.items(), (200, 60, 20))}).alias("r"))
    known = {"paragraph": 1.0, "title": 0.75}
    return x.select("page_id", F.md5("r.value").alias("digest"), "r.origin", "r.tried", extraction.confidence(F.col("r.value"), F.col("r.origin"), F.col("r.tried") == 3, known).alias("trust"))


def schema_faults(spark, d):
    """Properties of events that their schema doesn't allow."""
    return _t(spark, d, "events").select("event_id", F.array_join(validation.schema_errors(F.col("props"), SCHEMA), "; ").alias("faults"))


def code_faults(spark, d):
    """Words of a document as codes: how many are blank, known or neither."""
    codes = F.split(F.coalesce("text", F.lit("")), " ")
    r = validation.code_errors(codes, F.array(*[F.lit(x) for x in KNOWN]))
    return _t(spark, d, "documents").select("doc_id", r.alias("r")).select("doc_id", "r.total", "r.good", "r.empty", "r.unknown", F.size("r.errors").alias("faults"))


def marked_variants(spark, d):
    """Pages with and without their scripts, where the marks are paired."""
    v = validation.variants(F.col("html"), "<script>", "</script>")
    return _t(spark, d, "pages").select("page_id", v.alias("v")).select("page_id", F.md5("v.on").alias("with_blocks"), F.md5("v.off").alias("without"), "v.blocks")


def canonical_positions(spark, d):
    """Positions written loosely, in one form, and whether they can't be."""
    e = F.col("event_id")
    c = F.format_string("- 북위 %d도 %d분 %d%% · %dm %d분 %d초 (해상)", e % 90, e % 61, e % 71, e % 180, e % 59, e % 53)
    place = extraction.canonical_place(c)
    return _t(spark, d, "events").select("event_id", place.alias("place"), extraction.position_suspect(place).alias("suspect"))


def text_manifest(spark, d):
    """Counts of the documents; the digest has no SQL."""
    return outputs.manifest(_t(spark, d, "documents"), "text").drop("digest")


QUERIES = {f.__name__: f for f in (labelled_fields, tiered_page_text, schema_faults, code_faults, marked_variants, canonical_positions, text_manifest)}


def sql(split: str) -> dict[str, str]:
    """split: the SQL of all sentences."""
    u = "0-9A-Za-z가-힣"
    loose = lambda a: f"[^{u}]*".join(a.replace(" ", ""))
    begins = f"(?si)^[^{u}]*(?:{'|'.join(loose(a) for a in dict.fromkeys([a for r in RULES.values() for a in r] + list(HEADINGS)))})"
    tail = lambda a: f"CASE WHEN regexp_matches(sentence, '(?si)(?:^|[^{u}]){loose(a)}(?:$|[^{u}])') THEN regexp_replace(sentence, '(?si)^.*?(?:^|[^{u}]){loose(a)}($|[^{u}])', '\\1') END"
    tails = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, pos, sentence, coalesce({', '.join(tail(a) for a in names)}) AS tail FROM s" for label, names in RULES.items())
    inner = lambda tag: f"trim(regexp_extract(coalesce(html, ''), '(?s)<{tag}[^>]*>(.*?)</{tag}>', 1), ' ')"
    known = ", ".join(f"'{x}'" for x in KNOWN)
    return {
        "labelled_fields": f"""WITH s AS ({split}), t AS ({tails}),
f AS (SELECT doc_id, label, min(pos) AS first, arg_min(tail, pos) AS tail FROM t WHERE tail IS NOT NULL GROUP BY 1, 2),
i AS (SELECT *, regexp_replace(trim(regexp_replace(tail, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' '), '^[\\s:,\\-]+', '') AS said FROM f),
j AS (SELECT *, regexp_matches(said, '{begins}') AS stops FROM i),
e AS (SELECT j.doc_id, label, min(pos) AS stop FROM j JOIN s ON s.doc_id = j.doc_id AND s.pos > j.first AND regexp_matches(s.sentence, '{begins}') GROUP BY 1, 2),
c AS (SELECT doc_id, label, first AS pos, said AS chunk FROM j WHERE NOT stops
 UNION ALL SELECT j.doc_id, j.label, s.pos, s.sentence FROM j JOIN s ON s.doc_id = j.doc_id AND s.pos > j.first LEFT JOIN e ON e.doc_id = j.doc_id AND e.label = j.label WHERE NOT j.stops AND (e.stop IS NULL OR s.pos < e.stop)),
m AS (SELECT * FROM c WHERE length(chunk) >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY pos) <= 12),
d AS (SELECT doc_id, label, chunk, min(pos) AS pos FROM m GROUP BY 1, 2, 3),
g AS (SELECT doc_id, label, count(*) AS n, md5(string_agg(chunk, '|' ORDER BY pos)) AS digest FROM d GROUP BY 1, 2)
SELECT doc_id, label, coalesce(n, 0)::INT AS n, coalesce(digest, md5('')) AS digest FROM documents CROSS JOIN (VALUES {', '.join(f"('{x}')" for x in RULES)}) l(label) LEFT JOIN g USING (doc_id, label)""",
        "tiered_page_text": f"""WITH t AS (SELECT page_id, {inner('p')} AS a, {inner('title')} AS b, trim(regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g'), ' ') AS c FROM pages),
k AS (SELECT *, CASE WHEN length(a) >= 200 THEN 1 WHEN length(b) >= 60 THEN 2 WHEN length(c) >= 20 OR c <> '' THEN 3 WHEN b <> '' THEN 2 WHEN a <> '' THEN 1 END AS o, CASE WHEN length(a) >= 200 THEN 1 WHEN length(b) >= 60 THEN 2 ELSE 3 END AS tried FROM t)
SELECT page_id, md5(CASE o WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN c END) AS digest, CASE o WHEN 1 THEN 'paragraph' WHEN 2 THEN 'title' WHEN 3 THEN 'text' END AS origin, tried::INT AS tried,
CASE WHEN o IS NULL THEN 0.0 ELSE least(CASE o WHEN 1 THEN 1.0 WHEN 2 THEN 0.75 ELSE 0.5 END, CASE WHEN tried = 3 THEN 0.4 ELSE 1.0 END) END::DOUBLE AS trust FROM k""",
        "schema_faults": """SELECT event_id, CASE WHEN props IS NULL THEN NULL ELSE concat_ws('; ', CASE WHEN k < 10 THEN '["k"]: is less than 10' END, CASE WHEN k > 90 THEN '["k"]: is more than 90' END, CASE WHEN k % 2 <> 0 THEN '["k"]: is not a multiple of 2' END, CASE WHEN k IS NULL THEN '[]: lacks k' END) END AS faults
FROM (SELECT event_id, props, (props->>'$.k')::BIGINT AS k FROM events)""",
        "code_faults": f"""WITH w AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents),
n AS (SELECT doc_id, len(w)::INT AS total, len(list_filter(w, lambda x: trim(x, ' ') = ''))::INT AS empty, len(list_filter(w, lambda x: x IN ({known})))::INT AS good FROM w)
SELECT doc_id, total, good, empty, total - good - empty AS "unknown", total - good AS faults FROM n""",
        "marked_variants": """WITH m AS (SELECT page_id, html, len(regexp_extract_all(html, '<script>')) AS n, len(regexp_extract_all(html, '</script>')) AS e, regexp_replace(html, '(?s)<script>\\n?(.*?)</script>\\n?', '\\1', 'g') AS o FROM pages),
k AS (SELECT *, coalesce(n > 0 AND n = e AND NOT contains(o, '<script>') AND NOT contains(o, '</script>'), false) AS good FROM m)
SELECT page_id, CASE WHEN good THEN md5(o) END AS with_blocks, CASE WHEN good THEN md5(regexp_replace(html, '(?s)<script>\\n?(.*?)</script>\\n?', '', 'g')) END AS without, CASE WHEN good THEN n::INT END AS blocks FROM k""",
        "canonical_positions": """SELECT event_id, printf('북위 %d도 %d분 %d초 동경 %d도 %d분 %d초 (해상)', event_id % 90, event_id % 61, event_id % 71, event_id % 180, event_id % 59, event_id % 53) AS place,
greatest(event_id % 61, event_id % 71, event_id % 59, event_id % 53) > 59 AS suspect FROM events""",
        "text_manifest": "SELECT count(*) AS rows, (SELECT count(*)::INT FROM (DESCRIBE SELECT * FROM documents)) AS columns, coalesce(sum(strlen(text)), 0)::BIGINT AS bytes, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM documents",
    }

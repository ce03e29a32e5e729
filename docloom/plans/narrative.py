"""Queries on lines of texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import narrative
from docloom.operators.extraction import lines

#: The test documents have no sections, so frequent words stand for the labels. Each is as it would be in a report: one line can be a neighbour's label alone.
WORDS = narrative.Account(label="the|de", neighbours=("and", "la"), order="in", headings=("whst", "ungen", "oning"), margin=("the", "un"), least=6, opening=r"[a-z]+ion\s+[a-z]{2}")
SUMMARY = narrative.Summary(ways=((r"the", "", ("of", "in")), (r"la", "ion", (r"\.", ","))), noise=("oning",), lead="and", block="der", block_ends=("die", "und"))


def narrative_account(spark, d):
    """Per document the account that its lines give."""
    x = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", narrative.account(lines(F.col("text")), WORDS).alias("x"))
    return x.select("doc_id", F.length("x").alias("chars"), F.md5("x").alias("digest"))


def text_overview(spark, d):
    """Per document its overview, by the first way that finds one."""
    x = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", narrative.overview(F.col("text"), SUMMARY).alias("x"))
    return x.select("doc_id", F.length("x").alias("chars"), F.md5("x").alias("digest"))


QUERIES = {f.__name__: f for f in (narrative_account, text_overview)}


def _clean(x: str) -> str:
    squeezed = f"trim(regexp_replace({x}, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')"
    return f"trim(regexp_replace(regexp_replace({squeezed}, '^[\\s:：ㆍ·|□\\[\\]\\-ㅇ○]+', ''), '^[가-하]\\.\\s*', ''), ' ')"


def _margin(x: str) -> str:
    x = _clean(x)
    for w in WORDS.margin:
        x = f"regexp_replace({x}, '^{narrative.loose(w)}\\s+', '')"
    return _clean(x)


_HEAD, _ALONE, _ORDER = narrative.loose(*WORDS.headings), narrative.loose(*WORDS.neighbours), narrative.loose(WORDS.order)


def _way(opens: str, closes: str, follows: tuple[str, ...]) -> str:
    found = _clean(f"regexp_extract(x, '{opens}\\s*(.*?{closes})\\s*(?:{'|'.join(follows)})', 1)")
    led = f"regexp_replace({found}, '^{narrative.loose(SUMMARY.lead)}\\s*', '')"
    return f"nullif({_clean(f"regexp_replace({led}, '{narrative.loose(*SUMMARY.noise)}', ' ', 'g')")}, '')"


_OVERVIEW = [_way(*way) for way in SUMMARY.ways]
_BLOCK = _clean(f"regexp_replace(regexp_extract(x, '{narrative.loose(SUMMARY.block)}(.*)', 1), '□?\\s*{narrative.loose(*SUMMARY.block_ends)}.*$', '')")

SQL = {
    "narrative_account": f"""WITH r AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS pos FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n') AS x FROM documents)),
l AS (SELECT doc_id, pos, trim(regexp_replace(line, '[ \\t]+', ' ', 'g'), ' ') AS line FROM r),
b AS (SELECT doc_id, min(pos) AS begin FROM l WHERE line <> '' AND regexp_matches(line, '{WORDS.label}') GROUP BY 1),
i AS (SELECT doc_id, pos, pos = begin AS first, CASE WHEN pos = begin THEN {_margin(f"regexp_replace(line, '(?s)^.*?(?:{WORDS.label})', '')")} ELSE line END AS c FROM l JOIN b USING (doc_id) WHERE line <> '' AND pos >= begin),
f AS (SELECT *, regexp_matches(c, '^{_ALONE}$') AS alone, NOT first AND regexp_matches(c, '^{_ORDER}$') AS ordered, regexp_matches(c, '{_HEAD}') AS head FROM i),
s AS (SELECT *, CASE WHEN alone OR ordered THEN '' WHEN head AND first THEN {_clean(f"regexp_replace(c, '(?s){_HEAD}.*$', '')")} WHEN head THEN {_margin(f"regexp_replace(c, '(?s){_HEAD}.*$', '')")} ELSE {_margin('c')} END AS said FROM f),
t AS (SELECT doc_id, min(pos) AS told FROM s WHERE length(said) >= {WORDS.least} AND NOT regexp_matches(said, '^{_HEAD}$') GROUP BY 1),
e AS (SELECT doc_id, min(pos) AS stop FROM s JOIN t USING (doc_id) WHERE NOT alone AND (ordered OR head) AND pos >= told GROUP BY 1),
a AS (SELECT doc_id, {_clean("string_agg(said, ' | ' ORDER BY pos) FILTER (WHERE said <> '')")} AS x FROM s LEFT JOIN e USING (doc_id) WHERE stop IS NULL OR pos <= stop GROUP BY 1),
o AS (SELECT doc_id, CASE WHEN regexp_matches(x, '{WORDS.opening}') THEN {_clean(f"substr(x, strpos(x, regexp_extract(x, '{WORDS.opening}')))")} ELSE x END AS x FROM a)
SELECT doc_id, length(coalesce(x, ''))::INT AS chars, md5(coalesce(x, '')) AS digest FROM documents LEFT JOIN o USING (doc_id)""",
    "text_overview": f"""WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ') AS x FROM documents),
b AS (SELECT doc_id, {', '.join(f'{w} AS way{i}' for i, w in enumerate(_OVERVIEW))}, {_BLOCK} AS block FROM t),
o AS (SELECT doc_id, coalesce(way0, way1, CASE WHEN length(regexp_replace(block, '\\s+', '', 'g')) >= {SUMMARY.least} THEN '{SUMMARY.block}: ' || block END, '') AS x FROM b)
SELECT doc_id, length(x)::INT AS chars, md5(x) AS digest FROM o""",
}

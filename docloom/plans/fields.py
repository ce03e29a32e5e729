"""Queries on formats, fields, flags and selections, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.operators import fields
from docloom.operators.sentences import sentences
from docloom.sources.records import last_of_each

ALLOWED = ["de", "en", "fr", "it"]
PATTERNS = ["SRC1", "rc7"]
FAMILIES = {"src1": "one", "src2": "two", "rc": "any"}


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def page_formats(spark, d):
    p = _t(spark, d, "pages")
    return p.select("page_id", fields.extension_lower(F.col("url")).alias("extension"), fields.detect_format(F.col("html").cast("binary"), F.col("url")).alias("format"))


def meaningful_texts(spark, d):
    return _t(spark, d, "documents").select("doc_id", fields.is_meaningful(F.col("text"), letters="é-ü").alias("meaningful"), fields.language_drift(F.col("text")).alias("drift"))


def runaway_replies(spark, d):
    c, l = _t(spark, d, "documents"), _t(spark, d, "labels")
    flag = fields.is_runaway(F.col("quality") == 1, F.col("toxic") == 0, F.col("n_chars"), 2000, F.length("text") < 20)
    return c.join(l, "doc_id").select("doc_id", flag.alias("runaway"))


def clean_pair_means(spark, d):
    """Mean length over clean pairs and, for contrast, over all."""
    x = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")
    clean = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return x.groupBy("lang").agg(F.count_if(clean).alias("clean_n"), F.count(F.lit(1)).alias("all_n"), F.round(F.avg(F.when(clean, F.col("n_chars"))), 6).alias("clean_mean"), F.round(F.avg("n_chars"), 6).alias("all_mean"))


def failures(spark, d):
    """What isn't known to be good, unlabelled documents included."""
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left").where(~F.coalesce(F.col("quality") == 1, F.lit(False))).select("doc_id")


def excluded_names(spark, d):
    return _t(spark, d, "documents").where(fields.excludes(F.col("source"), PATTERNS)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def log_lines(spark, d):
    """Lines of conversations without terminal escapes, known noise and blanks."""
    x = _t(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    x = x.withColumn("line", fields.without_escapes(F.concat(F.lit("\x1b[1;31m"), F.col("line"), F.lit("\x1b[0m"))))
    return x.where(~F.col("line").rlike("^(Warning|INFO)") & (F.trim("line") != "")).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


def source_label_sets(spark, d):
    out = fields.label_sets(_t(spark, d, "documents"), "source", "lang", ALLOWED)
    return out.select("source", "subset", *[F.array_join(c, ",").alias(c) for c in ("labels", "unknown", "missing", "common", "every")])


def field_merge_tiers(spark, d):
    """The first of three sources that isn't blank, and which it was."""
    x = _t(spark, d, "documents").join(_t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left")
    native = F.when(F.col("lang") == "en", F.substring("text", 1, 20))
    return x.select("doc_id", fields.first_filled(native=native, page=F.col("url"), source=F.col("source")).alias("f")).select("doc_id", "f.value", "f.origin")


def last_turn_join(spark, d):
    """Documents with the last turn of the conversation of that number."""
    last = last_of_each(_t(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")
    return _t(spark, d, "documents").join(last, F.col("doc_id") == F.col("conv_id")).select("doc_id", "turn", "role")


def sampled_texts(spark, d):
    """Three ids a source; those with a blank text keep their id."""
    docs = _t(spark, d, "documents")
    ids = docs.select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("r")).where("r <= 3").drop("r")
    return ids.join(docs.where(F.trim("text") != "").select("doc_id", F.length("text").alias("chars")), "doc_id", "left")


def grouped_keywords(spark, d):
    """Documents with the labels of their source, empty where there are none."""
    k = _t(spark, d, "documents").where("lang = 'de'").groupBy("source").agg(F.array_sort(F.collect_set(F.col("doc_id") % 7)).alias("keys"))
    x = _t(spark, d, "documents").where("doc_id % 10 = 1").join(k, "source", "left")
    return x.select("doc_id", F.array_join(F.coalesce("keys", F.array().cast("array<bigint>")), ",").alias("keys"))


def cited_sentences(spark, d):
    """Sentences of every document, numbered S01, S02, ..."""
    s = _t(spark, d, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("i", "sentence"))
    return s.select("doc_id", F.format_string("S%02d", F.col("i") + 1).alias("cite"), F.length("sentence").alias("chars"))


def source_ranking(spark, d):
    """Sources by mean length, the best first, and whether all their documents have a text."""
    x = _t(spark, d, "documents").groupBy("source").agg(F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_pop("n_chars"), 6).alias("std"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.bool_and(F.length("text") > 1).alias("all_ok"))
    return x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), "source")))


def transition_totals(spark, d):
    same = F.count_if(F.col("quality") == F.col("toxic"))
    return _t(spark, d, "labels").agg(same.alias("same"), (F.count(F.lit(1)) - same).alias("changed"))


def token_difference(spark, d):
    """Characters of both roles by conversation, their difference in percent, and a warning over 10."""
    size = lambda role: F.sum(F.when(F.col("role") == role, F.length("text")))
    x = _t(spark, d, "conversations").groupBy("conv_id").agg(size("assistant").alias("on"), size("user").alias("off"))
    pct = F.when(F.col("off") > 0, F.round((F.col("on") - F.col("off")) / F.col("off") * 100, 4))
    return x.select("conv_id", pct.alias("pct"), F.coalesce(F.abs(pct) > 10, F.lit(False)).alias("warn"))


def retry_counts(spark, d):
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left").groupBy("lang").agg(F.count_if(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("succeeded"), F.count_if(~F.coalesce(F.col("quality") == 1, F.lit(False))).alias("exhausted"))


def part_counts(spark, d):
    """Words of every document; none where there is no text."""
    words = F.filter(F.split("text", " ", -1), lambda w: w != "")
    return _t(spark, d, "documents").select("doc_id", F.coalesce(F.size(words), F.lit(0)).alias("words"), F.size(F.array_distinct(F.coalesce(words, F.array().cast("array<string>")))).alias("different"))


def contribution_scores(spark, d):
    n = F.col("doc_id")
    parts = {name: (n % k % 5).cast("double") for name, k in zip(fields.CONTRIBUTION, (7, 11, 13, 17, 19), strict=True)}
    return _t(spark, d, "documents").select("doc_id", F.round(fields.contribution(**parts), 6).alias("score"))


def distinct_sentences(spark, d):
    """Sentences of a document without repeats, in order of first occurrence."""
    s = F.array_distinct(sentences(F.col("text")))
    return _t(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(s).alias("pos", "sentence"))


def corpus_totals(spark, d):
    return _t(spark, d, "documents").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("source").alias("categories"), F.sum(F.octet_length("text")).alias("bytes"), F.sum("n_chars").alias("chars"))


def next_segment_start(spark, d):
    """A segment ends before the next user turn; the last has no end."""
    u = _t(spark, d, "conversations").where("role = 'user'")
    return u.select("conv_id", F.col("turn").alias("start"), (F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("end"))


def previous_output(spark, d):
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return _t(spark, d, "conversations").select("conv_id", "turn", F.lag(F.length("text")).over(w).alias("previous"))


def cause_ranking(spark, d):
    """The first source of each language by documents, and the others in order."""
    x = _t(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "source"))).alias("s"))
    names = F.transform("s", lambda c: c["source"])
    return x.select("lang", F.get(names, F.lit(0)).alias("first"), F.array_join(F.slice(names, 2, 1000000), ",").alias("others"))


def coverage_select(spark, d):
    """Per language documents within a budget of characters: one of each source first, then by length."""
    x = _t(spark, d, "documents").select("lang", "source", "doc_id", "n_chars")
    return fields.within_budget(x, "lang", "source", [F.desc("n_chars"), "doc_id"], F.col("n_chars"), 40_000, 90_000, 30).select("lang", "doc_id", "rank", "covers")


def numeric_order(spark, d):
    """Sources by the number in their name."""
    s = _t(spark, d, "documents").select("source").distinct()
    n = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    return s.select("source", F.row_number().over(Window.orderBy(n, "source")).alias("rank"))


def unit_vectors(spark, d):
    v = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) + 1e-9
    return _t(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(F.transform(v, lambda x: x / norm), F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"), F.round(F.element_at(v, 1) / norm, 6).alias("first"))


def source_families(spark, d):
    return _t(spark, d, "documents").select("source", fields.model_family(F.col("source"), FAMILIES).alias("family")).distinct()


def shown_numbers(spark, d):
    x = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    return x.groupBy("source").agg(fields.number_text(F.avg("quality"), 3).alias("quality"), fields.number_text(F.max(F.when(F.col("toxic") == 5, 1.0)), 2).alias("never"))


def unescaped_paragraphs(spark, d):
    """Paragraphs of pages, unescaped and joined by blank lines."""
    p = F.filter(F.regexp_extract_all("html", F.lit("(?s)<p[^>]*>(.*?)</p>"), 1), lambda x: F.trim(x) != "")
    return _t(spark, d, "pages").select("page_id", F.md5(F.array_join(F.transform(p, fields.unescape_xml), "\n\n").cast("binary")).alias("md5"))


def date_extract(spark, d):
    e = _t(spark, d, "events").select("event_id", F.date_format("ts", "'on 'yyyy. M.d.HH.':'m 'KST'").alias("t"))
    return e.select("event_id", fields.fuzzy_date(F.col("t")).alias("date"))


def coord_check(spark, d):
    e = F.col("event_id")
    c = F.format_string("북위 %d도 %d분 %d초", e % 90, e % 61, e % 71)
    return _t(spark, d, "events").groupBy(fields.coordinate_suspect(c).alias("suspect")).agg(F.count(F.lit(1)).alias("n"))


def row_grouping(spark, d):
    """Events of a user as boxes at y = value: how many rows they form."""
    items = F.array_sort(F.collect_list(F.struct(F.round("value", 3).alias("y"), (10 + F.col("event_id") % 5).cast("double").alias("height"), "event_id")))
    x = _t(spark, d, "events").where("value is not null").groupBy("user_id").agg(items.alias("boxes"))
    return x.select("user_id", F.size("boxes").alias("items"), (F.array_max(fields.rows_by_height(F.col("boxes"))) + 1).alias("rows"))


def column_gutter(spark, d):
    g = fields.gutter(_t(spark, d, "events"), "user_id", "value")
    return g.select("user_id", F.round("gutter", 6).alias("gutter"))


QUERIES = {f.__name__: f for f in (page_formats, meaningful_texts, runaway_replies, clean_pair_means, failures, excluded_names, log_lines, source_label_sets, field_merge_tiers, last_turn_join, sampled_texts, grouped_keywords, cited_sentences, source_ranking, transition_totals, token_difference, retry_counts, part_counts, contribution_scores, distinct_sentences, corpus_totals, next_segment_start, previous_output, cause_ranking, coverage_select, numeric_order, unit_vectors, source_families, shown_numbers, unescaped_paragraphs, date_extract, coord_check, row_grouping, column_gutter)}


def sql(split: str) -> dict[str, str]:
    """split: the SQL of all sentences."""
    j = lambda c: f"array_to_string(list_sort({c}), ',')"
    allowed = "['de', 'en', 'fr', 'it']"
    return {
        "page_formats": "SELECT page_id, lower(regexp_extract(url, '\\.([^./\\\\]*)$', 1)) AS extension, CASE WHEN starts_with(html, '%PDF-') THEN 'pdf' WHEN starts_with(html, 'PK' || chr(3) || chr(4)) THEN 'hwpx' WHEN lower(regexp_extract(url, '\\.([^./\\\\]*)$', 1)) IN ('pdf', 'hwp', 'hwpx') THEN lower(regexp_extract(url, '\\.([^./\\\\]*)$', 1)) END AS format FROM pages",
        "meaningful_texts": "SELECT doc_id, coalesce(length(text) >= 2 AND (regexp_matches(text, '[é-ü]') OR length(regexp_replace(text, '[^0-9]+', '', 'g')) >= 6), false) AS meaningful, coalesce(length(regexp_replace(text, '\\s+', '', 'g')) >= 15 AND contains(trim(text), ' ') AND length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) >= 0.6 * length(regexp_replace(text, '\\s+', '', 'g')), false) AS drift FROM documents",
        "runaway_replies": "SELECT doc_id, coalesce(quality <> 1 AND toxic <> 0 AND n_chars >= 1900, false) OR coalesce(length(text) < 20, false) AS runaway FROM documents JOIN labels USING (doc_id)",
        "clean_pair_means": "SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS clean_n, count(*) AS all_n, round(avg(n_chars) FILTER (WHERE quality = 1 AND toxic = 0), 6) AS clean_mean, round(avg(n_chars), 6) AS all_mean FROM documents JOIN labels USING (doc_id) GROUP BY 1",
        "failures": "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 1",
        "excluded_names": "SELECT source, count(*) AS n FROM documents WHERE NOT contains(lower(source), 'src1') AND NOT contains(lower(source), 'rc7') GROUP BY 1",
        "log_lines": "SELECT conv_id, turn, count(*) AS n, sum(length(line))::BIGINT AS chars FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations) WHERE NOT regexp_matches(line, '^(Warning|INFO)') AND trim(line, ' ') <> '' GROUP BY 1, 2",
        "source_label_sets": f"SELECT source, len(list_filter(l, lambda x: NOT list_contains({allowed}, x))) = 0 AS subset, {j('l')} AS labels, {j(f'list_filter(l, lambda x: NOT list_contains({allowed}, x))')} AS \"unknown\", {j(f'list_filter({allowed}, lambda x: NOT list_contains(l, x))')} AS missing, {j(f'list_filter(l, lambda x: list_contains({allowed}, x))')} AS common, {j(f'list_distinct(list_concat(l, {allowed}))')} AS every FROM (SELECT source, list(DISTINCT lang) FILTER (WHERE lang IS NOT NULL) AS l FROM documents GROUP BY 1)",
        "field_merge_tiers": "SELECT doc_id, coalesce(a, b, c) AS value, CASE WHEN a IS NOT NULL THEN 'native' WHEN b IS NOT NULL THEN 'page' WHEN c IS NOT NULL THEN 'source' END AS origin FROM (SELECT doc_id, nullif(trim(CASE WHEN lang = 'en' THEN substring(text, 1, 20) END, ' '), '') AS a, nullif(trim(url, ' '), '') AS b, nullif(trim(source, ' '), '') AS c FROM documents LEFT JOIN pages ON doc_id = page_id)",
        "last_turn_join": "SELECT doc_id, turn, role FROM documents JOIN (SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1) ON doc_id = conv_id",
        "sampled_texts": "SELECT source, doc_id, CASE WHEN trim(text, ' ') <> '' THEN length(text)::INT END AS chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3",
        "grouped_keywords": "SELECT doc_id, coalesce(keys, '') AS keys FROM documents LEFT JOIN (SELECT source, array_to_string(list_sort(list(DISTINCT doc_id % 7)), ',') AS keys FROM documents WHERE lang = 'de' GROUP BY 1) USING (source) WHERE doc_id % 10 = 1",
        "cited_sentences": f"SELECT doc_id, printf('S%02d', pos + 1) AS cite, length(sentence)::INT AS chars FROM ({split})",
        "source_ranking": "SELECT *, row_number() OVER (ORDER BY mean DESC, source)::INT AS rank FROM (SELECT source, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, min(n_chars) AS least, max(n_chars) AS most, bool_and(length(text) > 1) AS all_ok FROM documents GROUP BY 1)",
        "transition_totals": "SELECT count(*) FILTER (WHERE quality = toxic) AS same, count(*) - count(*) FILTER (WHERE quality = toxic) AS changed FROM labels",
        "token_difference": "SELECT conv_id, pct, coalesce(abs(pct) > 10, false) AS warn FROM (SELECT conv_id, CASE WHEN o > 0 THEN round((a - o) / o * 100, 4) END AS pct FROM (SELECT conv_id, sum(length(text)) FILTER (WHERE role = 'assistant')::DOUBLE AS a, sum(length(text)) FILTER (WHERE role = 'user')::DOUBLE AS o FROM conversations GROUP BY 1))",
        "retry_counts": "SELECT lang, count(*) FILTER (WHERE quality = 1) AS succeeded, count(*) FILTER (WHERE quality IS DISTINCT FROM 1) AS exhausted FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
        "part_counts": "SELECT doc_id, coalesce(len(w), 0)::INT AS words, coalesce(len(list_distinct(w)), 0)::INT AS different FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents)",
        "contribution_scores": "SELECT doc_id, round((0.30::DOUBLE * (doc_id % 7 % 5) + 0.25::DOUBLE * (doc_id % 11 % 5) + 0.20::DOUBLE * (doc_id % 13 % 5) + 0.15::DOUBLE * (doc_id % 17 % 5) + 0.10::DOUBLE * (doc_id % 19 % 5)) / 4, 6) AS score FROM documents",
        "distinct_sentences": f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY f) - 1)::INT AS pos, sentence FROM (SELECT doc_id, sentence, min(pos) AS f FROM ({split}) GROUP BY 1, 2)",
        "corpus_totals": "SELECT count(*) AS records, count(DISTINCT source) AS categories, sum(strlen(text))::BIGINT AS bytes, sum(n_chars)::BIGINT AS chars FROM documents",
        "next_segment_start": 'SELECT conv_id, turn AS start, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS "end" FROM conversations WHERE role = \'user\'',
        "previous_output": "SELECT conv_id, turn, lag(length(text)::INT) OVER (PARTITION BY conv_id, role ORDER BY turn) AS previous FROM conversations",
        "cause_ranking": "SELECT lang, l[1] AS first, array_to_string(l[2:], ',') AS others FROM (SELECT lang, list(source ORDER BY n DESC, source) AS l FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1)",
        "coverage_select": """WITH r AS (SELECT lang, source, doc_id, n_chars AS cost, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
b AS (SELECT *, rank = min(rank) OVER (PARTITION BY lang, source) AS best FROM r),
c AS (SELECT *, best AND sum(CASE WHEN best THEN cost ELSE 0 END) OVER (PARTITION BY lang ORDER BY rank) <= 40000 AS covers FROM b),
l AS (SELECT *, coalesce(sum(cost) FILTER (WHERE covers) OVER (PARTITION BY lang), 0) + sum(CASE WHEN covers THEN 0 ELSE cost END) OVER (PARTITION BY lang ORDER BY rank) AS spent, count(*) FILTER (WHERE covers) OVER (PARTITION BY lang) + count(*) FILTER (WHERE NOT covers) OVER (PARTITION BY lang ORDER BY rank) AS n FROM c)
SELECT lang, doc_id, rank::INT AS rank, covers FROM l WHERE covers OR (spent <= 90000 AND n <= 30)""",
        "numeric_order": "SELECT source, row_number() OVER (ORDER BY regexp_extract(source, '([0-9]+)', 1)::INT, source)::INT AS rank FROM (SELECT DISTINCT source FROM documents)",
        "unit_vectors": "SELECT vec_id, round(s / ((sqrt(s) + 1e-9) * (sqrt(s) + 1e-9)), 6) AS length, round(embedding[1]::DOUBLE / (sqrt(s) + 1e-9), 6) AS first FROM (SELECT *, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS s FROM embeddings)",
        "source_families": "SELECT DISTINCT source, CASE WHEN contains(source, 'src1') THEN 'one' WHEN contains(source, 'src2') THEN 'two' WHEN contains(source, 'rc') THEN 'any' ELSE 'other' END AS family FROM documents",
        "shown_numbers": "SELECT source, coalesce(printf('%.3f', avg(quality)), 'N/A') AS quality, coalesce(printf('%.2f', max(CASE WHEN toxic = 5 THEN 1.0::DOUBLE END)), 'N/A') AS never FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
        "unescaped_paragraphs": "SELECT page_id, md5(array_to_string(list_transform(list_filter(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1), lambda x: trim(x, ' ') <> ''), lambda x: replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')), chr(10) || chr(10))) AS md5 FROM pages",
        "date_extract": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS date FROM events",
        "coord_check": "SELECT event_id % 61 > 59 OR event_id % 71 > 59 AS suspect, count(*) AS n FROM events GROUP BY 1",
        "row_grouping": """WITH RECURSIVE i AS (SELECT user_id, round(value, 3) AS y, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 3), 10 + event_id % 5, event_id) AS k, greatest(0.6 * avg(10 + event_id % 5) OVER (PARTITION BY user_id), 8) AS far FROM events WHERE value IS NOT NULL),
w AS (SELECT user_id, k, y AS first, 1 AS rows FROM i WHERE k = 1 UNION ALL SELECT i.user_id, i.k, CASE WHEN i.y - w.first > i.far THEN i.y ELSE w.first END, w.rows + CASE WHEN i.y - w.first > i.far THEN 1 ELSE 0 END FROM w JOIN i ON i.user_id = w.user_id AND i.k = w.k + 1)
SELECT user_id, max(k)::INT AS items, max(rows)::INT AS rows FROM w GROUP BY 1""",
        "column_gutter": """WITH a AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i, count(*) OVER (PARTITION BY user_id) AS n, lag(value) OVER (PARTITION BY user_id ORDER BY value) AS p, max(value) OVER (PARTITION BY user_id) - min(value) OVER (PARTITION BY user_id) AS span FROM events WHERE value IS NOT NULL),
g AS (SELECT user_id, (x + p) / 2 AS gutter, row_number() OVER (PARTITION BY user_id ORDER BY x - p DESC, i) AS r FROM a WHERE i - 1 >= 0.10 * n AND i - 1 <= 0.65 * n AND i > 2 AND n - i >= 1 AND n >= 6 AND x - p >= 0.06 * span)
SELECT user_id, round(g.gutter, 6) AS gutter FROM (SELECT DISTINCT user_id FROM a) LEFT JOIN g USING (user_id) WHERE r IS NULL OR r = 1""",
    }

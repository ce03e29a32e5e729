"""Queries on texts, labels and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions.text import is_refusal
from docloom.operators.keywords import overlap, words
from docloom.operators.paired import mcnemar, wilcoxon, with_p_values
from docloom.operators.sentences import NORMALIZING, blank_run, excerpt, latin_ratio, normalize_symbols, normalize_whole, sentences
from docloom.operators.tables import cosine_to_mean

#: Parameters of the queries below.
ALLOWED, MIN_ALLOCATION, SAMPLE = tuple(f"src{i}" for i in range(10)), 3, 100


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def split_sentences(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))


def normalize_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", excerpt(normalize_symbols(F.col("text")), 300).alias("excerpt"))


def normalize_whole_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", normalize_whole(F.col("text")).alias("text"))


def suspect_text(spark, d):
    t = _t(spark, d, "documents").select("doc_id", blank_run(F.col("text")).cast("long").alias("blank_run"), F.regexp_count("text", F.lit("[\\x{4E00}-\\x{9FFF}]")).cast("long").alias("ideographs"))
    return t.withColumn("suspect", (F.col("blank_run") >= 100) | (F.col("ideographs") >= 5))


def latin_ratio_filter(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.round(latin_ratio(F.col("text")), 6).alias("ratio")).where("ratio < 0.95")


def review_flags(spark, d):
    reasons = F.concat_ws(",", F.when(F.coalesce(F.length("text"), F.lit(0)) < 100, "short"), F.when(latin_ratio(F.col("text")) < 0.9, "letters"), F.when(is_refusal(F.col("text")), "refusal"))
    return _t(spark, d, "documents").select("doc_id", reasons.alias("reasons")).withColumn("needs_review", F.col("reasons") != "")


def token_frequency_topn(spark, d):
    n = _t(spark, d, "documents").select("lang", F.explode(words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("freq"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("freq"), "word"))).where("rank <= 20")


def overlap_retrieval_topk(spark, d):
    """Documents that share most distinct words with each benchmark item."""
    found = overlap(_t(spark, d, "documents"), _t(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")
    return found.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.col("score").cast("long").alias("shared"), "rank")


def page_paragraphs(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<p[^>]*>(.*?)</p>"), F.lit(1))).alias("pos", "p"))
    return p.select("page_id", "pos", F.regexp_replace("p", "<[^>]*>", "").alias("paragraph"))


def paired_cliffs_delta(spark, d):
    return _t(spark, d, "labels").agg(F.round(F.avg(F.signum(F.col("quality") - F.col("toxic"))), 6).alias("delta"))


def paired_change_rate(spark, d):
    return _t(spark, d, "labels").agg(F.round(F.avg((F.col("quality") != F.col("toxic")).cast("int")), 6).alias("rate"))


def paired_p_values(spark, d):
    """McNemar and signed-rank tests of the two labels, with p-values."""
    l = _t(spark, d, "labels")
    a = with_p_values(mcnemar(l, F.col("quality") == 1, F.col("toxic") == 1), statistic="statistic").select(F.lit("mcnemar").alias("test"), "statistic", "p_value")
    b = with_p_values(wilcoxon(l, F.col("quality") * 3, F.col("toxic") * 2), z="z").select(F.lit("signed ranks").alias("test"), F.col("z").alias("statistic"), "p_value")
    return a.union(b)


def validity_rates(spark, d):
    j = _t(spark, d, "documents").select("doc_id", "lang", "n_chars").join(_t(spark, d, "labels"), "doc_id")
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"), F.round(F.avg("n_chars"), 6).alias("n_chars"))


def taxonomy_membership(spark, d):
    s = F.col("source")
    return _t(spark, d, "documents").groupBy("lang").agg(F.count_if(s.isin(*ALLOWED)).alias("known"), F.count_if((s != "") & ~s.isin(*ALLOWED)).alias("unknown"), F.count_if(F.coalesce(s, F.lit("")) == "").alias("empty"))


def work_grid_resume(spark, d):
    """Cells of languages by sources that no bad document has filled."""
    docs = _t(spark, d, "documents").select("doc_id", "lang", "source")
    done = docs.join(_t(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi").select("lang", "source").distinct()
    return docs.select("lang").distinct().crossJoin(docs.select("source").distinct()).join(done, ["lang", "source"], "left_anti")


def determinism_rate(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    one, two = c.where("turn % 2 = 0"), c.where("turn % 2 = 1").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return one.join(two, ["conv_id", "turn"]).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text") == F.col("other")).alias("identical"), F.count_if(F.trim("text") == F.trim("other")).alias("stripped_identical"))


def elbow_choice(spark, d):
    """The month farthest from the chord of the curve of monthly orders; the first of equals."""
    o = _t(spark, d, "orders")
    curve = o.groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("y"))
    ends = curve.agg(F.min(F.struct("k", "y")).alias("a"), F.max(F.struct("k", "y")).alias("b"))
    dx, dy = F.col("b.k") - F.col("a.k"), F.col("b.y") - F.col("a.y")
    away = F.round(F.abs(dx * (F.col("y") - F.col("a.y")) - dy * (F.col("k") - F.col("a.k"))) / F.sqrt(dx * dx + dy * dy), 6)
    return curve.join(F.broadcast(ends)).select("k", "y", away.alias("away")).orderBy(F.desc("away"), "k").limit(1)


def neyman_allocation(spark, d):
    """Rows to sample of each label, in proportion to its size and the spread of its vectors about their mean."""
    rows = cosine_to_mean(_t(spark, d, "embeddings"), "label", "embedding").select(F.col("grp").alias("label"), (1 - F.col("cosine")).alias("away"))
    size = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("away").alias("s"))
    total = size.agg(F.sum(F.col("n") * F.col("s")).alias("total"))
    return size.join(F.broadcast(total)).select("label", "n", F.round("s", 6).alias("spread"), F.greatest(F.round(SAMPLE * F.col("n") * F.col("s") / F.col("total")), F.lit(MIN_ALLOCATION)).cast("long").alias("allocated"))


QUERIES = {f.__name__: f for f in (paired_p_values, split_sentences, normalize_text, normalize_whole_text, suspect_text, latin_ratio_filter, review_flags, token_frequency_topn, overlap_retrieval_topk, page_paragraphs, paired_cliffs_delta, paired_change_rate, validity_rates, taxonomy_membership, work_grid_resume, determinism_rate, elbow_choice, neyman_allocation)}

_B = "[ \\t\\n\\r\\f]"
_W = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 2)"
_RATIO = "length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '[^\\p{L}]', '', 'g')), 0)"
_REFUSAL = "regexp_matches(lower(text), 'i cannot|i can''t|i''m sorry|as an ai|unable to')"
_DIGITS = f"'([0-9]{_B}*)\\.({_B}*[0-9])', '\\1' || chr(2) || '\\2', 'g'"
_WHOLE = "translate(text, '‘’“”‐‑‒–—−：，！？′″', '''''\"\"------:,!?''\"')"
for _p, _by in NORMALIZING:
    _WHOLE = "regexp_replace({}, '{}', '{}', 'g')".format(_WHOLE, _p.replace("'", "''"), _by)
_MEMBERS = ", ".join(f"'{s}'" for s in ALLOWED)
SQL = {
    "split_sentences": f"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, {_DIGITS}), {_DIGITS}), '([.?!]["'')\\]]*)', '\\1' || chr(1), 'g') AS t FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(regexp_replace(replace(x, chr(2), '.'), '{_B}+', ' ', 'g'))), lambda x: x <> '') AS a FROM m)
SELECT doc_id, unnest(range(0, len(a)))::INT AS pos, unnest(a) AS sentence FROM s""",
    "normalize_text": "SELECT doc_id, CASE WHEN length(t) > 300 THEN substring(t, 1, 300) || '…' ELSE t END AS excerpt FROM (SELECT doc_id, translate(text, '‘’“”‐‑‒–—−：，！？', '''''\"\"------:,!?') AS t FROM documents)",
    "normalize_whole_text": f"SELECT doc_id, trim({_WHOLE}) AS text FROM documents",
    "suspect_text": f"""SELECT *, blank_run >= 100 OR ideographs >= 5 AS suspect FROM (SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all(text, '{_B}{{20,}}'), lambda x: length(x))), 0) AS blank_run,
length(regexp_replace(text, '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')) AS ideographs FROM documents)""",
    "latin_ratio_filter": f"SELECT * FROM (SELECT doc_id, round({_RATIO}, 6) AS ratio FROM documents) WHERE ratio < 0.95",
    "review_flags": f"SELECT doc_id, reasons, reasons <> '' AS needs_review FROM (SELECT doc_id, concat_ws(',', CASE WHEN coalesce(length(text), 0) < 100 THEN 'short' END, CASE WHEN {_RATIO} < 0.9 THEN 'letters' END, CASE WHEN {_REFUSAL} THEN 'refusal' END) AS reasons FROM documents)",
    "token_frequency_topn": f"SELECT lang, word, freq, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY freq DESC, word) AS rank FROM (SELECT lang, word, count(*) AS freq FROM (SELECT lang, unnest({_W}) AS word FROM documents) GROUP BY 1, 2)) WHERE rank <= 20",
    "overlap_retrieval_topk": f"""WITH t AS (SELECT doc_id, unnest(list_distinct({_W})) AS word FROM documents), q AS (SELECT item_id, unnest(list_distinct({_W})) AS word FROM benchmark),
s AS (SELECT item_id, doc_id, count(*) AS shared FROM t JOIN q USING (word) GROUP BY 1, 2)
SELECT item_id, doc_id, shared, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS rank FROM s) WHERE rank <= 5""",
    "page_paragraphs": "SELECT page_id, unnest(range(0, len(a)))::INT AS pos, regexp_replace(unnest(a), '<[^>]*>', '', 'g') AS paragraph FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1) AS a FROM pages)",
    "paired_cliffs_delta": "SELECT round(avg(sign(quality - toxic)), 6) AS delta FROM labels",
    "paired_change_rate": "SELECT round(avg((quality <> toxic)::INT), 6) AS rate FROM labels",
    "validity_rates": "SELECT lang, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, round(avg(n_chars), 6) AS n_chars FROM documents JOIN labels USING (doc_id) GROUP BY 1",
    "taxonomy_membership": f"SELECT lang, count(*) FILTER (WHERE source IN ({_MEMBERS})) AS known, count(*) FILTER (WHERE source <> '' AND source NOT IN ({_MEMBERS})) AS unknown, count(*) FILTER (WHERE coalesce(source, '') = '') AS empty FROM documents GROUP BY 1",
    "work_grid_resume": "SELECT l.lang, s.source FROM (SELECT DISTINCT lang FROM documents) l, (SELECT DISTINCT source FROM documents) s WHERE NOT EXISTS (SELECT 1 FROM documents d JOIN labels USING (doc_id) WHERE quality = 0 AND d.lang = l.lang AND d.source = s.source)",
    "determinism_rate": "SELECT a.role, count(*) AS n, count(*) FILTER (WHERE a.text = b.text) AS identical, count(*) FILTER (WHERE trim(a.text) = trim(b.text)) AS stripped_identical FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0 GROUP BY 1",
    "elbow_choice": """WITH c AS (SELECT (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS k, count(*) AS y FROM orders GROUP BY 1), e AS (SELECT min(k) AS ak, arg_min(y, k) AS ay, max(k) AS bk, arg_max(y, k) AS by_ FROM c)
SELECT k, y, round(abs((bk - ak) * (y - ay) - (by_ - ay) * (k - ak)) / sqrt((bk - ak) ** 2 + (by_ - ay) ** 2), 6) AS away FROM c, e ORDER BY away DESC, k LIMIT 1""",
    "neyman_allocation": """WITH l AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM l GROUP BY 1, 2),
r AS (SELECT label, vec_id, 1 - sum(x * m) / sqrt(sum(x * x) * sum(m * m)) AS away FROM l JOIN m USING (label, i) GROUP BY 1, 2), z AS (SELECT label, count(*) AS n, stddev_pop(away) AS s FROM r GROUP BY 1)
SELECT label, n, round(s, 6) AS spread, greatest(round(100 * n * s / (SELECT sum(n * s) FROM z)), 3)::BIGINT AS allocated FROM z""",
}

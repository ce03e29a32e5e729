"""Queries on passages, clusters and paired values."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators.clusters import assign, lloyd, means
from docloom.operators.paired import bootstrap_mean, wilcoxon
from docloom.operators.passages import json_object, overlap_windows, slice_until
from docloom.operators.sentences import sentences

K, STEPS = 5, 3


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def collect_until_boundary(spark, d):
    """From each document's first sentence with a digit to the next short one."""
    s = _t(spark, d, "documents").select("doc_id", sentences(F.col("text")).alias("s"))
    first, found = slice_until(F.col("s"), lambda x: x.rlike("[0-9]"), lambda x: F.length(x) < 30)
    out = s.select("doc_id", first.alias("first"), F.posexplode(found).alias("i", "sentence"))
    return out.select("doc_id", (F.col("first") + F.col("i")).alias("pos"), "sentence")


def overlap_line_windows(spark, d):
    return overlap_windows(_t(spark, d, "documents"), "doc_id", "text")


def json_in_text(spark, d):
    c = F.concat(F.lit("answer: "), F.col("props"), F.lit(" end"))
    return _t(spark, d, "events").select("event_id", F.get_json_object(json_object(c), "$.k").cast("long").alias("k"))


def assign_nearest_centroid(spark, d):
    """Rows and summed squared distance of the labels whose mean is nearest."""
    v = _t(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return assign(v, "embedding", means(v, "embedding", "label")).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d2"), 6).alias("wcss"))


def lloyd_fixed_iterations(spark, d):
    v = lloyd(_t(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", K, STEPS)
    return v.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d2"), 6).alias("wcss"))


def paired_wilcoxon(spark, d):
    return wilcoxon(_t(spark, d, "labels"), F.col("quality") * 3, F.col("toxic") * 2)


def bootstrap_ci(spark, d):
    return bootstrap_mean(_t(spark, d, "labels"), F.col("quality") - F.col("toxic"))


def token_regression(spark, d):
    """The line of words on characters."""
    w = F.size(F.split(F.trim("text"), "[ \\t\\n\\r\\f]+"))
    return _t(spark, d, "documents").where(F.length(F.trim("text")) > 0).select("n_chars", w.alias("w")).groupBy().agg(F.round(F.regr_slope("w", "n_chars"), 6).alias("slope"), F.round(F.regr_intercept("w", "n_chars"), 6).alias("intercept"))


QUERIES = {f.__name__: f for f in (collect_until_boundary, overlap_line_windows, json_in_text, assign_nearest_centroid, lloyd_fixed_iterations, paired_wilcoxon, bootstrap_ci, token_regression)}


def _lloyd_sql() -> str:
    parts = ["WITH l AS (SELECT vec_id AS id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)", f"f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS c FROM embeddings QUALIFY c < {K})", "c0 AS (SELECT f.c, l.i, l.x AS m FROM f JOIN l ON l.id = f.vec_id)"]
    for s in range(STEPS):
        parts.append(f"a{s} AS (SELECT id, min(struct_pack(d2 := d2, c := c)) AS b FROM (SELECT id, c, sum((x - m) * (x - m)) AS d2 FROM l JOIN c{s} USING (i) GROUP BY 1, 2) GROUP BY 1)")
        parts.append(f"c{s + 1} AS (SELECT a.b.c AS c, i, avg(x) AS m FROM l JOIN a{s} a USING (id) GROUP BY 1, 2)")
    return ", ".join(parts) + f" SELECT b.c AS cluster, count(*) AS n, round(sum(b.d2), 6) AS wcss FROM a{STEPS - 1} GROUP BY 1"


_B = "[ \\t\\n\\r\\f]"


def sql(split: str) -> dict[str, str]:
    """split: the SQL of all sentences."""
    return {
        "collect_until_boundary": f"""WITH z AS ({split}), a AS (SELECT doc_id, min(pos) AS f FROM z WHERE regexp_matches(sentence, '[0-9]') GROUP BY 1),
b AS (SELECT doc_id, f, min(pos) FILTER (WHERE pos > f AND length(sentence) < 30) AS e FROM z JOIN a USING (doc_id) GROUP BY 1, 2)
SELECT doc_id, pos, sentence FROM z JOIN b USING (doc_id) WHERE pos >= f AND pos < f + 12 AND (e IS NULL OR pos < e)""",
        "overlap_line_windows": """WITH RECURSIVE l AS (SELECT doc_id, i, n, length(x) + 1 AS size, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS x, len(x) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text <> ''))),
b AS (SELECT a.doc_id, a.i AS s, any_value(a.n) AS n, greatest(a.i, coalesce(max(b.i) FILTER (WHERE b.upto - (a.upto - a.size) <= 5000), 0)) AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i >= a.i GROUP BY a.doc_id, a.i),
w AS (SELECT doc_id, 0 AS pos, s, e, n FROM b WHERE s = 1 UNION ALL SELECT b.doc_id, w.pos + 1, b.s, b.e, b.n FROM w JOIN b ON b.doc_id = w.doc_id AND b.s = greatest(w.s + 1, w.e - 2) WHERE w.e < w.n)
SELECT doc_id, pos::INT AS pos, s::INT AS first, e::INT AS last FROM w""",
        "json_in_text": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
        "assign_nearest_centroid": """WITH l AS (SELECT vec_id AS id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label AS c, i, avg(x) AS m FROM l GROUP BY 1, 2),
a AS (SELECT id, min(struct_pack(d2 := d2, c := c)) AS b FROM (SELECT id, c, sum((x - m) * (x - m)) AS d2 FROM l JOIN m USING (i) GROUP BY 1, 2) GROUP BY 1)
SELECT b.c::BIGINT AS cluster, count(*) AS n, round(sum(b.d2), 6) AS wcss FROM a GROUP BY 1""",
        "lloyd_fixed_iterations": _lloyd_sql(),
        "paired_wilcoxon": """WITH d AS (SELECT quality * 3 - toxic * 2 AS d FROM labels), r AS (SELECT d, count(*) OVER (PARTITION BY abs(d)) AS k, rank() OVER (ORDER BY abs(d)) AS r FROM d WHERE d <> 0),
w AS (SELECT count(*) AS n, sum(r + (k - 1) / 2.0) FILTER (WHERE d > 0) AS w_plus, sum(r + (k - 1) / 2.0) FILTER (WHERE d < 0) AS w_minus, sum(k * k - 1)::DOUBLE AS ties FROM r)
SELECT n, w_plus::DOUBLE AS w_plus, w_minus::DOUBLE AS w_minus, round((least(w_plus, w_minus)::DOUBLE - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM w""",
        "token_regression": f"SELECT round(regr_slope(w, n_chars), 6) AS slope, round(regr_intercept(w, n_chars), 6) AS intercept FROM (SELECT n_chars, len(regexp_split_to_array(trim(text), '{_B}+')) AS w FROM documents WHERE length(trim(text)) > 0)",
    }

"""Queries on pairs of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import kmeans, pairs, tsne

_ARGS = ("vec_id", "embedding", "label")


def _v(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(*_ARGS)


def top_pairs(spark, d):
    return pairs.extreme_pairs(_v(spark, d), *_ARGS)


def bottom_pairs(spark, d):
    return pairs.extreme_pairs(_v(spark, d), *_ARGS, largest=False)


def knn_graph(spark, d):
    return pairs.knn_edges(_v(spark, d), *_ARGS)


def similarity_histogram(spark, d):
    return pairs.pair_histogram(_v(spark, d), *_ARGS)


def within_label_pairs(spark, d):
    return pairs.within_group(_v(spark, d), *_ARGS).withColumn("grp", F.col("grp").cast("long"))


def silhouette_by_label(spark, d):
    return pairs.silhouette(_v(spark, d), *_ARGS)


def kmeans_seeded(spark, d):
    """Sizes of five clusters, the best of three restarts."""
    v = _v(spark, d)
    wcss, centres = kmeans.sweep(v, "vec_id", "embedding", [5])[5]
    return kmeans.assigned(v, "embedding", centres).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).withColumn("wcss", F.round(F.lit(wcss), 6))


def k_sweep(spark, d):
    """wcss and mean silhouette for k from 2 to 6; the elbow is told, the first best silhouette is chosen."""
    v = _v(spark, d).select("vec_id", "embedding")
    found = kmeans.sweep(v, "vec_id", "embedding", [2, 3, 4, 5, 6])
    for k, (_, centres) in found.items():
        v = kmeans.assigned(v, "embedding", centres, f"k{k}")
    mean = {r.labelling: r.silhouette for r in pairs.silhouettes(v, "vec_id", "embedding", [f"k{k}" for k in found]).collect()}
    rows = [(k, float(w), mean[f"k{k}"]) for k, (w, _) in found.items()]
    bend, best = kmeans.elbow({k: w for k, w, _ in rows}), max(s for _, _, s in rows if s is not None)
    chosen = min(k for k, _, s in rows if s == best)
    return spark.createDataFrame([(k, round(w, 6), s, k == bend, k == chosen) for k, w, s in rows], "k int, wcss double, silhouette double, is_elbow boolean, is_chosen boolean")


QUERIES = {f.__name__: f for f in (kmeans_seeded, k_sweep, top_pairs, bottom_pairs, knn_graph, similarity_histogram, within_label_pairs, silhouette_by_label)}

_P = "WITH e AS (SELECT vec_id AS id, label AS grp, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.id AS i, b.id AS j, a.grp AS gi, b.grp AS gj, list_dot_product(a.v, b.v) AS s FROM e a JOIN e b ON a.id {op} b.id)"
_HALF, _FULL = _P.format(op="<"), _P.format(op="<>")
SQL = {
    "top_pairs": f"{_HALF} SELECT i AS id_a, j AS id_b, round(s, 6) AS similarity FROM p ORDER BY similarity DESC, i, j LIMIT 50",
    "bottom_pairs": f"{_HALF} SELECT i AS id_a, j AS id_b, round(s, 6) AS similarity FROM p ORDER BY similarity, i, j LIMIT 50",
    "knn_graph": f"{_FULL} SELECT DISTINCT least(i, j) AS id_a, greatest(i, j) AS id_b, similarity FROM (SELECT i, j, round(s, 6) AS similarity, row_number() OVER (PARTITION BY i ORDER BY round(s, 6) DESC, j) AS rank FROM p) WHERE rank <= 4",
    "similarity_histogram": f"{_HALF}, m AS (SELECT min(s) AS lo, max(s) AS hi FROM p) SELECT (least(floor((s - lo) / (hi - lo) * 50), 49) + 1)::INT AS bin, count(*) FILTER (WHERE gi = gj) AS intra_count, count(*) FILTER (WHERE gi <> gj) AS inter_count FROM p, m GROUP BY 1",
    "within_label_pairs": f"{_HALF} SELECT gi::BIGINT AS grp, count(*) AS n, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std FROM p WHERE gi = gj GROUP BY 1",
    "silhouette_by_label": f"""{_FULL}, d AS (SELECT i, gi, gj, avg(sqrt(greatest(0, 2 - 2 * s))) AS d FROM p GROUP BY 1, 2, 3),
r AS (SELECT i, max(d) FILTER (WHERE gi = gj) AS a, min(d) FILTER (WHERE gi <> gj) AS b FROM d GROUP BY 1)
SELECT count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM r WHERE a IS NOT NULL AND b IS NOT NULL""",
}


def nearest_by_distance(spark, d):
    """The five nearest others of each vector, by squared distance."""
    near = tsne.neighbours(_v(spark, d), "vec_id", "embedding", 5)
    return near.select("i", "j", F.round("d2", 6).alias("d2"))


def tsne_affinities(spark, d):
    """Per vector the perplexity that its bandwidth comes to, and the sum of its neighbours' chances."""
    p = tsne.affinities(tsne.neighbours(_v(spark, d), "vec_id", "embedding", 30), 10.0)
    return p.groupBy("i").agg(F.round(F.max("perplexity"), 3).alias("perplexity"), F.round(F.sum("p"), 6).alias("total"), F.count(F.lit(1)).alias("n"))


QUERIES |= {f.__name__: f for f in (nearest_by_distance, tsne_affinities)}
SQL |= {
    "nearest_by_distance": "WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS s FROM embeddings) SELECT i, j, round(d2, 6) AS d2 FROM (SELECT a.id AS i, b.id AS j, greatest(0, a.s + b.s - 2 * list_dot_product(a.v, b.v)) AS d2, row_number() OVER (PARTITION BY a.id ORDER BY greatest(0, a.s + b.s - 2 * list_dot_product(a.v, b.v)), b.id) AS rank FROM e a JOIN e b ON a.id <> b.id) WHERE rank <= 5",
    "tsne_affinities": "SELECT vec_id AS i, 10.0::DOUBLE AS perplexity, 1.0::DOUBLE AS total, 30::BIGINT AS n FROM embeddings",
}

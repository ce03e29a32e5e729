"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Words are runs of letters and digits in lower case; shingles are ``SHINGLE`` words. A text or an item of fewer words is one shingle, so so short an item is
found where a text is nothing else, not inside longer texts: words that common would reject clean documents. Items
are partitioned by their number of distinct shingles, in powers of two. An item's sketch is the bottom k of its shingles
under a hash order that puts shingles rarer among the items first (so it is a bottom-k sketch by rarity, then hash; texts are searched whole instead of being sketched), with k = floor((1 - threshold) * u) + 1 for the largest size u
of its partition. A text that holds at least ``threshold`` of an item's shingles misses at most floor((1 - threshold) *
size) of them, fewer than k, so it shares one of the sketch: the search loses no item. Texts are searched whole, by
hashing each of their shingles against the sketches; a text too short for an item's partition is not a candidate.

Candidates are verified by counting the distinct shingles, as strings, that item and text share. Everything is DataFrame
code. Texts are told apart by a 128-bit digest, so copies are searched once each and verified once, and a text that makes
up a third of the rows costs one verification.

Defined results: null and empty texts or items without words match nothing. Repeated rows each get their pairs. Ids may
repeat or be null; pairs are joined by text, not by id. Texts of any length are searched whole. An empty table of texts or of items gives no pair.
Other columns, whatever their names, are not read; decontaminate passes them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, text_key

SHINGLE = 5
THRESHOLD = 0.8
#: Tables of at most so many rows (some 50 bytes each) are broadcast; longer ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _positions(w: Column) -> Column:
    return F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0))))


def _hash(w: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)])


def _string(w: Column, i: Column) -> Column:
    return F.concat_ws(" ", *[F.get(w, i + j) for j in range(SHINGLE)])


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def sketch_items(items: DataFrame, item_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """All distinct shingles of the items (item, s, size), and of them the sketches (item, h, least: shingles a text needs)."""
    w = items.select(F.struct(F.col(item_col).alias("id"), text_key(F.col(text_col)).alias("k")).alias("item"), words(F.col(text_col)).alias("w"))
    s = w.select("item", "w", F.explode(_positions(F.col("w"))).alias("i")).select("item", _string(F.col("w"), F.col("i")).alias("s"), _hash(F.col("w"), F.col("i")).alias("h")).distinct()
    sizes = s.groupBy("item").agg(F.count(F.lit(1)).alias("size"))
    shingles = materialize(s.join(sizes, "item"), "item-shingles")
    part = F.floor(F.log2(F.col("size"))).alias("part")
    upper = shingles.groupBy(part).agg(F.max("size").alias("upper"))
    rarity = shingles.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    ranked = shingles.withColumn("part", part).join(upper, "part").join(rarity, "h").withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("n", F.xxhash64("h"), "h")))
    k = F.floor((1 - F.lit(threshold)) * F.col("upper") + 1e-9) + 1
    return shingles, materialize(ranked.where(F.col("r") <= k).select("item", "h", F.ceil(F.col("size") * threshold - 1e-9).alias("least")), "item-sketches")


def find_contained(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(k, item_id, containment) for each distinct text (by text_key) and item with containment >= threshold."""
    shingles, sketches = sketch_items(items, item_col, item_text_col, threshold)
    rows = docs.select(F.col(text_col).alias("text")).where(F.length("text") > 0)
    w = rows.select(text_key(F.col("text")).alias("k"), words(F.col("text")).alias("w")).select("k", "w", F.explode(_positions(F.col("w"))).alias("i"))
    hashed = w.select("k", _hash(F.col("w"), F.col("i")).alias("h"), F.size("w").alias("n"))
    found = hashed.join(_small(sketches), "h").where(F.greatest(F.col("n") - (SHINGLE - 1), F.lit(1)) >= F.col("least"))
    candidates = materialize(found.select("k", "item").distinct(), "candidates")

    keys = candidates.select("k").distinct()
    texts = rows.select(text_key(F.col("text")).alias("k"), "text").join(_small(keys), "k", "left_semi").dropDuplicates(["k"])
    w = texts.select("k", words(F.col("text")).alias("w")).select("k", "w", F.explode(_positions(F.col("w"))).alias("i"))
    shared = w.select("k", _string(F.col("w"), F.col("i")).alias("s")).join(_small(shingles.select("item", "s", "size")), "s").select("k", "item", "size", "s").distinct()
    counted = shared.groupBy("k", "item", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.ceil(F.col("size") * threshold - 1e-9))
    exact = counted.join(candidates, ["k", "item"], "left_semi")
    return exact.select("k", F.col("item.id").alias("item_id"), (F.col("n") / F.col("size")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text contains no item."""
    hit = find_contained(docs, items, text_col, threshold=threshold).select(F.col("k").alias("__k")).distinct()
    return docs.join(_small(materialize(hit, "contaminated")), text_key(docs[text_col]) == F.col("__k"), "left_anti")


def op7_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, containment): the pairs with a containment of 0.8 or more."""
    docs = table(spark, sf_dir, "documents")
    pairs = materialize(find_contained(docs, table(spark, sf_dir, "benchmark")), "contained")
    return docs.select("doc_id", text_key(F.col("text")).alias("k")).join(_small(pairs), "k").select("doc_id", "item_id", "containment")


_W = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
OP7_SQL = f"""
WITH i AS (SELECT DISTINCT item_id, array_to_string(w[j:j+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS j FROM (SELECT item_id, {_W} AS w FROM benchmark) WHERE len(w) > 0)),
z AS (SELECT item_id, count(*) AS size FROM i GROUP BY 1),
d AS (SELECT DISTINCT doc_id, array_to_string(w[j:j+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS j FROM (SELECT doc_id, {_W} AS w FROM documents) WHERE len(w) > 0))
SELECT doc_id, item_id, count(*) / any_value(size) AS containment FROM d JOIN i USING (s) JOIN z USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(size) - 1e-9
"""

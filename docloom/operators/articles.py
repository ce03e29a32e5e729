"""Texts cut at the places where a pattern stands, with offsets; passages chosen to cover kinds first, then by rank, under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How much of a chunk is kept, how much of a text without any, and what such a text's chunk is called.
CHUNK_MOST, WHOLE_MOST, WHOLE = 1200, 2000, "전문"


def _running(n: Column) -> Column:
    """Sums of an array of numbers up to and with each."""
    return F.aggregate(n, F.array().cast("array<int>"), lambda s, x: F.concat(s, F.array(x + F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)))))


def matches(c: Column, pattern: str) -> Column:
    """All matches of a pattern (of one character at least): array of (start, match, rest): the first character's offset, what matched, what stands from its end to the next match."""
    both = F.struct(F.regexp_extract_all(c, F.lit(pattern), 0).alias("m"), F.split(c, pattern, -1).alias("p"))

    def placed(s: Column) -> Column:
        rests = F.slice(s["p"], 2, F.size(s["p"]))
        ends = _running(F.concat(F.array(F.length(F.get(s["p"], F.lit(0)))), F.zip_with(s["m"], rests, lambda m, r: F.length(m) + F.length(r))))
        return F.transform(F.arrays_zip(F.slice(ends, 1, F.size(s["m"])).alias("start"), s["m"].alias("match"), rests.alias("rest")), lambda x: F.struct(x["start"].alias("start"), x["match"].alias("match"), x["rest"].alias("rest")))

    return F.get(F.transform(F.filter(F.array(both), lambda s: s["m"].isNotNull()), placed), F.lit(0))


def chunks(c: Column, pattern: str, most: int = CHUNK_MOST, whole_most: int = WHOLE_MOST, whole: str = WHOLE) -> Column:
    """Array of (article, start, end, text): from each match to the next, trimmed and cut to ``most`` characters; a text without matches is one chunk. ``article``: the pattern's first group.

    start and end are offsets in the text, so the spans and what precedes the first rebuild it. A null text is null.
    """
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")

    def chunk(m: Column) -> Column:
        text = F.concat(m["match"], m["rest"])
        return F.struct(F.regexp_extract(m["match"], pattern, 1).alias("article"), m["start"].alias("start"), (m["start"] + F.length(text)).alias("end"), F.substring(trimmed(text), 1, most).alias("text"))

    one = F.array(F.struct(F.lit(whole).alias("article"), F.lit(0).alias("start"), F.length(c).alias("end"), F.substring(c, 1, whole_most).alias("text")))
    return F.get(F.transform(F.filter(F.array(matches(c, pattern)), lambda x: x.isNotNull()), lambda x: F.when(F.size(x) > 0, F.transform(x, chunk)).otherwise(one)), F.lit(0))


#: What a chunk costs at most when it covers a kind, and when it is taken by rank; how long the ranked list is at least.
COVER_MOST, RANKED_MOST, LIST_LEAST = 1800, 2800, 30


def grounding(ranked: DataFrame, first: DataFrame, group: str, kind: str, item: str, length: str, order: list, kinds: list[str], most: int, budget: int) -> DataFrame:
    """(group, place, item, kind, covers): each group's selection, in its order.

    ``ranked``: the hits of each group; of these the first max(3 * most, LIST_LEAST) in ``order`` (total in a group) count. ``first``: (kind, item, length), the chunk that stands for a kind without hits.
    First, in the order of ``kinds``, the best hit of each, or its first chunk; then hits by rank. Either pass ends at the first chunk that goes over the
    budget, the second also when ``most`` chunks are chosen, but not before it has added one.
    """
    at = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    hits = ranked.select(F.col(group).alias("g"), F.col(kind).alias("kind"), F.col(item).alias("item"), F.col(length).alias("n"), at.alias("rank")).where(F.col("rank") <= max(3 * most, LIST_LEAST))
    listed = F.array(*[F.lit(k) for k in kinds])
    wanted = hits.select("g").distinct().select("g", F.posexplode(listed).alias("place", "kind"))
    best = hits.groupBy("g", "kind").agg(F.min(F.struct("rank", "item", "n")).alias("best"))
    stand_in = first.select(F.col(kind).alias("kind"), F.col(item).alias("first_item"), F.col(length).alias("first_n"))
    cover = wanted.join(best, ["g", "kind"], "left").join(stand_in, "kind", "left")
    cover = cover.select("g", "kind", "place", F.coalesce("best.item", "first_item").alias("item"), F.coalesce("best.n", "first_n").alias("n")).where(F.col("item").isNotNull())
    upto = lambda order: Window.partitionBy("g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cover = cover.withColumn("spent", F.sum(F.least("n", F.lit(COVER_MOST))).over(upto("place"))).where(F.col("spent") <= budget)
    so_far = cover.groupBy("g").agg(F.max("spent").alias("spent"), F.count(F.lit(1)).alias("taken"))
    rest = hits.join(cover.select("g", "item"), ["g", "item"], "left_anti").join(so_far, "g", "left").na.fill(0, ["spent", "taken"])
    rest = rest.withColumn("upto", F.col("spent") + F.sum(F.least("n", F.lit(RANKED_MOST))).over(upto("rank"))).withColumn("nth", F.row_number().over(Window.partitionBy("g").orderBy("rank")))
    rest = rest.where((F.col("upto") <= budget) & (F.col("nth") <= F.greatest(F.lit(most) - F.col("taken"), F.lit(1))))
    both = cover.select("g", F.struct(F.lit(0).alias("pass"), F.col("place").alias("at")).alias("o"), "item", "kind", F.lit(True).alias("covers")).union(rest.select("g", F.struct(F.lit(1), F.col("rank")), "item", "kind", F.lit(False)))
    return both.select(F.col("g").alias(group), F.row_number().over(Window.partitionBy("g").orderBy("o")).alias("place"), F.col("item").alias(item), F.col("kind").alias(kind), "covers")

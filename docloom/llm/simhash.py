"""SimHash near-duplicates, found by deletion-variant signatures.

Fingerprint: 64 bits, each set if more than half of the text's shingle hashes have it set. Two fingerprints link if at
most ``DISTANCE`` = 4 bits differ. Cut into 3 segments (22, 21 and 21 bits), two linked fingerprints differ by at most one bit
in at least one of them (4 < 3 * 2). Each fingerprint is therefore indexed under 64 variants: a segment with one of its
bits left out. An equality join on variants finds every link, and the distance verifies it.

Copies collapse first: the index holds distinct fingerprints. Only components are wanted, so dense groups aren't
written out pair by pair: every variant's members link to its pivot (the fingerprint of most rows) where they are near
enough, components are taken of these, and the pair join then returns only links between different components, each under one
variant. A variant of more than ``CROWD`` fingerprints takes no part in the pair join: its members get a second exact index of all
points within 2 bits; two fingerprints link exactly if they share such a point, and each point's members form a star.

With ``similarity`` (keep_one_of_each), texts whose distinct shingles have that Jaccard similarity link too: at 0.8 they differ in
about ten of 64 bits, which no selective segment of a SimHash survives. The same deletion-variant signatures then index a MinHash
sketch, 6 segments of 5 values: two such texts differ by at most one value in at least one segment with probability 0.9997, so
their texts meet under one of 30 variants, each with one value left out. Texts that meet nobody leave at once; shingle sets are worked out for
the others, once, and candidates of one size (a similar pair's sizes have that ratio too) are verified on whole sets. Members of a
variant are compared with its pivot, ``TURNS`` times with other pivots, and up to ``PAIRED`` members with each other where components
still differ. Texts of larger variants whose components still differ get a further exact key: with a text's shingles in one order, rare ones
first, two similar texts share one of the first size - ceil(similarity * size) + 1, and what is left of both after the first one
they share must be enough. No pair that meets in a variant and is similar enough is left out. Between the steps go texts' numbers and
components only.

Defined results: null or empty texts and those without words have fingerprint 0 and link to each other. Ids may repeat;
component_id is the least non-null id. Texts of any length are hashed whole, block by block. An empty table gives an empty result. Columns other
than id and text are passed on by keep_one_of_each, whatever their names, and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_shuffles, materialize, table, text_key
from .components import connected_components

SHINGLE = 4
DISTANCE = 4
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
CROWD = 20_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLOCK = 1 << 15
#: The MinHash sketch: so many segments of so many values.
SKETCH = (6, 5)
#: Times that pivots are chosen, and the most members of a variant that are compared with each other directly; larger ones are by prefixes.
TURNS, PAIRED = 3, 32
#: Remainders of shingles that are counted to tell frequent ones.
COUNTS = 1 << 19
_XORS, _FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, 1, SKETCH[0] * SKETCH[1]), dtype=np.uint64) | np.array([[[0]], [[1]]], dtype=np.uint64)


def _hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles, in blocks; bytes.split() cuts at exactly the six ASCII blanks."""
    from xxhash import xxh64_intdigest as digest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return
    if len(words) <= shingle:
        yield np.array([digest(b" ".join(words), SEED)], dtype="<u8")
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1]
    ends = ends[shingle - 1 :]
    for at in range(0, len(starts), _BLOCK):
        yield np.array([digest(line[s:e], SEED) for s, e in zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist(), strict=True)], dtype="<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit integer."""
    n, ones = 0, np.zeros(64, dtype=np.int64)
    for h in _hashes(text, shingle):
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0].astype(np.int64)) if n else 0


def _sketch(text: str | None, shingle: int) -> list[int] | None:
    """MinHash values of the shingles and the number of different ones; None without words."""
    least, blocks = None, []
    for h in _hashes(text, shingle):
        for at in range(0, len(h), 1 << 12):
            low = ((h[at : at + (1 << 12), None] ^ _XORS) * _FACTORS).min(axis=0)
            least = low if least is None else np.minimum(least, low)
        blocks.append(np.unique(h))
    return None if least is None else [*least.view(np.int64).tolist(), len(np.unique(np.concatenate(blocks)))]


def _shingles(text: str | None, shingle: int) -> list[int]:
    blocks = [np.unique(h) for h in _hashes(text, shingle)]
    return np.unique(np.concatenate(blocks)).view(np.int64).tolist() if blocks else []


def _once(of, kind: str, shingle: int):
    """A UDF of texts that works out each text once a batch."""

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            known: dict = {}
            yield pd.Series([known[t] if t in known else known.setdefault(t, of(t, shingle)) for t in texts], dtype="int64" if kind == "long" else object)

    return run


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs with ``__fp``."""

    return docs.withColumn("__fp", _once(fingerprint, "long", shingle)(F.coalesce(F.col(text_col), F.lit(""))))


def _bits(fp, segment: int):
    start, width = SEGMENTS[segment]
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def _variants(fps: DataFrame) -> DataFrame:
    """fps with w (the bit left out) and key; the key holds w and the segment's other bits."""
    rows = [F.struct(F.lit(start + b).alias("w"), (F.lit((start + b) << 22) + _bits(F.col("fp"), s).bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << b)))).alias("key")) for s, (start, width) in enumerate(SEGMENTS) for b in range(width)]
    return fps.select("*", F.explode(F.array(*rows)).alias("x")).select(*fps.columns, "x.w", "x.key")


def _first_variant(x, w):
    """Is w the first variant that two fingerprints with the xor x share? So a link is made under one variant only."""
    found, earlier = F.lit(False), F.lit(True)
    for s, (start, width) in enumerate(SEGMENTS):
        diff = _bits(x, s)
        own = F.when(diff == 0, F.lit(start)).otherwise(F.lit(start) + F.log2(F.greatest(diff, F.lit(1))).cast("int"))
        found = found | (earlier & (F.bit_count(diff) <= 1) & (w == own))
        earlier = earlier & (F.bit_count(diff) > 1)
    return found


def _near(a, b, distance: int):
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def _crowd_links(fps: DataFrame) -> DataFrame:
    """Exact links of many fingerprints: a star for each point within half the distance."""
    near = fps.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("i")).select("fp", "i", F.explode(F.sequence(F.col("i"), F.lit(63))).alias("j")).where("i < j or i < 0")
    bit = "(case when {0} >= 0 then shiftleft(1L, {0}) else 0L end)"
    points = near.select("fp", F.expr(f"fp ^ {bit.format('i')} ^ {bit.format('j')}").alias("p"))
    least = points.groupBy("p").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return points.join(least, "p").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def link_components(fps: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """fps: (fp, n) with distinct fp. Returns (fp, root) for those with a link."""
    if distance != DISTANCE:
        raise ValueError("segments and crowds are laid out for links of 4 bits")
    # Spark takes an exploded table for as small as what it is made of, so the joins on variants are told not to broadcast it
    variants = _variants(fps)
    groups = materialize(variants.groupBy("key").agg(F.max(F.struct("n", "fp")).alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.col("p.fp").alias("pivot"), "c"), "variants")
    stars = variants.join(groups.hint("merge"), "key").where((F.col("fp") != F.col("pivot")) & _near(F.col("fp"), F.col("pivot"), distance)).select(F.col("fp").alias("u"), F.col("pivot").alias("v"))
    crowds = groups.where(F.col("c") > crowd).select("key")
    crowded = crowds.limit(1).count() > 0
    if crowded:
        stars = stars.union(_crowd_links(variants.join(crowds, "key", "left_semi").select("fp").distinct()))
    first = materialize(connected_components(stars), "components")
    labelled = materialize(fps.join(first, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")), "labelled")
    members = _variants(labelled)
    if crowded:
        members = members.join(crowds, "key", "left_anti")
    a, b = members.select("key", "w", F.col("fp").alias("a"), F.col("root").alias("u")), members.select("key", F.col("fp").alias("b"), F.col("root").alias("v"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    pairs = a.join(b.hint("merge"), "key").where((F.col("a") < F.col("b")) & (F.col("u") != F.col("v")) & (F.bit_count(x) <= distance) & _first_variant(x, F.col("w")))
    second = materialize(connected_components(pairs.select("u", "v")), "components")
    joined = first.select(F.col("node").alias("fp"), F.col("root").alias("r")).join(second.select(F.col("node").alias("r"), F.col("root").alias("r2")), "r", "left").select("fp", F.coalesce("r2", "r").alias("root"))
    alone = second.select(F.col("node").alias("fp"), "root").join(first.select(F.col("node").alias("fp")), "fp", "left_anti")
    return joined.union(alone)


def _sketch_keys(sketch):
    segments, width = SKETCH
    return F.array(*[F.xxhash64(F.lit(s * width + out), *[F.get(sketch, F.lit(s * width + i)) for i in range(width) if i != out]) for s in range(segments) for out in range(width)])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float, screen=None) -> DataFrame:
    """Of pairs (a, b, u, v) of texts and their components, (u, v) of those whose texts are similar enough."""
    swap = F.col("a") > F.col("b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(swap, F.col("u")).otherwise(F.col("v")).alias("v"))
    pairs = pairs.groupBy("a", "b").agg(F.first("u").alias("u"), F.first("v").alias("v"))
    pairs = materialize(screen(pairs) if screen else pairs, "candidates")
    one, two = sets.select(F.col("t").alias("a"), F.col("s").alias("x")), sets.select(F.col("t").alias("b"), F.col("s").alias("y"))
    both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    links = materialize(both.where(shared >= (F.size("x") + F.size("y") - shared) * similarity - 1e-9).select("u", "v").distinct(), "links")
    discard(pairs)
    return links


def _prefix_pairs(crowded: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """crowded: (t, root). Pairs (a, b, u, v) of different roots, among them each that is similar enough.

    Any one order of all shingles gives a right prefix; rare ones first gives few candidates. How many shingles fall to each of ``COUNTS`` remainders
    is enough to tell frequent ones and is of a fixed size.
    """
    own = sets.join(crowded.hint("merge"), "t").select("t", "root", "s")
    found = own.select(F.explode("s").alias("s")).groupBy(F.pmod("s", F.lit(COUNTS)).alias("k")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts = np.zeros(COUNTS, dtype=np.int64)
    counts[found["k"].to_numpy(dtype=np.int64)] = found["n"].to_numpy()
    shared = own.sparkSession.sparkContext.broadcast(counts)

    @F.pandas_udf("array<long>")
    def prefix(parts: pd.Series) -> pd.Series:
        out = []
        for x in parts:
            x = np.asarray(x, dtype=np.int64)
            out.append(x[np.lexsort([x, shared.value[x % COUNTS]])][: len(x) - int(np.ceil(len(x) * similarity - 1e-9)) + 1])
        return pd.Series(out, dtype=object)

    keyed = materialize(own.select("t", "root", F.size("s").alias("size"), F.posexplode(prefix("s")).alias("at", "s")), "prefixes")
    other = keyed.select("s", F.col("t").alias("b"), F.col("root").alias("v"), F.col("size").alias("size_b"), F.col("at").alias("at_b"))
    # from their first common shingle on, two texts share at most what is left of either
    left = F.least(F.col("size") - F.col("at"), F.col("size_b") - F.col("at_b"))
    near = left * (1 + similarity) >= (F.col("size") + F.col("size_b")) * similarity - 1e-9
    return keyed.withColumnsRenamed({"t": "a", "root": "u"}).join(other.hint("merge"), "s").where((F.col("a") < F.col("b")) & (F.col("u") != F.col("v")) & near).select("a", "b", "u", "v")


def similar_roots(docs: DataFrame, text_col: str, texts: DataFrame, similarity: float, shingle: int, screen=None) -> DataFrame:
    """(root, to): the components that meet others, and what they become where texts are similar.

    texts, a written table that is deleted here: (t, k, root, size, keys): a number, the digest of a text, its component, its number of different
    shingles, and the keys under which it meets others. ``screen`` takes pairs (a, b, u, v) and returns those that are worth a verification.
    """
    keyed = texts.select("t", F.explode("keys").alias("key"))
    # what is joined with many rows of a key is written first: only a join that shuffles both sides itself can be split
    counts = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "counts")
    met = materialize(keyed.join(counts.hint("merge"), "key"), "variants")
    discard(counts)
    # the text that meets most others is in the middle of its group, so most of the group links to it
    meets = met.groupBy("t").agg(F.sum("c").alias("met"))
    asked = materialize(texts.join(meets.hint("merge"), "t").select("t", "k", "root", "size", "met"), "asked")
    own = docs.select(text_key(F.col(text_col)).alias("k"), F.col(text_col).alias("text")).join(asked.select("k", "t").hint("merge"), "k").dropDuplicates(["t"])
    sets = materialize(own.select("t", _once(_shingles, "array<long>", shingle)(F.col("text")).alias("s")), "shingles")
    members = materialize(met.join(asked.select("t", "root", F.col("root").alias("was"), "size", "met").hint("merge"), "t"), "members")
    was = materialize(asked.select(F.col("root").alias("was"), "root").distinct(), "was")
    discard(met, texts, asked)

    def merge(members: DataFrame, pairs: DataFrame) -> DataFrame:
        """members with the components that they have after the links among pairs; so has was."""
        nonlocal was
        links = _verified(pairs, sets, similarity, screen)
        components = connected_components(links)
        found = materialize(components, "components")
        renamed = found.select(F.col("node").alias("root"), F.col("root").alias("r")).hint("merge")
        out, old = [materialize(x.join(renamed, "root", "left").withColumn("root", F.coalesce("r", "root")).select(x.columns), "members") for x in (members, was)], was
        was = out[1]
        discard(links, components, found, old)
        free_shuffles(members.sparkSession)
        return out[0]

    near = F.least("size", "size_b") >= F.greatest("size", "size_b") * similarity - 1e-9
    for turn in range(TURNS):
        order = F.struct(-F.col("met"), F.xxhash64("t"), "t", "root", "size") if turn == 0 else F.struct(F.lit(0).cast("long"), F.xxhash64("key", "t", F.lit(turn)), "t", "root", "size")
        mixed = members.groupBy("key").agg(F.min(order).alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        pivots = materialize(mixed.select("key", F.col("p.t").alias("b"), F.col("p.root").alias("v"), F.col("p.size").alias("size_b")), "pivots")
        met = materialize(members.join(pivots.hint("merge"), "key"), "members")
        discard(members, pivots)
        stars = met.where(F.col("root") != F.col("v")).where(near).select(F.col("t").alias("a"), "b", F.col("root").alias("u"), "v")
        members = merge(met.drop("b", "v", "size_b"), stars)
        discard(met)
    few = members.where(F.col("c") <= PAIRED)
    other = few.select("key", F.col("t").alias("b"), F.col("root").alias("v"), F.col("size").alias("size_b"))
    pairs = few.select("key", F.col("t").alias("a"), F.col("root").alias("u"), "size").join(other.hint("merge"), "key").where((F.col("a") < F.col("b")) & (F.col("u") != F.col("v")) & near).select("a", "b", "u", "v")
    members, old = merge(members, pairs), members
    discard(old)
    mixed = members.where(F.col("c") > PAIRED).groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    crowded = materialize(members.join(mixed.hint("merge"), "key").select("t", "root").distinct(), "crowded")
    merge(crowded, _prefix_pairs(crowded, sets, similarity))
    discard(members, sets, crowded)
    return was.select(F.col("was").alias("root"), F.col("root").alias("to"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, crowd: int = CROWD, similarity: float | None = None) -> DataFrame:
    """(id, k, fp, first) for each row; k: digest of the text; first: (no_id, id, k) of the group's first document."""
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    if similarity is not None:
        named = named.withColumn("sketch", _once(_sketch, "array<long>", shingle)(F.col("__text")))
    sketches = ["sketch"] if similarity is not None else []
    rows = materialize(fingerprints(named, "__text", shingle).select("id", text_key(F.col("__text")).alias("k"), F.col("__fp").alias("fp"), *sketches), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "k")).alias("first")), "distinct")
    linked = link_components(fps.select("fp", "n"), distance, crowd)
    roots = materialize(fps.join(linked, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    if similarity is not None:
        named = rows.where(F.col("sketch").isNotNull()).groupBy("k").agg(F.first("fp").alias("fp"), F.first("sketch").alias("sketch"))
        size = F.get("sketch", F.lit(SKETCH[0] * SKETCH[1]))
        texts = materialize(named.join(roots.select("fp", "root"), "fp").select(F.monotonically_increasing_id().alias("t"), "k", "root", size.alias("size"), _sketch_keys(F.col("sketch")).alias("keys")), "sketches")
        to = similar_roots(docs, text_col, texts, similarity, shingle)
        roots = materialize(roots.join(to.hint("merge"), "root", "left").select("fp", "first", F.coalesce("to", "root").alias("root")), "roots")
    firsts = roots.groupBy("root").agg(F.min("first").alias("first"))
    return rows.drop("sketch").join(roots.select("fp", "root").join(firsts, "root").select("fp", "first"), "fp")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = DISTANCE, similarity: float | None = 0.8) -> DataFrame:
    """The rows of docs, all columns, that come first in their group: one row of each group."""
    groups = materialize(near_duplicate_groups(docs, id_col, text_col, shingle, distance, similarity=similarity), "groups")
    first = groups.where(F.struct(F.col("id").isNull().alias("no_id"), "id", "k") == F.col("first")).groupBy("id", "k").agg(F.count(F.lit(1)).alias("n"))
    first = materialize(first.select(F.col("id").alias("__id"), F.col("k").alias("__k"), F.col("n").alias("__n")), "first")
    kept = docs.join(first, docs[id_col].eqNullSafe(F.col("__id")) & (text_key(docs[text_col]) == F.col("__k")), "left_semi")
    if first.where("__n > 1").limit(1).count():
        kept = kept.withColumn("__k", text_key(F.col(text_col))).dropDuplicates([id_col, "__k"]).drop("__k")
    return kept


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))

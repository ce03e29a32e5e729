"""MinHash near-duplicates by SetSketch registers: exponentially spaced, truncated minima.

A document's set is its distinct shingles. Each of ``BANDS`` * ``ROWS`` registers takes an independent exponential variable
for each shingle; it keeps the least, as ``1 - log_b`` of it, rounded down and cut off at 0 and ``Q`` + 1. Registers of a union are the greater ones
of both sides, so sketches merge, and the values of similar sets agree with a probability close to their Jaccard similarity (``BASE`` near 1).

Search: documents meet under a band of equal register values. Two documents of similarity 0.85 miss each other in all 24 bands of 5 with a
probability below 1e-6, more similar ones with less. Estimate: for a pair that meets, the counts of registers that are greater, less and
equal, together with both sizes, have a likelihood that is concave in the similarity; a pair whose likelihood at the threshold lies ``NATS``
below the best one is left (a pair at the threshold is left with a probability under 1e-6). Verify: what remains is counted on whole shingle sets.

Equal sets collapse first. Only components are wanted, so groups aren't written out pair by pair; hot bands are
resolved by pivots and then by an exact prefix of rare shingles, as in simhash.similar_roots, which loses no pair that meets.

Defined results: null, empty and wordless texts have empty sets, link with nothing and are their own components. A component's id is its least non-null
document id; a document without an id that links with none has no component id and is kept. Ids may repeat; equal rows are one set and each get a row.
Texts of any length are hashed whole, block by block. An empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_key
from .simhash import _hashes, similar_roots

SHINGLE = 5
SIMILARITY = 0.85
BANDS, ROWS = 24, 5
#: The base of the registers' scale, the rate of the exponential variables, and the last value but one.
BASE, RATE, Q = 1.001, 20.0, (1 << 16) - 2
#: How far the threshold's likelihood may lie below the best one.
NATS = 14.0
_M = BANDS * ROWS
_DRAWN = np.random.default_rng(2024).integers(0, 1 << 64, (3, _M), dtype=np.uint64)
_XORS, _FACTORS, _MIX = _DRAWN[0], _DRAWN[1] | np.uint64(1), _DRAWN[2] | np.uint64(1)


def registers(minima: np.ndarray) -> np.ndarray:
    """Register values from the least 64-bit uniform values of a set."""
    exponential = -np.log1p(-(minima.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, Q + 1).astype("<u2")


def sketch(text: str | None, shingle: int = SHINGLE) -> tuple[int, bytes, bytes | None, list[int]]:
    """Number of different shingles, digest of the set, registers, band keys."""
    least, blocks = np.full(_M, np.iinfo(np.uint64).max, dtype=np.uint64), []
    for h in _hashes(text, shingle):
        for at in range(0, len(h), 1 << 10):
            np.minimum(least, ((h[at : at + (1 << 10), None] ^ _XORS) * _FACTORS).min(axis=0), out=least)
        blocks.append(np.unique(h))
    if not blocks:
        return 0, b"", None, []
    own = np.unique(np.concatenate(blocks)).astype("<u8")
    k = registers(least)
    keys = (k.astype(np.uint64) * _MIX).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) ^ (np.arange(BANDS, dtype=np.uint64) << np.uint64(59))
    return len(own), hashlib.md5(own.tobytes()).digest(), k.tobytes(), keys.view(np.int64).tolist()


def likelihood(more: np.ndarray, less: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Log-likelihood of a Jaccard similarity, from the numbers of a's registers that are greater and less than b's, and the sets' sizes."""
    share = size_a / (size_a + size_b)
    part = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = part(share - (1 - share) * similarity), part(1 - share - share * similarity)
    return more * np.log(up) + less * np.log(down) + (_M - more - less) * np.log(np.clip(1 - up - down, 1e-12, 1))


def likely(a: list[bytes], b: list[bytes], size_a: np.ndarray, size_b: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Which pairs of sketches may have that similarity."""
    x, y = (np.frombuffer(b"".join(z), dtype="<u2").reshape(-1, _M) for z in (a, b))
    more, less = (x > y).sum(axis=1), (x < y).sum(axis=1)
    bound = np.minimum(size_a, size_b) / np.maximum(size_a, size_b)  # no two sets are more similar
    best = np.full(len(x), -np.inf)
    for step in range(65):
        best = np.maximum(best, likelihood(more, less, size_a, size_b, bound * step / 64))
    top = np.maximum(similarity, np.minimum(bound, 1 - more / _M - less / _M))
    asked = np.maximum(likelihood(more, less, size_a, size_b, np.minimum(similarity, bound)), likelihood(more, less, size_a, size_b, np.minimum(top, bound)))
    return asked >= best - NATS


def _likely(similarity: float):
    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series, size_a: pd.Series, size_b: pd.Series) -> pd.Series:
        return pd.Series(likely(list(a), list(b), size_a.to_numpy(), size_b.to_numpy(), similarity) if len(a) else [], dtype=bool)

    return run


def _sketches(shingle: int):
    @F.pandas_udf("n long, digest binary, sketch binary, keys array<long>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            known: dict = {}
            yield pd.DataFrame([known[t] if t in known else known.setdefault(t, sketch(t, shingle)) for t in texts], columns=["n", "digest", "sketch", "keys"])

    return run


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(id, n, component) for each row: the size of its set and the least id it reaches by links."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("k"), _sketches(shingle)(text).alias("x")).select("id", "k", "x.*"), "sketches")
    one = rows.where("n > 0").groupBy("digest").agg(F.first(F.struct("k", "n", "sketch", "keys")).alias("x"), F.min("id").alias("first"))
    sets = materialize(one.select(F.monotonically_increasing_id().alias("t"), "digest", "first", "x.*"), "sets")
    texts = materialize(sets.select("t", "k", F.col("t").alias("root"), F.col("n").alias("size"), "keys"), "texts")

    def screen(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("t").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("n").alias(f"n_{x}")).hint("merge") for x in "ab")
        return pairs.join(a, "a").join(b, "b").where(_likely(similarity)("sketch_a", "sketch_b", "n_a", "n_b")).select(pairs.columns)

    to = similar_roots(docs, text_col, texts, similarity, shingle, screen)
    rooted = materialize(sets.select("t", "digest", "first").join(to.select(F.col("root").alias("t"), "to").hint("merge"), "t", "left").select("digest", "first", F.coalesce("to", "t").alias("root")), "roots")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component"))
    found = rooted.join(firsts.hint("merge"), "root").select("digest", "component")
    linked = rows.where("n > 0").select("id", "n", "digest").join(found.hint("merge"), "digest").select("id", "n", "component")
    return linked.union(rows.where("n = 0").select("id", "n", F.col("id").alias("component")))


def op11_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


OP11_SQL = """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words),
shingles as (select doc_id, len(s) as n, unnest(s) as g from sets),
shared as (select a.doc_id as u, b.doc_id as v, a.n + b.n as total, count(*) as c from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2, 3),
links as (select u, v from shared where 100 * c >= 85 * (total - c)),
edges as (select u, v from links union all select v, u from links),
reach as (select doc_id as u, doc_id as m from sets union select e.v, r.m from reach r join edges e on e.u = r.u where r.m < e.v),
least as (select u, min(m) as m from reach group by u)
select doc_id, len(s)::bigint as n_shingles, m as component_id, doc_id = m as kept from sets join least on u = doc_id
"""

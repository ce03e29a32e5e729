"""Language identification by prediction by partial matching (PPM).

Training: from each language a bounded sample of its different labelled texts (the ``SAMPLE_ROWS`` of lowest seeded hash, whole)
gives counts of byte strings of length 1 to ``ORDER`` + 1, gathered by the executors. They form a context tree per
language. Frozen afterwards, a context of n bytes, seen N times with T different successors, codes a successor seen c
times with probability c / (N + T) and escapes to the next shorter context with T / (N + T) (escape method C, without
exclusions); below the empty context all 256 bytes are equal. A text's code length under a language is the sum over its
bytes; the shortest code wins, ties go to the smaller name.

Code lengths are rounded to 2**-16 bit and summed as integers, so the result depends on the text alone, not on batches.
Scoring needs no per-byte loop: the deepest known string ending at each byte is found by table look-up for whole blocks.

Defined results: a null text, and one without any letter, is ``und`` with score 0. Where no labelled row exists, all are
``und``. Rows may repeat. Texts of any length are scored whole, block by block. An empty table gives an empty one. Columns named in ``keep`` are passed
on; others are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Bytes of context; tables are laid out for 3.
ORDER = 3
#: Labelled rows of each language that are learned from: a bound on the model, not on what is predicted.
SAMPLE_ROWS = 400
#: Bytes that are scored at once.
BLOCK = 1 << 19
UNIT = 1 << 16
#: Known byte pairs up to which the deepest contexts are found by position, in a table of their square; more are searched.
DENSE_PAIRS = 4096
HELD_OUT = 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(HELD_OUT)) == 0, F.lit(True))


def _padded(text: str) -> np.ndarray:
    return np.frombuffer(b"\n" * ORDER + text.encode("utf-8", "surrogatepass"), dtype=np.uint8)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of all strings of ORDER + 1 bytes (big-endian); shorter contexts are sums of these."""
    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            for text in texts:
                b = _padded(text).astype(np.int64)
                gram = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
                key, n = np.unique(gram, return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": key, "n": n})


@dataclass
class ContextTrees:
    """Per known string its code length in each language (languages in columns), by length of the string."""

    langs: list[str]
    pair_id: np.ndarray  # 65536 -> dense number of a known pair, 0: unknown
    row4: np.ndarray  # (pair, pair) -> row of cost4, 0: unknown; empty where that would be too large, then keys4 is searched
    keys4: np.ndarray  # the pairs of cost4, sorted
    cost4: np.ndarray
    esc3: np.ndarray  # row of a known 3-byte context -> cost of leaving it
    row3: np.ndarray  # (pair, byte) -> row of cost3 and esc3, 0: unknown
    cost3: np.ndarray
    cost2: np.ndarray  # (65536, languages), complete
    esc2: np.ndarray

    def totals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code length of data[s:e] for each s, e; ORDER bytes of context stand before each s."""
        first = data[ORDER:]
        pairs = (data[:-1].astype(np.int32) << 8) | data[1:]
        ids = self.pair_id[pairs]
        n_pairs = np.int32(self.row3.shape[0])
        if len(self.row4):
            row = self.row4[ids[:-2] * n_pairs + ids[2:]]
        else:
            pair = ids[:-2].astype(np.int64) * n_pairs + ids[2:]
            row = np.searchsorted(self.keys4, pair)
            row = np.where(self.keys4[np.minimum(row, len(self.keys4) - 1)] == pair, row + 1, 0)
        cost = self.cost4[row]
        if len(miss := np.flatnonzero(row == 0)):
            ctx = self.row3[ids[miss], data[miss + 2]]  # the three bytes before
            own = self.row3[ids[miss + 1], first[miss]]  # the last two and the byte itself
            c = self.esc3[ctx] + self.cost3[own]
            if len(deep := np.flatnonzero(own == 0)):
                c[deep] += self.esc2[pairs[miss[deep] + 1]] + self.cost2[pairs[miss[deep] + 2]]
            cost[miss] = c
        total = np.zeros((len(cost) + 1, len(self.langs)), dtype=np.int64)
        np.cumsum(cost, axis=0, out=total[1:])
        return total[ends - ORDER] - total[starts - ORDER]


def grow_trees(counts: pd.DataFrame, dense_pairs: int = DENSE_PAIRS) -> ContextTrees:
    """counts: lang, gram (4 bytes as an integer), n."""
    langs = sorted(counts["lang"].unique())
    L = len(langs)
    keys = {4: np.unique(counts["gram"].to_numpy(dtype=np.int64))}
    for k in (3, 2, 1):
        keys[k] = np.unique(np.concatenate([keys[k + 1] & ((1 << 8 * k) - 1), keys[k + 1] >> 8]))
    n = {4: np.zeros((len(keys[4]), L))}
    for j, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        np.add.at(n[4][:, j], np.searchsorted(keys[4], own["gram"].to_numpy(dtype=np.int64)), own["n"].to_numpy())
    for k in (3, 2, 1):  # a string's count: it ends where a longer one ends
        n[k] = np.zeros((len(keys[k]), L))
        np.add.at(n[k], np.searchsorted(keys[k], keys[k + 1] & ((1 << 8 * k) - 1)), n[k + 1])
    bits = lambda p: np.rint(-np.log2(p) * UNIT).astype(np.int64)
    base = np.full((256, L), 8 * UNIT, dtype=np.int64)

    def level(k: int, shorter: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs of keys[k] given those of their last k - 1 bytes, and the escape cost of each of the contexts."""
        at = np.searchsorted(contexts, keys[k] >> 8)
        total, kinds = np.zeros((len(contexts), L)), np.zeros((len(contexts), L))
        np.add.at(total, at, n[k])
        np.add.at(kinds, at, n[k] > 0)
        esc = np.where(total > 0, bits(np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1)), 0)
        p = np.where(n[k] > 0, n[k] / np.maximum(total + kinds, 1)[at], 1)
        return np.where(n[k] > 0, bits(p), esc[at] + shorter), esc

    c1, esc0 = level(1, base[keys[1]], np.array([0]))
    cost1 = esc0 + base
    cost1[keys[1]] = c1
    c2, e1 = level(2, cost1[keys[2] & 255], keys[1])
    esc1 = np.zeros((256, L), dtype=np.int64)
    esc1[keys[1]] = e1
    cost2 = (esc1[:, None, :] + cost1[None, :, :]).reshape(65536, L)
    cost2[keys[2]] = c2
    c3, e2 = level(3, cost2[keys[3] & 0xFFFF], keys[2])
    esc2 = np.zeros((65536, L), dtype=np.int64)
    esc2[keys[2]] = e2
    pair_id = np.zeros(65536, dtype=np.int32)
    pair_id[keys[2]] = np.arange(1, len(keys[2]) + 1)
    n_pairs = len(keys[2]) + 1
    row3 = np.zeros((n_pairs, 256), dtype=np.int32)
    row3[pair_id[keys[3] >> 8], keys[3] & 255] = np.arange(1, len(keys[3]) + 1)
    c4, e3 = level(4, c3[np.searchsorted(keys[3], keys[4] & 0xFFFFFF)], keys[3])
    keys4 = pair_id[keys[4] >> 16].astype(np.int64) * n_pairs + pair_id[keys[4] & 0xFFFF]
    row4 = np.zeros(n_pairs * n_pairs if n_pairs <= dense_pairs else 0, dtype=np.int32)
    if len(row4):
        row4[keys4] = np.arange(1, len(keys4) + 1)
    zero = np.zeros((1, L), dtype=np.int64)
    narrow = lambda a: np.concatenate([zero, a]).astype(np.int32)
    return ContextTrees(langs, pair_id, row4, keys4, narrow(c4), narrow(e3), row3, narrow(c3), cost2.astype(np.int32), esc2.astype(np.int32))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> ContextTrees | None:
    """Trees from rows with text and language. The driver sees counts of a bounded sample, never texts."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(7)))
    by_lang = rows.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("total"))
    by_lang = F.broadcast(by_lang) if by_lang.limit(10_001).count() <= 10_000 else by_lang
    # a first, loose cut by hash keeps the exact one cheap: of h's range each language keeps 4 times what it needs
    share = F.least(F.lit(1.0), F.lit(4.0 * sample_rows + 100) / F.col("total"))
    loose = rows.join(by_lang, "lang").where(F.pmod("h", F.lit(1 << 30)) <= share * (1 << 30)).dropDuplicates(["lang", "text"])
    sample = loose.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= sample_rows)
    counts = sample.select("lang", "text").mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return grow_trees(counts) if len(counts) else None


def _score(trees: ContextTrees, texts: list[str]) -> np.ndarray:
    """Code lengths (texts, languages); blocks of whole short texts, or parts of a long one."""
    out = np.zeros((len(texts), len(trees.langs)), dtype=np.int64)
    parts: list[np.ndarray] = []
    spans: list[tuple[int, int, int]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if spans:
            who, starts, ends = (np.array(x) for x in zip(*spans, strict=True))
            np.add.at(out, who, trees.totals(np.concatenate(parts), starts, ends))
        parts.clear()
        spans.clear()
        size = 0

    for i, text in enumerate(texts):
        b = _padded(text)
        for s in range(ORDER, len(b), BLOCK):
            part = b[s - ORDER : s + BLOCK]
            spans.append((i, size + ORDER, size + len(part)))
            parts.append(part)
            size += len(part)
            if size >= BLOCK:
                flush()
    flush()
    return out


def identify(docs: DataFrame, trees: ContextTrees | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, lang_pred, score, bits_per_byte) per row. score: the winner's share of 2**-(bits), that is its posterior."""
    spark = docs.sparkSession
    rows = docs.select(id_col, *keep, F.col(text_col).alias("__text"))
    has_letter = F.coalesce(F.col("__text").rlike("\\p{L}"), F.lit(False))
    if trees is None:
        return rows.select(id_col, *keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    model = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = model.value
        known = texts.notna().to_numpy()
        bits = _score(m, [t for t in texts if t is not None]) / UNIT
        lang, score, rate = np.full(len(texts), "und", dtype=object), np.zeros(len(texts)), np.full(len(texts), np.nan)
        if known.any():
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(bits)), best]
            lang[known] = np.array(m.langs, dtype=object)[best]
            score[known] = 1 / np.exp2(np.minimum(least[:, None] - bits, 0)).sum(axis=1)
            rate[known] = least / np.maximum(1, [len(t.encode("utf-8", "surrogatepass")) for t in texts if t is not None])
        return pd.DataFrame({"lang_pred": lang, "score": score, "bits_per_byte": rate})

    return rows.select(id_col, *keep, predict(F.when(has_letter, F.col("__text"))).alias("p")).select(id_col, *keep, "p.lang_pred", "p.score", "p.bits_per_byte")


def op2_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.withColumn("held_out", held_out(F.col("doc_id"))), trees, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")

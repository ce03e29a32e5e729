"""Target-distribution importance resampling: documents are drawn by how much likelier their n-grams are in a target text.

Features are runs of 1 to ``NGRAM`` words, each told by its bucket (CRC-32 modulo ``BUCKETS``). A bucket's gain is the
logarithm of its smoothed share of the target's features over that of the documents', in whole thousandths; a document's weight is the
mean gain of its features. Gumbel noise from a keyed hash of the id makes the order of weight plus noise a draw without
replacement by importance.

Scale: counts come down to one row a bucket and task before they are shuffled. The gains are one array of fixed length, sent along
with every task, so a document is scored in its own row without a join on features. Scores are whole numbers, and their span is
bounded: a gain lies within 1000 * (ln(T + B) + ln(S + B)) of zero and noise in -3,200 to 22,900, so even counts of 64 bits give fewer
than ``SPAN`` different scores. The histogram of scores therefore has a fixed bound; its counts, summed up from the highest
score down, say how many documents stand before each score, and at which score the draw ends. Only rows of scores that are drawn
are numbered, each score by itself, by id: no global sort. Noise spreads copies too: no score holds more than some 0.04 % of the documents.

Defined results: a null, empty or wordless text has no features and weight 0; it is never drawn when ``min_words`` is over 0. A null id counts as an empty
string in the hash and comes after all others; rows of one id and score are numbered in any order, so equal rows get neighbouring
ranks. Without documents nothing is drawn; without a target all its counts are 0. Texts of any length are read whole. Other columns, whatever
their names, are not read; resample passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, text_key

BUCKETS = 10_000
NGRAM = 2
SEED = 7
PERCENT = 25
MIN_WORDS = 20
#: More different scores than this can't occur.
SPAN = 250_000
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BLOCK = 1 << 20


def feature_hashes(text: str | None, ngram: int = NGRAM) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Block by block: the number of words, and the CRC-32 of every run of 1, 2, ... words. A run's is carried on from that of the run before its last word."""
    data, at, tail = (text or "").encode("utf-8", "surrogatepass").translate(_BYTES), 0, []
    while at < len(data):
        end = data.find(b" ", at + _BLOCK)
        end = len(data) if end < 0 else end
        words, skip = tail + data[at:end].split(), len(tail)
        runs = list(map(crc32, words))
        out = [np.array(runs[skip:], dtype=np.int64)]
        for n in range(2, ngram + 1):
            runs = list(map(crc32, words[n - 1 :], map(crc32, repeat(b" "), runs)))
            out.append(np.array(runs[max(0, skip - n + 1) :], dtype=np.int64))
        yield len(words) - skip, out
        at, tail = end, words[len(words) - ngram + 1 :] if ngram > 1 else []


def _counts(texts: DataFrame, name: str, buckets: int, ngram: int) -> DataFrame:
    """(bucket, name): how many features fall to each bucket; one row for each bucket and task before the shuffle."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, held, length = np.zeros(buckets, dtype=np.int64), [], 0
        for text in (text for part in parts for text in part["text"]):
            for _, runs in feature_hashes(text, ngram):
                held += runs
                length += sum(map(len, runs))
            if length > _BLOCK:
                n += np.bincount(np.concatenate(held) % buckets, minlength=buckets)
                held, length = [], 0
        if held:
            n += np.bincount(np.concatenate(held) % buckets, minlength=buckets)
        found = n.nonzero()[0]
        yield pd.DataFrame({"bucket": found, "n": n[found]})

    return texts.mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, ngram: int = NGRAM) -> np.ndarray:
    """The gain of each bucket, in thousandths."""
    own = _counts(docs.select(F.col(text_col).alias("text")), "s", buckets, ngram)
    counts = own.join(_counts(target.select(F.col(target_col).alias("text")), "t", buckets, ngram), "bucket", "full").na.fill(0)
    found = counts.toPandas()  # one row for each bucket at most
    s, t = np.zeros((2, buckets))
    s[found["bucket"]], t[found["bucket"]] = found["s"], found["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def noise(id_: Column, seed: int = SEED) -> Column:
    """Gumbel noise in whole thousandths, from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, ngram: int = NGRAM, seed: int = SEED) -> DataFrame:
    """A row for each of docs: __id, __k (digest of the text), n_words, n_features, weight, score."""
    shared = docs.sparkSession.sparkContext.broadcast(gains(docs, target, text_col, target_col, buckets, ngram))  # as many numbers as buckets

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weigh(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = []
            for text in texts:
                words = features = total = 0
                for n, runs in feature_hashes(text, ngram):
                    words += n
                    features += sum(map(len, runs))
                    total += sum(int(shared.value[run % buckets].sum()) for run in runs)
                rows.append((words, features, total // features if features else 0))
            yield pd.DataFrame(rows, columns=["n_words", "n_features", "weight"])

    out = docs.select(F.col(id_col).alias("__id"), text_key(F.col(text_col)).alias("__k"), weigh(F.col(text_col)).alias("x")).select("__id", "__k", "x.*")
    return out.withColumn("score", F.col("weight") + noise(F.col("__id"), seed))


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """scored, a written table, with rank: 1, 2, 3... for the drawn share of rows of at least min_words words, else null."""
    able = scored.where(F.col("n_words") >= min_words)
    found = able.groupBy("score").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("score", ascending=False)
    if len(found) > SPAN:
        raise ValueError(f"more than {SPAN} different scores")
    to_here = found["n"].cumsum()
    wanted = int(found["n"].sum()) * percent // 100
    found["before"] = to_here - found["n"]
    drawn = found[found["before"] < wanted][["score", "before"]]
    none = F.lit(None).cast("long").alias("rank")
    if not len(drawn):
        return scored.select("*", none)
    cutoff = F.lit(int(drawn["score"].min()))
    before = F.broadcast(scored.sparkSession.createDataFrame(drawn, "score long, before long"))  # at most SPAN rows
    numbered = able.where(F.col("score") >= cutoff).join(before, "score").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("__id").asc_nulls_last())))
    in_draw = numbered.select(*scored.columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return in_draw.union(scored.where((F.col("n_words") < min_words) | (F.col("score") < cutoff)).select("*", none))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn rows of docs, all columns. Rows equal in id and text are kept or left as often as they are drawn."""
    ranked = draw(materialize(importance(docs, target, id_col, text_col, target_col, seed=seed), "scores"), percent, min_words)
    drawn = ranked.where(F.col("rank").isNotNull()).groupBy("__id", "__k").agg(F.count(F.lit(1)).alias("__n"))
    again = Window.partitionBy(F.col(id_col), F.col("__key")).orderBy(F.lit(0))
    keyed = docs.withColumn("__key", text_key(F.col(text_col))).withColumn("__at", F.row_number().over(again))
    same = keyed[id_col].eqNullSafe(drawn["__id"]) & (keyed["__key"] == drawn["__k"]) & (keyed["__at"] <= drawn["__n"])
    return keyed.join(drawn, same, "left_semi").drop("__key", "__at")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = materialize(importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")), "scores")
    return draw(scored).select(F.col("__id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: CRC-32 in SQL: the table of 256 remainders, and a fold over a text's bytes. Names are of op12's and op13's queries.
CRC_TABLE = "crc as (select list(x order by i) as t from (select i, list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) as x from range(256) r(i)))"


def crc_sql(text: str) -> str:
    """SQL of the unsigned CRC-32 of a text, where the table crc is joined."""
    return f"xor(4294967295, list_reduce([4294967295::bigint] || list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::int, 2))::int::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


OP13_SQL = f"""
with {CRC_TABLE},
texts as (
  select 0 as kind, doc_id as id, text from documents union all select 1, item_id, text from benchmark),
words as (
  select row_number() over () as r, kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from texts),
runs as (
  select r, kind, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from words),
names as (select f, {crc_sql("f")} % 10000 as b from (select distinct f from runs), crc),
features as (select r, kind, b from runs join names using (f)),
counts as (select b, count(*) filter (kind = 0) as s, count(*) filter (kind = 1) as t from features group by b),
totals as (select sum(s)::double as ss, sum(t)::double as tt from counts),
gains as (select b, floor(1000 * ln((t + 1)::double * (ss + 10000) / ((s + 1)::double * (tt + 10000))))::bigint as gain from counts, totals),
weights as (select r, count(*) as n, floor(sum(gain)::double / count(*))::bigint as weight from features join gains using (b) where kind = 0 group by r),
scored as (
  select id as doc_id, len(w) as n_words, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from words left join weights using (r) where kind = 0),
ranked as (
  select *, case when n_words >= 20 then row_number() over (partition by n_words >= 20 order by score desc, doc_id) end as place, count(*) filter (n_words >= 20) over () as able from scored)
select doc_id, n_features, weight, score, case when place <= 25 * able // 100 then place end as rank from ranked
"""

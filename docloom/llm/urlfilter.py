"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

Every url is cut into (host, path); each host suffix at a dot, with each path prefix of a listed length, is a canonical
key that a list entry could have. A key that the Bloom filter refuses is certainly not listed. The few that pass are
joined with the list itself, so false positives never reach the result. The longest listed key decides.

Defined results: a null url or one without ``://`` has empty host and path, fits nothing and gets ``default``. Rows may
repeat; each is judged. Equal keys listed with different verdicts block. Of a long host only suffixes with no more labels than the longest listed one
are looked up: others can't be listed. An empty table gives an empty one, an empty list gives ``default``. Columns other than id and url are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, table

#: (host, path, verdict); a fixed policy.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
RULE_SCHEMA = "host string, path string, verdict string"
#: 32 bytes each: the filter is at most 32 MB, whatever the list's length; a fuller filter only passes more to the join.
MAX_BLOCKS = 1 << 20
KEYS_PER_BLOCK = 12
#: A list of at most so many entries is broadcast to the exact join; a longer one is shuffled.
BROADCAST_RULES = 100_000


def url_host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def build_filter(rules: DataFrame) -> np.ndarray:
    """A (blocks, 4) array of 64-bit words: a key sets one bit in each word of its block. Bounded by MAX_BLOCKS."""
    n = rules.count()
    blocks = int(min(MAX_BLOCKS, max(1, -(-n // KEYS_PER_BLOCK))))
    h = F.xxhash64(_key(F.col("host"), F.col("path")))
    bit = lambda w: F.bit_or(F.expr(f"shiftleft(1L, cast(shiftright(h, {6 * w}) & 63 as int))"))
    rows = rules.select(h.alias("h")).groupBy(F.expr(f"pmod(shiftrightunsigned(h, 24), {blocks}L)").alias("b")).agg(*[bit(w).alias(f"w{w}") for w in range(4)]).collect()
    words = np.zeros((blocks, 4), dtype=np.int64)
    for r in rows:
        words[r[0]] = r[1:]
    return words.view(np.uint64)


def _probe(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    u = h.view(np.uint64)
    block = ((u >> np.uint64(24)) % np.uint64(len(words))).astype(np.int64)
    ok = np.ones(len(u), dtype=bool)
    for w in range(4):
        ok &= (words[block, w] >> ((u >> np.uint64(6 * w)) & np.uint64(63))) & np.uint64(1) == 1
    return ok


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of pages."""
    spark = pages.sparkSession
    rules = rules.groupBy(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path")).agg(F.max("verdict").alias("verdict")).where(F.col("host").isNotNull())
    depth = rules.agg(F.max(F.size(F.split("host", "\\.", -1)))).first()[0] or 1
    lengths = sorted(r[0] for r in rules.select(F.length("path").alias("n")).distinct().collect())
    words = spark.sparkContext.broadcast(build_filter(rules))

    @F.pandas_udf(T.BooleanType())
    def maybe_listed(h: pd.Series) -> pd.Series:
        return pd.Series(_probe(words.value, h.to_numpy(dtype=np.int64)))

    judged = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    urls = judged.select("host", "path").distinct()
    labels = F.split("host", "\\.", -1)
    suffixes = F.transform(F.sequence(F.greatest(F.size(labels) - (depth - 1), F.lit(1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = (
        urls.where(F.col("host") != "")
        .select("host", "path", F.explode(suffixes).alias("r_host"))
        .select("host", "path", "r_host", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("n"))
        .where(F.length("path") >= F.col("n"))
        .select("host", "path", "r_host", F.substr("path", F.lit(1), F.col("n")).alias("r_path"))
    )
    passed = keys.where(maybe_listed(F.xxhash64(_key(F.col("r_host"), F.col("r_path")))))
    listed = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict")
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        listed = F.broadcast(listed)
    size = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), F.concat("r_host", "r_path").alias("rule"), "verdict")
    best = passed.join(listed, ["r_host", "r_path"]).groupBy("host", "path").agg(F.max(size).alias("best"))
    return judged.join(best, ["host", "path"], "left").select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, RULE_SCHEMA))


OP10_SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path,
  (SELECT rh || rp FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC, length(rh) DESC LIMIT 1) AS rule,
  coalesce((SELECT v FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC, length(rh) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""

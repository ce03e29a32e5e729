"""Statistics of two paired conditions, as single aggregates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mcnemar(df: DataFrame, on: Column, off: Column) -> DataFrame:
    """(b, c, statistic): pairs that differ either way, with continuity correction; 0 where none differ."""
    one = df.agg(F.count_if(on & ~off).alias("b"), F.count_if(~on & off).alias("c"))
    n = F.col("b") + F.col("c")
    return one.select("b", "c", F.round(F.when(n == 0, 0.0).otherwise((F.abs(F.col("b") - F.col("c")) - 1) ** 2 / n), 6).alias("statistic"))


def chi2_tail(x: float) -> float:
    """Probability of more than x under one degree of freedom."""
    return math.erfc(math.sqrt(x / 2))


def with_p_values(df: DataFrame, statistic: str | None = None, z: str | None = None) -> DataFrame:
    """df with p_value: of a statistic with one degree of freedom, or two-sided of a standard normal z; null where that is null."""

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: chi2_tail(v) if pd.notna(v) else None).astype("float64")

    return df.withColumn("p_value", tail(F.col(statistic).cast("double") if statistic else F.col(z) * F.col(z)))


def kappa(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """(n, kappa): Cohen's, null with fewer than two labels, 1 where chance agreement is whole."""
    cells = df.groupBy(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("k"))
    total = cells.agg(F.sum("k").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("k")).otherwise(0)).alias("same"))
    chance = cells.groupBy(F.col("a").alias("l")).agg(F.sum("k").alias("x")).join(cells.groupBy(F.col("b").alias("l")).agg(F.sum("k").alias("y")), "l", "full").agg(F.sum(F.coalesce("x", F.lit(0)) * F.coalesce("y", F.lit(0))).alias("xy"), F.count(F.lit(1)).alias("labels"))
    pe = F.col("xy") / (F.col("n") * F.col("n"))
    return total.join(chance).select("n", F.round(F.when(F.col("labels") < 2, None).when(pe == 1, 1.0).otherwise((F.col("same") / F.col("n") - pe) / (1 - pe)), 6).alias("kappa"))


def transitions(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.groupBy(F.coalesce(a.cast("string"), F.lit("NULL")).alias("label_off"), F.coalesce(b.cast("string"), F.lit("NULL")).alias("label_on")).agg(F.count(F.lit(1)).alias("n"))


def wilcoxon(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """(n, w_plus, w_minus, z): signed ranks of the differences that aren't 0, ties at their mean rank, z corrected for ties.

    Ranks come from counts of distinct differences, so only those are ordered.
    """
    d = df.select((a - b).cast("double").alias("d")).where("d <> 0")
    sizes = d.groupBy(F.abs("d").alias("m")).agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("d") > 0).alias("up"))
    below = F.sum("k").over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1))
    ranked = sizes.withColumn("rank", F.coalesce(below, F.lit(0)) + (F.col("k") + 1) / 2)
    k = F.col("k").cast("double")
    one = ranked.agg(F.sum("k").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("k") - F.col("up"))).alias("w_minus"), F.sum(k * k * k - k).alias("ties"))
    n = F.col("n").cast("double")
    z = (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return one.select("n", "w_plus", "w_minus", F.round(z, 6).alias("z"))


#: Differences up to which the signed ranks' distribution is counted out, if none tie.
EXACT_MOST = 50


def signed_rank_tail(n: int, w: float) -> float:
    """Two-sided probability of a rank sum as small as w among n differences without ties, all signs being equally likely."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for rank in range(1, n + 1):
        ways[rank:] = ways[rank:] + ways[: len(ways) - rank]
    return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))


def wilcoxon_p(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """(n, w_plus, w_minus, z, ties, p_value): by the exact distribution for up to EXACT_MOST differences without ties and zeros, else by the normal one; null without differences."""
    d = df.select((a - b).cast("double").alias("d")).where("d IS NOT NULL")
    sizes = d.groupBy(F.abs("d").alias("m")).agg(F.count(F.lit(1)).alias("k"))
    ties = sizes.agg(F.coalesce(F.sum(F.when((F.col("k") > 1) | (F.col("m") == 0), F.col("k")).otherwise(0)), F.lit(0)).alias("ties"))
    whole = wilcoxon(df, a, b).join(F.broadcast(ties))  # one row each

    @F.pandas_udf("double")
    def tail(n: pd.Series, low: pd.Series, z: pd.Series, ties: pd.Series) -> pd.Series:
        out = [None if pd.isna(k) or not k else signed_rank_tail(int(k), w) if k <= EXACT_MOST and not t else chi2_tail(x * x) for k, w, x, t in zip(n, low, z, ties)]
        return pd.Series(out, dtype="float64")

    return whole.select("n", "w_plus", "w_minus", "z", "ties", tail("n", F.least("w_plus", "w_minus"), "z", "ties").alias("p_value"))


def bootstrap_mean(df: DataFrame, value: Column, resamples: int = 1000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """One row (n, mean, low, high): percentile interval of the mean.

    A resample of rows is a multinomial draw over the distinct values, so values are counted first and each resample draws counts.
    Values should have few distinct levels (labels, differences of labels). Nulls take no part; without values all but n is null.
    """
    counts = df.select(value.cast("double").alias("x")).where("x IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("k"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("x")
        n = int(f.k.sum())
        means = np.random.default_rng(seed).multinomial(n, f.k / n, resamples) @ f.x.to_numpy() / n
        low, high = np.percentile(means, [50 * (1 - level), 50 * (1 + level)])
        return pd.DataFrame({"n": [n], "mean": [float((f.x * f.k).sum() / n)], "low": [low], "high": [high]})

    out = counts.groupBy(F.lit(0).alias("g")).applyInPandas(run, "n long, mean double, low double, high double")
    return out.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("mean").alias("mean"), F.max("low").alias("low"), F.max("high").alias("high"))


#: Chances of a count of at most 0, 1, 2... in a Poisson distribution of mean 1, as far as 53 bits can tell.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(19)])
_ROWS = 512


def _weights(h: np.ndarray, xors: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """How often each row, by its hash, is drawn in each resample."""
    z = (h[:, None] ^ xors) * factors
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.searchsorted(_POISSON, (z >> np.uint64(11)).astype(np.float64) / 2.0**53, "right").astype(np.float64)


def bootstrap(df: DataFrame, group: list[str], row_id: list[str], parts: dict[str, Column], statistic: Callable[[dict[str, Column]], Column], resamples: int = 1000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(group, n, value, low, high): percentile interval of any statistic of sums, per group.

    ``parts``: what is summed up, a null counts as 0; ``statistic`` makes the value of the sums (``n`` among them, the number of rows). In each resample a row is drawn a Poisson number
    of times, from a hash of its id and the resample, so a task draws its rows by itself, a recomputed task draws the same, and partial sums add up: a
    row per task, group and resample is shuffled. Rows of one id are drawn together. A resample that draws no row of a group doesn't
    count for it. Without rows there is no group.
    """
    r = np.random.default_rng(seed)
    xors, factors = r.integers(0, 1 << 64, (2, resamples), dtype=np.uint64)
    factors |= np.uint64(1)
    names = list(parts)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        kept: dict[tuple, tuple] = {}
        for pdf in batches:
            for key, f in pdf.groupby(pdf["__key"]):
                kept.setdefault(key, tuple(f[g].iloc[0] for g in group))
                for at in range(0, len(f), _ROWS):
                    g = f.iloc[at : at + _ROWS]
                    x = np.column_stack([np.ones(len(g)), g[names].fillna(0.0).to_numpy(dtype=np.float64)])
                    w = np.column_stack([np.ones(len(g)), _weights(g["__h"].to_numpy().view(np.uint64), xors, factors)])
                    total[key] = total.get(key, 0.0) + w.T @ x
        for key, s in total.items():
            out = pd.DataFrame(s, columns=["n", *names]).assign(resample=np.arange(-1, resamples))
            yield out.assign(**dict(zip(group, kept[key])))[[*group, "resample", "n", *names]]

    rows = df.select(*group, F.xxhash64(*row_id, F.lit(seed)).alias("__h"), F.to_json(F.struct(*group)).alias("__key") if group else F.lit("").alias("__key"), *[c.cast("double").alias(n) for n, c in parts.items()])
    kinds = ", ".join(f"`{g}` {dict(df.dtypes)[g]}" for g in group)
    schema = f"{kinds + ', ' if group else ''}resample int, n double, " + ", ".join(f"`{n}` double" for n in names)
    drawn = rows.mapInPandas(sums, schema).groupBy(*group, "resample").agg(*[F.sum(n).alias(n) for n in ["n", *names]]).where("n > 0")
    value = drawn.select(*group, "resample", "n", statistic({n: F.col(n) for n in ["n", *names]}).alias("value"))
    own, other = F.col("resample") < 0, F.col("resample") >= 0
    ends = [50 * (1 - level) / 100, 50 * (1 + level) / 100]
    return value.groupBy(*group).agg(
        F.max(F.when(own, F.col("n"))).cast("long").alias("n"), F.max(F.when(own, F.col("value"))).alias("value"),
        *[F.percentile(F.when(other, F.col("value")), F.lit(e)).alias(name) for e, name in zip(ends, ("low", "high"))],
    )

"""Runs of a model under conditions and what they say of each other; fields taken over from a second reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import is_refusal, strip_reasoning
from docloom.operators.checks import filled

#: Fixed value: how many times as many letters a second reading needs to be the richer one.
RICHER = 1.2


def rates(replies: DataFrame, keys: list[str], schema_valid: str, semantic_valid: str, parsed: str, raw: str, tokens: str) -> DataFrame:
    """(keys, n, schema_validity_rate, semantic_validity_rate, parse_failure_rate, think_leak_rate, refusal_rate, mean_completion_tokens) of replies.

    A failure to parse is a reply that isn't valid and has nothing parsed; a leak one that changes when its reasoning goes. Null flags count for no rate, a null reply is none of both.
    """
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    text = F.coalesce(F.col(raw), F.lit(""))
    return replies.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), share(F.col(schema_valid)).alias("schema_validity_rate"), share(F.col(semantic_valid)).alias("semantic_validity_rate"),
        share(~F.col(schema_valid) & F.col(parsed).isNull()).alias("parse_failure_rate"), share(strip_reasoning(text) != F.trim(text)).alias("think_leak_rate"),
        share(is_refusal(text)).alias("refusal_rate"), F.round(F.avg(tokens), 6).alias("mean_completion_tokens"),
    )


def averages(of_rates: DataFrame, key: str) -> DataFrame:
    """(key, and the mean of every rate over the conditions, nulls left out)."""
    names = [c for c in of_rates.columns if c.endswith("_rate") or c.startswith("mean_")]
    return of_rates.groupBy(key).agg(*[F.round(F.avg(c), 6).alias(c) for c in names])


def paired(replies: DataFrame, keys: list[str], condition: str, on: str, off: str, values: list[str]) -> DataFrame:
    """(keys, value_on, value_off): rows of both conditions side by side; what only one of them has takes no part."""
    side = lambda name, mark: replies.where(F.col(condition) == name).select(*keys, *[F.col(v).alias(f"{v}_{mark}") for v in values])
    return side(on, "on").join(side(off, "off"), keys)


def determinism(first: DataFrame, second: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, identical, stripped_identical) of replies that both runs have: byte for byte, and without blanks around. Two nulls are identical."""
    blanks = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    both = first.select(*keys, F.col(text).alias("__a")).join(second.select(*keys, F.col(text).alias("__b")), keys)
    return both.select(*keys, F.col("__a").eqNullSafe(F.col("__b")).alias("identical"), blanks("__a").eqNullSafe(blanks("__b")).alias("stripped_identical"))


def determinism_rates(compared: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, identical_rate, stripped_identical_rate, mismatches)."""
    return compared.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("identical").cast("int")), 6).alias("identical_rate"), F.round(F.avg(F.col("stripped_identical").cast("int")), 6).alias("stripped_identical_rate"), F.count_if(~F.col("identical")).alias("mismatches"))


def first_rows(df: DataFrame, group: str, order: list, most: dict, default: int = 5) -> DataFrame:
    """The first rows of each group in the given order, as many as the map says for it, else the default; a number below 1 takes none."""
    known = F.coalesce(*[F.when(F.col(group).eqNullSafe(F.lit(g)), F.lit(n)) for g, n in most.items()], F.lit(default))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= known)


def taken_over(base: dict[str, Column], extra: dict[str, Column], base_text: Column, extra_text: Column, letters: str = "가-힣", always: bool = False) -> Column:
    """struct(fields, added, adopted, richer): a second reading fills the fields that the first left empty.

    It is adopted if it fills any, or ``always``, or if fields are still missing and it has over RICHER times as many letters; else nothing of it is taken. ``richer`` says that its text should
    stand for the document's from then on.
    """
    has = {k: filled(v) for k, v in base.items()}
    new = {k: ~has[k] & filled(extra[k]) for k in base}
    count = lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), f"[^{letters}]+", ""))
    richer, complete = count(extra_text) > count(base_text) * RICHER, F.lit(True)
    for v in has.values():
        complete = complete & v
    added = F.array_compact(F.array(*[F.when(new[k], F.lit(k)) for k in base]))

    def decided(s: Column) -> Column:
        adopted = (F.size(s["added"]) > 0) | F.lit(always) | (~s["complete"] & s["richer"])
        return F.struct(F.struct(*[F.when(new[k], extra[k]).otherwise(base[k]).alias(k) for k in base]).alias("fields"), s["added"].alias("added"), adopted.alias("adopted"), (adopted & s["richer"]).alias("richer"))

    return F.transform(F.array(F.struct(added.alias("added"), richer.alias("richer"), complete.alias("complete"))), decided)[0]

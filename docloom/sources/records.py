"""JSON-lines and CSV tables with explicit order, bad-record counts and resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAD = "_bad_record"


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the schema and ``_bad_record``: the line where it is no JSON of the schema, else null. Blank lines are skipped."""
    # not by the JSON source, which refuses queries of the bad lines alone
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    return lines.select(parsed.alias("r")).select("r.*")


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.drop(BAD).write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV with a header; quotes are doubled inside quotes and values may hold line ends."""
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"', quoteAll=True)


def record_counts(records: DataFrame, text: Column, review: Column) -> DataFrame:
    """One row (scanned, bad, no_text, review, written) of records from read_json_lines()."""
    good = F.col(BAD).isNull()
    blank = F.length(F.trim(F.coalesce(text, F.lit("")))) == 0
    return records.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(~good).alias("bad"), F.count_if(good & blank).alias("no_text"), F.count_if(good & ~blank & F.coalesce(review, F.lit(False))).alias("review"), F.count_if(good & ~blank).alias("written"))


def remaining(grid: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the grid that aren't saved yet; keys compare with nulls as equal."""
    s = saved.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = None
    for k in keys:
        one = grid[k].eqNullSafe(s[f"__{k}"])
        on = one if on is None else on & one
    return grid.join(s, on, "left_anti")


def last_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the one that comes last, as in a dictionary filled in that order."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("r")).select(key, "r.*")

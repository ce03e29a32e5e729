"""Results by cell of a grid (a unit, a stage, a condition), kept so that a stopped run goes on where it ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def saved_cells(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cells saved so far; none where nothing has been saved yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def pending(grid: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the grid that aren't saved. Null keys are values like others."""
    a, b = grid.alias("a"), saved.select(*keys).distinct().alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same, "left_anti")


def run_grid(grid: DataFrame, keys: list[str], folders: list[str], run: Callable[[DataFrame], DataFrame], good: Column, path: str, schema: str, passes: int = 3) -> DataFrame:
    """The saved cells after at most so many passes over what is pending; a pass ends the run when nothing is.

    ``run`` gives a row (schema) for each cell that it takes. Only cells that are ``good`` are saved, in a folder for each value of ``folders``; the others are pending again in the next pass. Folders
    are filled one after the other, each by a write of its own: a run that stops loses at most the folder it was at, and a new run finds the others.
    """
    spark = grid.sparkSession
    for _ in range(passes):
        todo = pending(grid, saved_cells(spark, path, schema), keys)
        parts = sorted((tuple(r) for r in todo.select(*folders).distinct().collect()), key=repr)  # stages times conditions
        if not parts:
            break
        for part in parts:
            here = F.lit(True)
            for name, value in zip(folders, part):
                here = here & F.col(name).eqNullSafe(F.lit(value))
            cells = run(pending(grid.where(here), saved_cells(spark, path, schema).where(here), keys))
            cells.where(F.coalesce(good, F.lit(False))).select(*[f.name for f in saved_cells(spark, path, schema).schema.fields]).write.partitionBy(*folders).mode("append").parquet(path)
    return saved_cells(spark, path, schema)


def runs_until(saved: Callable[[], int], one: Callable[[], bool], target: int, most: int) -> tuple[int, int]:
    """(saved runs, passes): whole passes until the target is saved or ``most`` have been made. A pass that raises, or isn't whole, saves nothing and is made again."""
    made = 0
    while saved() < target and made < most:
        made += 1
        try:
            one()
        except Exception:  # the next pass tries again; the number of passes is bounded
            continue
    return saved(), made


def flat_labels(cells: DataFrame, path: str, nested: list[str]) -> None:
    """Parquet and CSV of the cells without their nested columns."""
    flat = cells.drop(*nested)
    flat.write.mode("overwrite").parquet(f"{path}/labels.parquet")
    flat.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(f"{path}/labels.csv")

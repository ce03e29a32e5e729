"""Passages of documents: windows of lines, sentences up to a boundary, JSON inside text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_windows(text: str | None, max_chars: int = 5000, overlap: int = 3) -> list[tuple[int, int]]:
    """(first, last) line numbers from 1: windows of at most max_chars characters, line ends counted, that share ``overlap`` lines and always move on.

    A line that is longer than a window stands alone in one. Null and empty texts have no window.
    """
    return _windows([len(x) for x in text.split("\n")], max_chars, overlap) if text else []


def _windows(lengths: Sequence[int], max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """The windows of lines of so many characters."""
    upto = np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64) + 1)])
    # by first line: the last one that fits, and where the window after it begins
    number = np.arange(1, len(upto))
    last = np.maximum(np.searchsorted(upto, upto[:-1] + max_chars, side="right") - 1, number)
    following = np.maximum(last - overlap, number)
    firsts = [0]
    while last[firsts[-1]] < number[-1]:
        firsts.append(int(following[firsts[-1]]))
    return [(k + 1, int(last[k])) for k in firsts]


def overlap_windows(docs: DataFrame, id_col: str, text_col: str, max_chars: int = 5000, overlap: int = 3) -> DataFrame:
    """(id, pos, first, last) of every window; a document is cut inside its own row, by the lengths of its lines alone, so that no text goes to Python."""

    @F.arrow_udf("array<struct<first:int,last:int>>")
    def cut(lengths: pa.Array) -> pa.Array:
        found, ends = [np.empty((0, 2), np.int32)], [0]
        for row in lengths:
            found.append(np.array(_windows(row.values.to_numpy(), max_chars, overlap), np.int32))
            ends.append(ends[-1] + len(found[-1]))
        first, last = (pa.array(np.ascontiguousarray(x)) for x in np.concatenate(found).T)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([first, last], ["first", "last"]))

    lines = docs.where(F.col(text_col) != "").select(id_col, F.transform(F.split(text_col, "\n"), F.length).alias("lengths"))
    return lines.select(id_col, F.posexplode(cut("lengths")).alias("pos", "w")).select(id_col, "pos", "w.*")


def until_boundary(parts: DataFrame, group: str, order: str, start: Column, stop: Column, most: int = 12) -> DataFrame:
    """Rows from the group's first start up to, without, the first stop after it; at most ``most``."""
    marked = parts.withColumn("__start", start).withColumn("__stop", stop)
    first = F.min(F.when(F.col("__start"), F.col(order))).over(Window.partitionBy(group))
    end = F.min(F.when(F.col("__stop") & (F.col(order) > F.col("__first")), F.col(order))).over(Window.partitionBy(group))
    inside = marked.withColumn("__first", first).withColumn("__end", end).where((F.col(order) >= F.col("__first")) & (F.col("__end").isNull() | (F.col(order) < F.col("__end"))))
    return inside.where(F.col(order) < F.col("__first") + most).select(*parts.columns)


def slice_until(parts: Column, start: Callable[[Column], Column], stop: Callable[[Column], Column], most: int = 12) -> tuple[Column, Column]:
    """The same inside a row: (number, from 0, of the first start; the parts from it up to the first stop after it). No start: an empty array."""
    first = F.array_position(F.transform(parts, start), F.lit(True)).cast("int")
    stops = F.transform(parts, lambda x, i: F.when(stop(x) & (i + 1 > first), i + 1))
    end = F.coalesce(F.array_min(stops), F.size(parts) + 1)
    found = F.when(first > 0, F.slice(parts, F.greatest(first, F.lit(1)), F.least(end - first, F.lit(most)))).otherwise(F.slice(parts, 1, 0))
    return first - 1, found


def is_json(c: Column) -> Column:
    """The whole text is one JSON value. The parser passes over what follows a value, so the text is tried inside brackets and inside braces: no text is
    complete in both unless it is a single value. An object with a repeated name counts as none."""
    held = [F.try_parse_json(F.concat(F.lit(a), c, F.lit(b))).isNotNull() for a, b in (("[", "]"), ('{"x":', "}"))]
    return F.coalesce(held[0] & held[1], F.lit(False))


def json_object(c: Column) -> Column:
    """The text itself if it is JSON, else from its first { to its last } if that is; else null."""
    inner = F.regexp_extract(c, "(?s)(\\{.*\\})", 1)
    return F.coalesce(F.when(is_json(c), c), F.when(is_json(inner), inner))

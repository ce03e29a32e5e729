"""Texts of files in unknown encodings, and the table of contents of a collection of them."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings in the order in which they are tried.
ENCODINGS = ("utf-8-sig", "utf-8", "cp949")
#: A byte stream of UTF-8 falls into these, whatever it holds: ASCII, whole sequences by their first byte, single bytes.
_SEQUENCES = re.compile(rb"[\x00-\x7F]+|[\xC0-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF7][\x80-\xBF]{3}|.", re.DOTALL)


def strict_text(data: bytes, encodings: Sequence[str] = ENCODINGS) -> tuple[str | None, str | None, str | None]:
    """(text, encoding, error): by the first encoding that fits the whole of it."""
    if not data:
        return None, None, "empty"
    for name in encodings:
        try:
            return data.decode(name), name, None
        except UnicodeDecodeError:
            continue
    return None, None, "in none of the encodings"


def lenient_utf8(data: bytes) -> str:
    """Each sequence that says no character becomes one U+FFFD, and so does each byte that begins none; one that the end cuts off ends the text."""
    out = []
    for m in _SEQUENCES.finditer(data):
        token = m.group()
        need = 1 if token[0] >= 0xC0 else 0
        need += (token[0] >= 0xE0) + (token[0] >= 0xF0)
        try:
            out.append(token.decode())
        except UnicodeDecodeError:
            out.append("�")
        if len(token) == 1 and 0xC0 <= token[0] < 0xF8 and m.start() + need >= len(data):
            break
    return "".join(out)


def lenient_utf16(data: bytes, stop_at_nul: bool = False) -> str:
    """UTF-16LE; half a pair becomes U+FFFD, half a unit at the end goes."""
    text = data[: len(data) // 2 * 2].decode("utf-16-le", "replace")
    return text.partition("\0")[0] if stop_at_nul else text


def decoded(c: Column, encodings: Sequence[str] = ENCODINGS) -> Column:
    """struct(text, encoding, error) of a binary column; null stays null."""

    @F.pandas_udf("text string, encoding string, error string")
    def run(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None, None) if d is None else strict_text(d, encodings) for d in data], columns=["text", "encoding", "error"])

    return F.when(c.isNotNull(), run(c))


def lenient(c: Column, encoding: str = "utf-8", stop_at_nul: bool = False) -> Column:
    """The text of a binary column in UTF-8 or UTF-16LE, U+FFFD for what isn't; it never fails."""
    one = {"utf-8": lenient_utf8, "utf-16-le": lambda d: lenient_utf16(d, stop_at_nul)}[encoding]

    @F.pandas_udf("string")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda d: None if d is None else one(d))

    return run(c)


#: How a text of law gives its articles and dates, and the most characters of a title.
ARTICLE = r"(?m)^\s*(?:#+\s*)?(제\s*\d+\s*조(?:의\s*\d+)?(?:\([^\n)]*\))?)"
_DATE = r"(\d{4}[.\-/]\s*\d{1,2}[.\-/]\s*\d{1,2}\.?)"
EFFECTIVE = rf"시행\s+{_DATE}"
REVISED = rf"(?:법률|대통령령|해양수산부령|훈령|예규)\s*제?[^\n\]]*?,?\s*{_DATE}"
TITLE_MOST = 160


def _date(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.rtrim(F.translate(F.regexp_replace(found, r"\s+", ""), "/-", ".."), F.lit("."))


def title(text: Column, otherwise: Column) -> Column:
    """The first line of at most TITLE_MOST characters that isn't blank, without its heading marks."""
    lines = F.transform(F.split(text, "\r\n|\r|\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*#+\s*", ""), r"^\s+|\s+$", ""))
    return F.coalesce(F.get(F.filter(lines, lambda x: (x != "") & (F.length(x) <= TITLE_MOST)), F.lit(0)), otherwise)


def kinds(name: Column, rules: Sequence[tuple[str, str, int]], default: tuple[str, int]) -> Column:
    """struct(kind, rank) by the first rule (pattern, kind, rank) that the file name fits."""
    of = lambda kind, rank: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"))
    out = None
    for pattern, kind, rank in rules:
        out = (F.when if out is None else out.when)(F.regexp_like(name, F.lit(pattern)), of(kind, rank))
    return of(*default) if out is None else out.otherwise(of(*default))


def contents(files: DataFrame, rules: Sequence[tuple[str, str, int]] = (), default: tuple[str, int] = ("LAW", 1), article: str = ARTICLE) -> DataFrame:
    """files: (path, content). A row each: name, kind, rank, title, dates, counts, digest, encoding, error, and the name of the first file of the same content.

    The contents themselves aren't shuffled: a file's first equal is found by digest.
    """
    name = F.element_at(F.split("path", "/"), -1)
    read = files.select("path", name.alias("name"), F.sha2("content", 256).alias("sha256"), F.length("content").alias("bytes"), decoded(F.col("content")).alias("d"))
    text = F.col("d.text")
    rows = read.select(
        "path", "name", kinds(F.col("name"), rules, default).alias("of"), title(text, F.regexp_replace(F.regexp_replace("name", r"\.[^.]*$", ""), "^[^_]*_", "")).alias("title"),
        _date(text, EFFECTIVE).alias("effective"), _date(text, REVISED).alias("revised"), "bytes", "sha256", "d.encoding", "d.error",
        F.regexp_count(text, F.lit(article)).alias("articles"), F.length(text).alias("chars"), (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).alias("lines"),
    )
    first = rows.groupBy("sha256").agg(F.min("name").alias("first_equal"))
    return rows.join(first, "sha256").select("path", "name", "of.kind", "of.rank", "title", "effective", "revised", "bytes", "sha256", "encoding", "error", "articles", "chars", "lines", F.when(F.col("first_equal") != F.col("name"), F.col("first_equal")).alias("same_as"))


def read_corpus(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content) of files, in parallel."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

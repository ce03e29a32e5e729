"""Corpus preparation: language ID, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; the result is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents; further columns, whatever their names (but those that begin with ``__``), are passed on.

In every stage rows may repeat, an empty table gives an empty result, and a text of any length is treated whole. Null and empty texts, ids and ties:
see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import discard, materialize, table
from docloom.llm.decontam import decontaminate
from docloom.llm.langid import identify, train
from docloom.llm.linededup import dedup_lines
from docloom.llm.packing import pack_documents
from docloom.llm.simhash import keep_one_of_each

#: A text whose code under its best language takes more bits a byte than this is in none of the learned languages.
MAX_BITS_PER_BYTE = 7.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in any of the learned languages: all of them are wanted, so nothing goes for being in one of them.

    Rejects texts that are null, empty or without a letter, and those that no learned language codes well. A text is judged, not its label or id;
    ties between languages don't matter. Where no row has a label, nothing can be judged and all go.
    """
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    judged = identify(named, train(docs), id_col="row", text_col="text")
    return judged.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= MAX_BITS_PER_BYTE)).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of maximal repeated line runs go; a document that loses all its lines goes with them.

    First is the smallest doc_id, then line; a null doc_id comes last. Null and empty texts have no lines and stay; rows equal in id and text are one document
    and are treated alike. n_chars, where there is one, is that of the new text.
    """
    out = dedup_lines(docs).where((F.col("__removed") <= 0) | (F.length("__text") > 0))
    changed = {"text": F.col("__text")} | ({"n_chars": F.when(F.col("__removed") > 0, F.length("__text").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return out.withColumns(changed).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id (then text digest), one row of equal ones.

    Null and empty texts and those without words are one group. A null id comes after all others.
    """
    return keep_one_of_each(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go. Null and empty texts contain none and stay; ids aren't looked at."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece, with its sequence and place. A null or empty text is one piece, the end id; equal rows are packed each."""
    return pack_documents(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmarks", benchmarks), ("packing", packing)]

#: Trained models, components and packing can't be put in SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

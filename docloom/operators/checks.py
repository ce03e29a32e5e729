"""Flags of what was read from a document, guards of joins and outputs, and records made for the next stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import category_of
from docloom.operators.extraction import confidence, position_suspect

#: From which length on, and with how many Hangul syllables, a text is good as it is; the least confidence without a review; the length of an excerpt for an audit.
VISIBLE_LEAST, HANGUL_LEAST, CONFIDENCE_LEAST, AUDIT_CHARS = 300, 50, 0.6, 7000
#: Words that say nothing of a document among others of their kind, and the tag and least length of those that may.
STOPWORDS = ("사건", "사고", "경우", "때문", "이후", "당시", "관련", "이하", "이상", "부분", "정도", "필요", "가능", "발생", "확인", "판단", "조치", "상황", "이유", "결과", "내용", "기타", "해당")
NOUN, NOUN_LEAST = "NNG", 2


def filled(*values: Column) -> Column:
    """Every value has a character that isn't blank."""
    out = F.lit(True)
    for v in values:
        out = out & (F.trim(F.regexp_replace(F.coalesce(v, F.lit("")), r"\s+", " ")) != "")
    return out


def native_quality_ok(text: Column, *values: Column, letters: str = "가-힣", visible_least: int = VISIBLE_LEAST, letters_least: int = HANGUL_LEAST) -> Column:
    """All fields are filled and the text is long enough, also in letters of its script; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    visible, own = F.length(F.regexp_replace(text, r"\s+", "")), F.length(F.regexp_replace(text, f"[^{letters}]+", ""))
    return filled(*values) & (visible >= visible_least) & (own >= letters_least)


def review(values: dict[str, Column], origins: dict[str, Column], place: str | None = None, trust: dict[str, float] | None = None) -> Column:
    """struct(confidence, reasons, needs_review): per field how far it is trusted, and why a person should look: missing fields, a suspect position, little confidence."""
    suspect = position_suspect(values[place]) if place else F.lit(False)
    known = {} if trust is None else {"trust": trust}
    sure = {k: confidence(v, origins[k], suspect if k == place else None, **known) for k, v in values.items()}
    missing = [F.when(~filled(v), F.lit(f"missing {k}")) for k, v in values.items()]
    doubted = [F.when(filled(values[k]) & (c < CONFIDENCE_LEAST), F.lit(f"doubtful {k}")) for k, c in sure.items()]
    reasons = F.array_compact(F.array(*missing, F.when(suspect, F.lit("suspect position")), *doubted))
    return F.transform(F.array(reasons), lambda r: F.struct(F.map_from_arrays(F.array(*map(F.lit, sure)), F.array(*sure.values())).alias("confidence"), r.alias("reasons"), (F.size(r) > 0).alias("needs_review")))[0]


def kept_terms(tagged: Column, tag: str = NOUN, least: int = NOUN_LEAST, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """The terms of an array of (term, tag) that have the tag, are long enough and aren't stopwords, in order, repeats too."""
    return F.transform(F.filter(tagged, lambda x: (x["tag"] == tag) & (F.length(x["term"]) >= least) & ~x["term"].isin(*stopwords)), lambda x: x["term"])


def stage_record(name: Column, overview: Column, occurred: Column, place: Column, account: Column) -> Column:
    """struct of a document's record for the next stage: id and category from its file name, its fields, and the text to embed: the account, else the overview."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    text = lambda c: F.coalesce(c, F.lit(""))
    embedded = F.when(F.length(text(account)) > 0, account).otherwise(text(overview))
    return F.struct(stem.alias("id"), name.alias("filename"), category_of(stem).alias("category"), text(overview).alias("overview"), text(occurred).alias("occurred"), text(place).alias("place"), text(account).alias("account"), embedded.alias("embedding_text"))


def audit_payload(text: Column, **values: Column) -> Column:
    """What is sent to an auditor: the beginning of the text and the fields, as JSON."""
    return F.to_json(F.struct(F.substring(text, 1, AUDIT_CHARS).alias("text"), F.struct(*[F.coalesce(v, F.lit("")).alias(k) for k, v in values.items()]).alias("fields")))


def joined_or_fail(left: DataFrame, right: DataFrame, key: str, what: str) -> DataFrame:
    """left with right's columns; rows of left without a partner raise, with some of their keys."""
    missing = [r[0] for r in left.join(right.select(key), key, "left_anti").select(key).distinct().orderBy(key).limit(5).collect()]
    if missing:
        raise ValueError(f"no {what} for {missing}")
    return left.join(right, key)


def read_taxonomy(spark: SparkSession, path: str, member: str = "categories") -> DataFrame:
    """(category, item) of a JSON file that maps categories to lists of items; a file that is missing or has no such member raises."""
    whole = spark.read.text(path, wholetext=True)
    found = whole.select(F.from_json("value", f"{member} map<string,array<string>>")[member].alias("m")).where("m IS NOT NULL")
    if not found.limit(1).count():
        raise ValueError(f"{path} has no {member}")
    return found.select(F.explode("m").alias("category", "items")).select("category", F.explode("items").alias("item"))


def output_gate(files: DataFrame, required: Sequence[str], faults: Column) -> DataFrame:
    """(status, failures): PASS only if every required file is there, isn't empty, and has no ``faults`` (an array of words). files: (path, length, ...)."""
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.coalesce(faults, F.array().cast("array<string>")).alias("faults"))
    wanted = files.sparkSession.createDataFrame([(n,) for n in required], "name string")
    said = F.when(F.col("length").isNull(), F.array(F.lit("missing"))).when(F.col("length") == 0, F.array(F.lit("empty"))).otherwise(F.col("faults"))
    each = F.broadcast(wanted).join(named, "name", "left").select(F.explode(F.transform(said, lambda f: F.concat("name", F.lit(": "), f))).alias("f"))
    return each.agg(F.array_sort(F.collect_list("f")).alias("failures")).select(F.when(F.size("failures") == 0, "PASS").otherwise("FAIL").alias("status"), "failures")


def gold_evaluation(spark: SparkSession, reason: str) -> DataFrame:
    """One row that says that nothing was evaluated against a gold set, and why."""
    return spark.createDataFrame([(False, reason)], "evaluated boolean, reason string")

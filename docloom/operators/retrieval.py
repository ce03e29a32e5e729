"""Lexical retrieval: the best documents for each of a set of questions, scored where the documents are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Asked words (a row for each question and word) up to which questions go to the documents; beyond, documents go to the questions by a join.
QUESTION_ROWS = 200_000
#: Scores, and words by the questions that ask for them, that are held at a time; a document isn't split.
_CELLS = 1 << 20

Part = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _best(ids: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The top ids of each row of scores (questions, documents): (ids, scores), the best first, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, scores = ids[order], scores[:, order]
    keep = np.argsort(-scores, axis=1, kind="stable")[:, :top]
    return ids[keep], np.take_along_axis(scores, keep, axis=1)


def best_documents(docs: DataFrame, asked: DataFrame, part: Part, top: int) -> DataFrame | None:
    """(query_id, rank, id, score) of docs (id, w, bonus), w their words, for asked (query_id, term, weight); None if more is asked than fits a task.

    A document's score for a question is the sum of weight * part(times the word occurs, number of the document's words), plus the document's bonus where the sum isn't 0.
    Every task keeps its best documents for each question; only these are shuffled.
    """
    if asked.limit(QUESTION_ROWS + 1).count() > QUESTION_ROWS:
        return None
    table = asked.toPandas()
    terms = table["term"].unique()
    questions = table["query_id"].drop_duplicates(ignore_index=True)
    at = table["term"].map({t: i for i, t in enumerate(terms)}).to_numpy(dtype=np.int64)
    order = np.argsort(at, kind="stable")
    of = table["query_id"].map({q: i for i, q in enumerate(questions)}).to_numpy(dtype=np.int64)[order]
    weight = table["weight"].to_numpy(dtype=np.float64)[order]
    begin = np.searchsorted(at[order], np.arange(len(terms) + 1))
    known = pa.array(terms, pa.string())

    def scored(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (ids, scores by question)."""
        ids, words, bonus = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
        ends = words.offsets.to_numpy()
        size = max(1, _CELLS // max(len(questions), 1))
        for first in range(0, len(ids), size):
            last = min(first + size, len(ids))
            held, lengths = words.values.slice(ends[first], ends[last] - ends[first]), np.diff(ends[first : last + 1])
            mine = pc.fill_null(pc.index_in(held, value_set=known), -1).to_numpy()
            doc = np.repeat(np.arange(last - first), lengths)[mine >= 0]
            entry, tf = np.unique(doc * len(terms) + mine[mine >= 0], return_counts=True)
            doc, term = entry // max(len(terms), 1), entry % max(len(terms), 1)
            value, times = part(tf, lengths[doc]), begin[term + 1] - begin[term]
            sums = np.empty((len(questions), last - first))
            edge = np.searchsorted(doc, np.arange(last - first + 1))
            rows = np.concatenate([[0], np.cumsum(times)])[edge]  # words by questions in the documents before
            a = 0
            while a < last - first:
                b = max(a + 1, int(np.searchsorted(rows, rows[a] + _CELLS, side="right")) - 1)
                own = slice(edge[a], edge[b])
                some = times[own]
                flat = np.repeat(np.arange(edge[a], edge[b]), some)
                ask = np.arange(len(flat)) - np.repeat(np.cumsum(some) - some, some) + np.repeat(begin[term[own]], some)
                sums[:, a:b] = np.bincount(of[ask] * (b - a) + doc[flat] - a, weights=weight[ask] * value[flat], minlength=len(questions) * (b - a)).reshape(len(questions), -1)
                a = b
            yield ids[first:last], np.where(sums != 0, np.round(sums + bonus[first:last], 6), -np.inf)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores = np.empty((len(questions), 0), dtype=object), np.empty((len(questions), 0))
        for batch in batches:
            for new, s in scored(batch):
                best_ids, best = _best(new, s, top)
                ids, scores = np.concatenate([ids, best_ids], axis=1), np.concatenate([scores, best], axis=1)
                rows = [_best(i, x[None], top) for i, x in zip(ids, scores)]
                ids, scores = np.concatenate([i for i, _ in rows]).reshape(len(rows), -1), np.concatenate([x for _, x in rows])
        hit = np.nonzero(np.isfinite(scores))
        yield pa.RecordBatch.from_arrays([pa.array(hit[0].astype(np.int32)), pa.array(list(ids[hit]), kind), pa.array(scores[hit])], names=["q", "id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema["id"].dataType)
    if not len(questions):
        return docs.sparkSession.createDataFrame([], f"query_id {asked.schema['query_id'].dataType.simpleString()}, rank int, id {docs.schema['id'].dataType.simpleString()}, score double")
    local = docs.select("id", "w", "bonus").mapInArrow(search, f"q int, id {docs.schema['id'].dataType.simpleString()}, score double")
    names = docs.sparkSession.createDataFrame([(i, q) for i, q in enumerate(questions.tolist())], f"q int, query_id {asked.schema['query_id'].dataType.simpleString()}")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= top).join(F.broadcast(names), "q").select("query_id", "rank", "id", "score")  # as many names as questions


def by_join(docs: DataFrame, asked: DataFrame, part: Callable[[Column, Column], Column], top: int) -> DataFrame:
    """The same by a join of all words with all questions: any number of questions."""
    postings = docs.select("id", "bonus", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("id", "bonus", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    sums = postings.join(asked, "term").groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") * part(F.col("tf"), F.col("dl"))) + F.max("bonus"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "id", "score")

import random
from collections import Counter
from math import log

from pyspark.sql import functions as F

from docloom.operators import keywords, retrieval


def test_bm25_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "_CELLS", 40)
    r = random.Random(2)
    docs = [(f"d{i:03d}", " ".join(r.choice(["aa", "bb", "cc", "dd", "Ee", "ff"]) for _ in range(r.randrange(12))) or None, r.randrange(7)) for i in range(90)] + [("d000x", "aa aa", 0)] * 2
    asked = [(1, "aa bb bb"), (2, "zz"), (3, "ff EE"), (4, None)]
    words = {i: (t or "").lower().split() for i, t, _ in docs}
    n, average = len(docs), sum(len(words[i]) for i, _, _ in docs) / len(docs)
    df = Counter(w for i, _, _ in docs for w in set(words[i]))
    want = {}
    for q, text in asked:
        scores = []
        for i, _, rank in docs:
            own = Counter(words[i])
            s = sum(log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * own[w] * 2.5 / (own[w] + 1.5 * (0.25 + 0.75 * len(words[i]) / average)) for w in (text or "").lower().split() if own[w])
            scores += [(-round(s + (7 - rank) * 1e-4, 6), i)] if s else []
        want[q] = [(i, -s) for s, i in sorted(scores)[:4]]
    df_ = spark.createDataFrame(docs, "id string, t string, rank int")
    questions = spark.createDataFrame(asked, "q int, t string")
    found = keywords.bm25(df_.repartition(3), questions, "id", "t", "q", "t", 4, bonus=(7 - F.col("rank")) * 1e-4).collect()
    got = {q: [(x.id, x.score) for x in sorted(found, key=lambda x: x["rank"]) if x.query_id == q] for q, _ in asked}
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 2e-6 for q in got for a, b in zip(got[q], want[q]))


def test_the_join_gives_the_same(spark, monkeypatch):
    r = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(r.choice(["aa", "bb", "cc", "dd"]) for _ in range(r.randrange(9)))) for i in range(60)], "id long, t string")
    asked = spark.createDataFrame([("x", "aa bb"), ("y", "dd dd cc")], "q string, t string")
    run = lambda f: sorted(tuple(x) for x in f(docs, asked, "id", "t", "q", "t").collect())
    near = [run(keywords.bm25), run(keywords.overlap)]
    monkeypatch.setattr(retrieval, "QUESTION_ROWS", 0)
    assert [run(keywords.bm25), run(keywords.overlap)] == near
    assert keywords.bm25(docs.limit(0), asked, "id", "t", "q", "t").count() == 0 and keywords.overlap(docs, asked.limit(0), "id", "t", "q", "t").count() == 0


def test_words_by_questions_are_held_in_parts(spark, monkeypatch):
    # every document has words that every question asks for: a batch of them times the questions isn't held at once
    import numpy as np

    docs = spark.createDataFrame([(i, "aa bb cc dd") for i in range(50)], "id long, t string").coalesce(1)
    asked = spark.createDataFrame([(q, "aa bb cc dd") for q in range(20)], "q long, t string")
    want = sorted(tuple(x) for x in keywords.overlap(docs, asked, "id", "t", "q", "t").collect())
    monkeypatch.setattr(retrieval, "_CELLS", 1000)
    largest, real = spark.sparkContext.accumulator(0), np.bincount

    def counted(x, **k):
        largest.add(int(len(x) > 1000))
        return real(x, **k)

    class Numpy:
        bincount = staticmethod(counted)

        def __getattr__(self, name):
            return getattr(np, name)

    monkeypatch.setattr(retrieval, "np", Numpy())
    assert sorted(tuple(x) for x in keywords.overlap(docs, asked, "id", "t", "q", "t").collect()) == want and largest.value == 0

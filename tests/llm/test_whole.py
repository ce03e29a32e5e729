"""Cases in which less than the whole job would go unnoticed by the other tests."""

import random

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import ann, linededup, simhash

from test_llm import docs, prose


def test_similar_texts_of_a_crowded_template(spark):
    base, texts = prose(1, 100).split(), []
    for g in range(120):
        own = base[:40] + prose(1000 + g, 13).split() + base[53:]
        for i in range(2):
            w = list(own)
            w[10 + 70 * i] = "changed%d" % g
            texts.append((len(texts) + 10, " ".join(w)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(96)} for i, t in texts}
    bits = {i: simhash.fingerprint(t, 5) for i, t in texts}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 or ((bits[a] ^ bits[b]) & (2**64 - 1)).bit_count() <= 4):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert sum(find(i) == i for i in sets) > 50
    kept = simhash.keep_one_of_each(docs(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i in sets if find(i) == i)


def test_copies_use_up_no_candidates(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(2000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[7].tolist()) for i in range(1000)]
    is_query = (F.col("vec_id") < 2000) & (F.pmod("vec_id", F.lit(20)) == 0)

    def recall(rows):
        out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), is_query, candidates=1, share=0.4).collect()
        vectors, found, true = {i: np.array(v) for i, v in rows}, 0, 0
        ids = np.array(sorted(vectors))
        table = np.stack([vectors[i] for i in ids])
        for q in range(0, 2000, 20):
            s = table @ vectors[q]
            s[ids == q] = -np.inf
            best = set(ids[np.lexsort([ids, -s])[:20]].tolist())
            found, true = found + len(best & {a.vec_id for a in out if a.query_id == q}), true + 20
        return found / true

    with_copies, without = recall(rows), recall(rows[:2000])
    print("recall", with_copies, without)
    assert with_copies >= without >= 0.9


def test_repeated_queries_are_one(spark):
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist(), 1) for i in range(60)]
    rows.append(rows[20])
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell int"), F.pmod("vec_id", F.lit(20)) == 0).collect()
    vectors = {i: np.array(v, dtype=np.float64) for i, v, _ in rows}
    for q in (0, 20, 40):
        want = sorted((i for i, _, _ in rows if i != q), key=lambda i: (-(vectors[i] @ vectors[q]), i))[:20]
        assert [a.vec_id for a in sorted((a for a in out if a.query_id == q), key=lambda a: a.rank)] == want


def test_maximal_line_runs(spark):
    r, texts = random.Random(3), []
    own = lambda n, size: [prose(r.randint(0, 10**9), 60)[:size] for _ in range(n)]
    short, three, blank = own(20, 6), own(3, 35), own(3, 35)
    texts = [(1, short), (2, [*own(2, 30), *short, *own(2, 30)]), (3, three), (4, [*own(1, 70), *three, *own(1, 70)]), (5, blank), (6, [blank[0], "", *blank[1:], "  "]), (7, ["x" * 9] * 12)]
    texts += [(10 + i, [r.choice("abc") * r.choice([1, 12, 35]) for _ in range(r.randint(1, 25))]) for i in range(12)]
    want, seen = {}, set()
    for i, lines in texts:
        own_lines = [(p, x.strip(" ")) for p, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for s in range(len(own_lines)):
            for e in range(s + 1, len(own_lines) + 1):
                run = tuple(x for _, x in own_lines[s:e])
                if sum(map(len, run)) >= 80:
                    if run in seen:
                        gone |= {p for p, _ in own_lines[s:e]}
                    seen.add(run)
        want[i] = (len(gone), "\n".join(x for p, x in enumerate(lines) if p not in gone))
    assert [want[i][0] for i in (2, 4, 6)] == [20, 3, 3]
    out = linededup.dedup_lines(docs(spark, [(i, "\n".join(x)) for i, x in texts])).collect()
    assert {r.doc_id: (r["__removed"], r["__text"]) for r in out} == {i: (n if n else 0, t) for i, (n, t) in want.items()}

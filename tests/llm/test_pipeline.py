"""Each stage of the pipeline against a version by hand, the whole of it, and odd tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline
from docloom.llm import langid, simhash

from test_llm import ODD, by_contexts, docs, library, prose


def corpus():
    r, out = random.Random(5), []
    items = [prose(900 + i, 25) for i in range(4)]
    shared = [prose(700 + i, 8) for i in range(3)]
    for g in range(14):
        own = [prose(g * 50 + k, 15) for k in range(4)]
        out.append("\n".join(own))
        for v in range(3):  # near copies, each of its lines changed
            changed = [x.split() for x in own]
            for w in changed[: 1 + v]:
                w[r.randrange(len(w))] = f"new{g}{v}"
            out.append(" ".join(" ".join(w) for w in changed))
    out += [prose(1, 30) + "\n" + "\n".join(shared) + "\n" + prose(2, 9), "\n".join(shared[:2]) + "\n\n" + prose(3, 20), "\n".join(shared)]
    out += [prose(4, 40) + " " + items[0] + " " + prose(5, 60), items[1], " ".join(items[2].split()[:23]), " ".join(items[3].split()[:10])]
    out += ["".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(80)), "123 456", ""]
    rows = [(100 + i, t) for i, t in enumerate(out)]
    return [*rows, (None, prose(6, 20)), (7, None), rows[3]], items


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def shingles(ws, n):
    return {tuple(ws[i : i + n]) for i in range(max(len(ws) - n + 1, 1))} if ws else set()


def test_stages_by_hand(spark, tmp_path):
    rows, items = corpus()
    df = docs(spark, rows)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {}
    for name, stage in pipeline.STAGES:
        got[name] = df = stage(spark, df, str(tmp_path))
        if name != "packing":
            assert df.columns == docs(spark, []).columns
            df.write.parquet(str(tmp_path / name))
            df = spark.read.parquet(str(tmp_path / name))
            got[name] = [(x.doc_id, x.text) for x in df.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")

    import pandas as pd

    counts = pd.concat(langid._count([pd.DataFrame(sorted({(t, "en") for _, t in rows if t}), columns=["text", "lang"])]))
    fits = lambda t: bool(t) and re.search(r"[^\W\d_]", t) and by_contexts(counts, t)[0] / langid.UNIT <= 7 * len(t.encode())
    want = [x for x in rows if fits(x[1])]
    assert sorted(got["language"], key=key) == sorted(want, key=key) and len(want) < len(rows) - 2

    seen, cut = set(), {}
    for i, t in sorted(set(want), key=key):
        lines = t.split("\n")
        full = [(p, x.strip(" ")) for p, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for s in range(len(full)):
            for e in range(s + 1, len(full) + 1):
                run = tuple(x for _, x in full[s:e])
                if sum(map(len, run)) >= 80:
                    if run in seen:
                        gone |= {p for p, _ in full[s:e]}
                    seen.add(run)
        cut[i, t] = "\n".join(x for p, x in enumerate(lines) if p not in gone) if gone else t
    want = [(i, cut[i, t]) for i, t in want if cut[i, t] or not t]
    assert sorted(got["lines"], key=key) == sorted(want, key=key) and any(a != b for (_, a), b in cut.items())

    texts = sorted(set(want), key=key)
    sets = [shingles((t or "").lower().split(), 5) for _, t in texts]
    bits = [simhash.fingerprint(t, 5) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if ((bits[a] ^ bits[b]) & (2**64 - 1)).bit_count() <= 4 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = [x for k, x in enumerate(texts) if find(k) == k]
    assert sorted(got["near_duplicates"], key=key) == want and len(want) < len(texts)

    inside = lambda t: any(len(s & shingles(words(t), 5)) >= 0.8 * len(s) - 1e-9 for s in (shingles(words(x), 5) for x in items))
    kept = [x for x in want if not inside(x[1])]
    assert sorted(got["benchmarks"], key=key) == kept and len(kept) == len(want) - 3

    pieces = Counter()
    for i, t in kept:
        ids = [*library().encode(t or "", add_special_tokens=False).ids, 0]
        for s in range(0, len(ids), 1024):
            pieces[i, s, len(ids[s : s + 1024]), zlib.crc32(np.array(ids[s : s + 1024], dtype="<u4").tobytes()), len(ids)] += 1
    packed = got["packing"].collect()
    assert pieces == Counter((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in packed)
    sequences = {}
    for x in packed:
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and sum(n for _, n in s) <= 1024 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False))
    assert {(x.doc_id, x.start, x.ids_crc32) for x in pipeline.run(spark, str(tmp_path)).collect()} == {(x.doc_id, x.start, x.ids_crc32) for x in packed}


@pytest.mark.parametrize("rows", [[], ODD])
def test_odd_tables(spark, tmp_path, rows):
    df = docs(spark, rows)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    n = [stage(spark, df, str(tmp_path)).count() for _, stage in pipeline.STAGES]
    assert n[1] == n[3] == len(rows) and n[0] == (4 if rows else 0) and n[2] == (5 if rows else 0) and n[4] >= len(rows)
    assert pipeline.run(spark, str(tmp_path)).count() >= (3 if rows else 0)

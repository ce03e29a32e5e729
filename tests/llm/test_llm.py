import hashlib
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.llm import ann, decontam, gsaca, langid, licenses, linededup, packing, sharding, simhash, suffixdedup, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `k` int, `rank` int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None, 1, 2) for i, t in texts], DOCS)


ODD = [(1, None), (2, ""), (3, "..."), (4, "same text here"), (4, "same text here"), (None, "no id"), (5, "word " * 5000)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def test_simhash_components(spark):
    r = random.Random(1)
    base = [r.getrandbits(63) for _ in range(20)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(63), r.randint(0, 5))) for b in base for _ in range(12)})
    df = spark.createDataFrame([(f, 1) for f in fps], "fp long, n long")
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    want = {frozenset(f for f in fps if find(f) == g) for g in {find(f) for f in fps}}
    for crowd in (20_000, 3):
        got = {}
        for row in simhash.link_components(df, crowd=crowd).collect():
            got.setdefault(row.root, set()).add(row.fp)
        assert {frozenset(v) for v in got.values()} == {w for w in want if len(w) > 1}


def test_simhash_odd_rows(spark):
    out = {(r.id, r.k): r.first.id for r in simhash.near_duplicate_groups(docs(spark, ODD)).collect()}
    assert sorted(v for (i, _), v in out.items() if i in (1, 2)) == [1, 1]
    kept = simhash.keep_one_of_each(docs(spark, ODD)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 3, 4, 5]
    assert simhash.near_duplicate_groups(docs(spark, [])).count() == 0


def by_contexts(counts, text):
    """Code lengths of a text, byte by byte, from counts of four-byte strings: escape method C, order 3."""
    out = []
    for lang in sorted(counts["lang"].unique()):
        after = {}
        for gram, n in counts[counts["lang"] == lang][["gram", "n"]].itertuples(index=False):
            g = int(gram).to_bytes(4, "big")
            for k in range(4):
                after.setdefault(g[3 - k : 3], Counter())[g[3]] += n
        data, total, known = b"\n" * 3 + text.encode(), 0, {}
        for at in range(3, len(data)):
            key = data[at - 3 : at + 1]
            if key not in known:
                bits = lambda p: int(np.rint(-np.log2(p) * langid.UNIT))
                cost = 0
                for k in (3, 2, 1, 0):
                    seen = after.get(key[3 - k : 3])
                    if seen is None:
                        continue
                    n, kinds = sum(seen.values()), len(seen)
                    if key[3] in seen:
                        cost += bits(seen[key[3]] / (n + kinds))
                        break
                    cost += bits(kinds / (n + kinds))
                else:
                    cost += 8 * langid.UNIT
                known[key] = cost
            total += known[key]
        out.append(total)
    return out


def test_language(spark):
    rows = [(i, " ".join(random.Random(i).choices(v, k=30)), lang, "s", 0, 1, 2) for i in range(120) for lang, v in [("xx", ["alpha", "beta", "gam"]), ("yy", ["oumo", "quez", "zorr"])]]
    df = spark.createDataFrame(rows, DOCS)
    trees = langid.train(df)
    out = langid.identify(df, trees, keep=("lang",)).collect()
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in out)
    few = langid.grow_trees(counts := pd.concat(langid._count([pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars", "k", "rank"])])), dense_pairs=0)
    texts = ["alpha oumo", "new bytes ~~é beta", "zorr" * 30000]
    assert (langid._score(few, texts) == langid._score(langid.grow_trees(counts), texts)).all()
    assert langid._score(few, texts).tolist() == [by_contexts(counts, t) for t in texts]
    odd = langid.identify(docs(spark, ODD), trees).collect()
    assert len(odd) == len(ODD) and sum(r.lang_pred == "und" for r in odd) == 3
    assert langid.train(docs(spark, [])) is None and langid.identify(docs(spark, ODD), None).count() == len(ODD)


def by_hand(rows, n_shards, seed, bucket_rows):
    """The two passes over (a, b) rows, one by one."""
    import struct

    from xxhash import xxh64_intdigest

    def h(*parts):
        out = 42
        for kind, x in parts:
            out = xxh64_intdigest(x.encode() if kind == "s" else struct.pack("<" + kind, x), out)
        return out - (1 << 64) if out >> 63 else out

    n_buckets, buckets, copies = max(1, -(-len(rows) // bucket_rows)), {}, Counter()
    for a, b in rows:
        copies[a, b] += 1
        x = h(("i", seed), ("q", a), ("s", b), ("q", copies[a, b]))
        buckets.setdefault(x % n_buckets, []).append((x, a, b))
    out, place = set(), 0
    for k in sorted(buckets):
        items, order = sorted(buckets[k]), list(range(len(buckets[k])))
        for i in range(len(items), 1, -1):
            j = h(("i", seed), ("q", k), ("i", i)) % i
            order[i - 1], order[j] = order[j], order[i - 1]
        for i in order:
            out.add((*items[i][1:], place % n_shards, place // n_shards))
            place += 1
    return out


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_sharding(spark, n):
    rows = [(i // 3, "x") for i in range(n)] + [(-1, "hot")] * n
    want = by_hand(rows, 4, 1, 16)
    random.Random(n).shuffle(rows)
    for parts in (1, 5):
        out = sharding.assign_shards(spark.createDataFrame(rows, "a long, b string").repartition(parts), 4, seed=1, bucket_rows=16).collect()
        assert {(r.a, r.b, r.shard, r.slot) for r in out} == want and len(out) == len(rows)


def test_sharding_writes_and_refuses(spark, tmp_path):
    df = docs(spark, ODD)
    sharding.write_shards(df, str(tmp_path / "s"), 3, seed=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(repr, back.select(*df.columns).collect())) == sorted(map(repr, df.collect()))
    assert sorted(Counter(r.shard for r in back.collect()).values()) == [2, 2, 3]
    with pytest.raises(ValueError, match="shard"):
        sharding.assign_shards(spark.createDataFrame([(1, 2)], "a long, shard int"), 4)


@pytest.mark.parametrize("repeats", [0, 1, 40])
def test_sharding_by_either_way_of_counting(spark, repeats):
    rows = [(i, "x") for i in range(100)] + [(i, "x") for i in range(repeats)] * 2
    df, want = spark.createDataFrame(rows, "a long, b string"), by_hand(rows, 4, 1, 16)
    for lookup in (0, 10, 1000):
        out = sharding.assign_shards(df, 4, seed=1, bucket_rows=16, lookup=lookup).collect()
        assert {(r.a, r.b, r.shard, r.slot) for r in out} == want and len(out) == len(rows)


def test_whole_documents_are_shuffled_in_buckets_of_bounded_bytes(spark, tmp_path, monkeypatch):
    tables, write = {}, sharding.materialize
    monkeypatch.setattr(sharding, "materialize", lambda df, name: tables.setdefault(name, write(df, name)))
    df = docs(spark, [*ODD, *[(100 + i, prose(i, 300)) for i in range(60)], *[(77, "twin")] * 5]).withColumn("shard", F.lit("clash"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = sharding.op3_two_pass_shuffle(spark, str(tmp_path)).collect()
    moved = tables["shuffle-buckets"].select(F.explode("__items.__row.document").alias("d")).select("d.*")
    assert sorted(map(repr, moved.collect())) == sorted(map(repr, df.collect()))
    digests = [(r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.collect()]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter(digests)
    assert {(r.shard, r.slot) for r in out} == {(p % 40, p // 40) for p in range(len(digests))}

    tables.clear()
    long_rows = spark.createDataFrame([(i, [prose(i, 1000)]) for i in range(200)], "a long, b array<string>")
    assert sharding.assign_shards(long_rows, 4, bucket_bytes=50_000).count() == 200
    per_bucket = [sum(len(i["__row"].b[0]) for i in r["__items"]) for r in tables["shuffle-buckets"].collect()]
    assert max(per_bucket) < 200_000 < 800_000 < sum(per_bucket)


def test_line_runs(spark):
    long = ["L%d " % i + "x" * 90 for i in range(4)]
    texts = [(1, "\n".join(long)), (2, "own line\n" + "\n".join(long[1:3])), (3, "short\nshort\nshort"), (6, "\n".join(long)), (6, "\n".join(long)), *ODD]
    out = linededup.dedup_lines(docs(spark, texts)).collect()
    by = {(r.doc_id, r["__lines"]): (r["__removed"], r["__text"]) for r in out}
    assert len(out) == len(texts)
    assert by[1, 4] == (0, "\n".join(long)) and by[2, 3] == (2, "own line") and by[3, 3] == (0, "short\nshort\nshort") and by[6, 4] == (4, "")
    assert by[1, 0] == (0, None) and by[2, 1] == (0, "") and by[5, 1] == (0, ODD[-1][1])
    assert linededup.dedup_lines(docs(spark, [])).count() == 0


def test_licenses(spark):
    known = spark.createDataFrame(licenses.KNOWN, "license string, text string")
    mit = licenses.KNOWN[0][1]
    texts = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(" ", "\n  ")), (2, mit + " extra"), (3, None)]
    assert {r.doc_id: r.license for r in licenses.scan_licenses(docs(spark, texts), known).collect()} == {1: "MIT", 2: None, 3: None}
    out = licenses.scan_licenses(docs(spark, ODD).withColumn("license", F.lit("x")).withColumn("digest", F.lit(1)), known).collect()
    assert sorted(map(str, (r.doc_id for r in out))) == sorted(str(i) for i, _ in ODD) and all(r.license is None for r in out)
    assert licenses.scan_licenses(docs(spark, []), known).count() == 0


def check_sequences(out, tokens, segments, loss):
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append(r)
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        assert len(s) <= segments and sum(r.length for r in s) <= tokens and sum(r.loss for r in s) <= loss
        assert s[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(s, s[1:], strict=False))
    return seqs


def test_packing(spark):
    rows = [*ODD, *[(100 + i, prose(i, 3 + 7 * i)) for i in range(30)], *[(77, "twin")] * 40]
    out = packing.pack_documents(docs(spark, rows), max_tokens=64, max_segments=3).collect()
    check_sequences(out, 64, 3, 64)
    tok = library()
    want = Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for s in range(0, len(ids), 64):
            want[i, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], dtype="<u4").tobytes()), len(ids)] += 1
    assert want == Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out)
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_packing_of_instructions(spark):
    talks = [(i, [(prose(i, 20), False), (prose(50 + i, 5 * (i % 4)), True), (None, True)]) for i in range(25)] + [(90, None), (91, [])]
    df = spark.createDataFrame(talks, "doc_id long, parts array<struct<text string, loss boolean>>")
    out = packing.pack_documents(df, max_tokens=400, max_segments=50, max_loss=30, parts_col="parts", with_ids=True).collect()
    seqs = check_sequences(out, 400, 50, 30)
    assert any(sum(r.loss for r in s) >= 28 and sum(r.length for r in s) < 300 for s in seqs.values())  # the loss limit binds first
    tok = library()
    for i, parts in talks:
        encoded = [(tok.encode(t or "", add_special_tokens=False).ids, bears) for t, bears in parts or []]
        own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == [x for ids, _ in encoded for x in ids] + [0]
        assert sum(r.loss for r in own) == sum(len(ids) for ids, bears in encoded if bears) + 1


def test_place_by_hand():
    rng = np.random.default_rng(1)
    for _ in range(20):
        limits = np.array([64, 8, 32])  # so that shares are exact and ties are ties
        demand = np.stack([rng.integers(1, 40, 60), np.ones(60, dtype=np.int64), rng.integers(0, 32, 60)], axis=1)
        bins, order = packing.place(demand, limits)
        left, n, got = list(range(60)), 0, []
        while left:
            room, pick = limits.astype(float).copy(), []
            while fits := [i for i in left if (demand[i] <= room).all()]:
                key = lambda i: sum(demand[i] / limits) if not pick else float((demand[i] / limits) @ (room / limits))  # noqa: E731, B023
                best = max(map(key, fits))
                i = min((i for i in fits if key(i) >= best), key=lambda i: (tuple(demand[i]), i))
                pick.append(i)
                left.remove(i)
                room -= demand[i]
            got.append(sorted(tuple(demand[i]) for i in pick))
        own = [sorted(tuple(demand[i]) for i in np.flatnonzero(bins == b)) for b in range(bins.max() + 1)]
        assert own == got


def library():
    from tokenizers import Tokenizer
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_tokens_equal_the_library():
    t, own = library(), packing.byte_bpe()
    for text in ["a  b\n\n c", " x \t y", "don't 12 34!\r\n", "é  b", "<|endoftext|> x", "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n", "<|ENDOFTEXT|>", "  ", "a  b", prose(3, 50)]:
        assert own.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_a_text_of_new_words_is_encoded_in_one_call(monkeypatch):
    import tiktoken

    t, calls = library(), []
    for name in ("encode", "encode_ordinary", "encode_to_numpy"):
        plain = getattr(tiktoken.Encoding, name)
        monkeypatch.setattr(tiktoken.Encoding, name, lambda self, text, plain=plain, **kw: calls.append(text) or plain(self, text, **kw))
    own = packing.byte_bpe()
    text = prose(9, 5000)
    assert own.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
    assert calls == [text]


def test_tokens_equal_the_library_on_random_texts():
    t, own, r = library(), packing.byte_bpe(), random.Random(12)
    bits = [" ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", "\xa0", "\u180e", "\u200b", "\u2028", "\u3000", "\ufeff", "\0", "a", "don't", "'ll", "12", "½", "é", "e\u0301", "漢字", "🙂", "<|endoftext|>", "<|endoftext", "|>", ".", "...", "_"]
    for _ in range(500):
        text = "".join(r.choices(bits, k=r.randint(1, 30)))
        assert own.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_containment(spark):
    item = prose(5, 40)
    items = spark.createDataFrame([(1, item), (2, prose(6, 3)), (3, None), (4, "")], "item_id long, text string")
    texts = [(10, prose(7, 400) + " " + item + " " + prose(8, 400)), (11, prose(9, 300)), (12, " ".join(item.split()[:20])), *ODD]
    kept = decontam.decontaminate(docs(spark, texts), items).collect()
    assert {r.doc_id for r in kept} == {11, 12, 1, 2, 3, 4, None, 5} and len(kept) == len(texts) - 1
    assert decontam.decontaminate(docs(spark, []), items).count() == 0 and decontam.decontaminate(docs(spark, ODD), items.limit(0)).count() == len(ODD)


def test_suffix_array():
    r = random.Random(2)
    for _ in range(300):
        s = bytes(r.choice(b"abc") for _ in range(r.randint(0, 40)))
        assert gsaca.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_array_of_parts():
    r = random.Random(3)
    for _ in range(100):
        s = [c for _ in range(r.randint(1, 6)) for c in [*[r.choice([1, 2, 300]) for _ in range(r.randint(0, 9))], 0]]
        assert gsaca.suffix_array(np.array(s)) == sorted(range(len(s)), key=lambda i: s[i:])


def test_entries_in_parts(monkeypatch):
    g = np.random.default_rng(5)
    b = g.integers(97, 99, 20_000).astype(np.uint8)
    b[3_000:9_000] = 97
    ends = np.array([30, 5_000, 5_049, 12_345, len(b)])
    want = suffixdedup.entries(b, ends, suffixdedup.WIDE)
    assert sum(want[1]) == sum(max(0, n - suffixdedup.LENGTH + 1) for n in np.diff(ends, prepend=0))
    monkeypatch.setattr(suffixdedup, "_STRINGS", 700)
    for x, y in zip(want, suffixdedup.entries(b, ends, suffixdedup.WIDE), strict=True):
        assert x.tolist() == y.tolist()
    monkeypatch.undo()
    block = g.integers(0, 256, suffixdedup.BLOCK).astype(np.uint8)
    tracemalloc.start()
    suffixdedup.entries(block, np.array([len(block)]), suffixdedup.WIDE)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(block)


@pytest.mark.parametrize(("construction", "small"), [("windows", False), ("grouping", False), ("grouping", True)])
def test_repeats(spark, construction, small):
    sizes = {"bucket_bytes": 500, "filter_bytes": 900, "home_bytes": 700} if small else {}
    shared = prose(1, 30)
    texts = [(2, prose(2, 20) + shared + prose(3, 20)), (1, shared + prose(4, 10)), (3, shared[10:80] + "é" + shared), (7, shared + prose(4, 10)), *ODD]
    texts += [(20 + i, prose(40 + i, 9) + shared[i : 60 + 3 * i] + prose(60 + i, 4)) for i in range(12)] + [(40, "ab" * 70), (41, "ab" * 90), (41, "xab" * 50 + shared), (42, "ab" * 30 + "z" + "ab" * 30)]
    want = {}
    for i, t in sorted((x for x in texts if x[0] is not None), key=lambda x: x[0]):
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - 49):
            if any(b[s : s + 50] in (u or "").encode() for j, u in texts if j is not None and j < i):
                gone[s : s + 50] = [True] * 50
        want[i, len(b)] = hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest(), sum(gone), sum(g and not f for f, g in zip([False, *gone], gone, strict=False))
    out = suffixdedup.remove_repeats(docs(spark, texts), construction=construction, **sizes).collect()
    assert len(out) == len(texts)
    for r in out:
        if r.doc_id is not None:
            assert (bytes(r.kept).hex(), r.n_removed, r.n_spans) == want[r.doc_id, r.n_bytes]
    assert sum(w[1] > 0 for w in want.values()) > 10
    assert suffixdedup.remove_repeats(docs(spark, [])).count() == 0
    with pytest.raises(TypeError):
        suffixdedup.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_neighbours(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)], 0) for i in range(300)] + [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] * 8, 0), (903, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, k int")
    out = ann.search(df, F.pmod("vec_id", F.lit(20)) == 0, candidates=300).collect()
    import numpy as np

    x = np.array([v for _, v, _ in rows[:300]], dtype=np.float32).astype(np.float64)
    for q in range(0, 300, 20):
        s = x @ x[q]
        s[q] = -np.inf
        assert [a.vec_id for a in sorted((a for a in out if a.query_id == q), key=lambda a: a.rank)] == np.argsort(-s)[:20].tolist()
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_urls(spark):
    rules = spark.createDataFrame(urlfilter.RULES, urlfilter.RULE_SCHEMA)
    urls = ["http://A.net/x", "http://example.net/en/1?u", "http://notexample.com/de/", "http://www.example.com/de/#f", "http://net", None, "no scheme", "http://x.org/fr/y", "http://x.org?q=/fr/"]
    out = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert out == {0: ("net/", "block"), 1: ("example.net/en/", "allow"), 2: (None, "allow"), 3: ("example.com/de/", "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: ("org/fr/", "allow"), 8: (None, "allow")}
    pages = spark.createDataFrame([(1, "http://" + "a." * 20000 + "net/x", "c"), (2, "http://b.net/", "c"), (2, "http://b.net/", "c")], "page_id long, url string, verdict string")
    assert [(r.page_id, r.rule) for r in urlfilter.judge_urls(pages, rules).orderBy("page_id").collect()] == [(1, "net/"), (2, "net/"), (2, "net/")]
    assert urlfilter.judge_urls(pages.limit(0), rules).count() == 0 and urlfilter.judge_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == 3


def test_similar_texts_join_exactly(spark):
    r, texts = random.Random(9), []
    for g in range(12):
        base = prose(100 + g, 80).split()
        for _ in range(8):
            w = list(base)
            for at in r.sample(range(80), r.randint(0, 4)):
                w[at] = "changed%d" % r.randint(0, 99)
            texts.append((len(texts) + 10, " ".join(w)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(76)} for i, t in texts}
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
    kept = simhash.keep_one_of_each(docs(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i in sets if find(i) == i)

"""SetSketch near-dedup, conversation repair, importance resampling, and long runs of blanks, against versions by hand."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import packing, repair, resample, setsketch, simhash

from test_llm import ODD, docs, prose

BLANK = " \t\n\x0b\x0c\r"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]


def shingles(text, n=5):
    w = words(text)
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near_copies(seed):
    """Texts on both sides of the threshold, copies, short ones, ODD ones."""
    r, texts = random.Random(seed), list(ODD)
    for g in range(25):
        base = prose(1000 * seed + g, r.randint(30, 200)).split()
        for _ in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = prose(r.random(), 1)
            texts.append((len(texts) + 10, (" " if r.random() < 0.5 else "\x0b").join(w if r.random() < 0.7 else w[: -r.randint(1, 9)]).upper()))
    return texts + [(900 + i, t) for i, (_, t) in enumerate(texts[7:40])] + [(990, "a b c"), (991, "A  b C"), (992, "a b c d")]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_at_85_percent(spark, seed):
    texts = near_copies(seed)
    sets = [shingles(t) for _, t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inside = 0
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            parent[find(b)], inside = find(a), inside + 1
    ids = [i for i, _ in texts]
    least = {}
    for i in range(len(texts)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    want = Counter((ids[i], len(sets[i]), least.get(find(i)) if sets[i] else ids[i]) for i in range(len(texts)))
    assert inside > 40
    assert Counter(tuple(r) for r in setsketch.near_duplicate_groups(docs(spark, texts)).collect()) == want
    assert setsketch.near_duplicate_groups(docs(spark, [])).count() == 0


def test_registers_merge_and_estimate():
    r = np.random.default_rng(3)
    a, b = (" ".join(r.integers(0, 10**9, 400).astype(str)) for _ in range(2))
    one, two = (np.frombuffer(setsketch.sketch(t)[2], dtype="<u2") for t in (a, b))
    least = np.minimum(*[np.min([((h[:, None] ^ setsketch._XORS) * setsketch._FACTORS).min(axis=0) for h in simhash._hashes(t, 5)], axis=0) for t in (a, b)])
    assert (setsketch.registers(least) == np.maximum(one, two)).all()
    w = a.split()
    for share in (0.3, 0.6, 0.85, 0.97):
        n = int(396 * (1 - share) / (1 + share))
        other = " ".join(w[: len(w) - n]) + " " + " ".join(r.integers(0, 10**9, n).astype(str))
        (na, _, ka, _), (nb, _, kb, _) = setsketch.sketch(a), setsketch.sketch(other)
        x, y = np.frombuffer(ka, "<u2"), np.frombuffer(kb, "<u2")
        grid = np.linspace(0.01, 0.999, 300)
        best = grid[np.argmax([setsketch.likelihood((x > y).sum(), (x < y).sum(), na, nb, g) for g in grid])]
        true = len(shingles(a) & shingles(other)) / len(shingles(a) | shingles(other))
        assert abs(best - true) < 0.15
        assert setsketch.likely([ka], [kb], np.array([na]), np.array([nb]))[0] or true < 0.85


def test_fingerprint_by_hand():
    r = random.Random(9)
    for text in [None, "", " \x0b", "One", "a B c", *["".join(r.choice(["Wort ", "é", "x\t", " y\n", "\x0c", "Zz", "\xa0"]) for _ in range(r.randrange(80))) for _ in range(1000)]]:
        w = words(text)
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        want = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0
        assert simhash.fingerprint(text) & (2**64 - 1) == want


def cheapest(rows):
    """Least (cost, audit) over all edits of rows (initial, fault), by search over whole prefixes."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, said = heapq.heappop(heap)
        if (i, said[-2:] if said else "", len(said) > 1) in seen:
            continue
        seen.add((i, said[-2:] if said else "", len(said) > 1))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", said):
            return cost, audit
        steps = [(2, "I", i, x) for x in "ua"]
        if i < len(rows):
            initial, fault = rows[i]
            steps.append((3, "D", i + 1, ""))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                steps += [(2 + more, "R", i + 1, x) for x in "ua"] + ([(more, "K", i + 1, initial)] if initial in list("sua") else [])
        for c, letter, j, x in steps:
            new = said + x
            if re.fullmatch("(s|s?(ua)*u?)", new) and len(new) <= 2 * len(rows) + 2:
                heapq.heappush(heap, (cost + c, audit + letter, j, new))


def told(conversation):
    """The contract, conversation by conversation: rows (turn, role, text) after damage."""
    rows = sorted(conversation, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        last = text.rstrip(BLANK)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = cheapest([(role[:1], f) for (_, role, _), f in zip(rows, faults)])
    out, i, state = [], 0, ""
    for letter in audit:
        new = "assistant" if state == "u" else "user"
        role, text = {"I": (new, ""), "R": (new, rows[i][2] if i < len(rows) else ""), "K": rows[i][1:] if i < len(rows) else None, "D": None}[letter] or (None, None)
        i += letter != "I"
        if letter != "D":
            out.append(f"{role}:{text}")
            state = role[:1]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_repair_by_hand(spark):
    r = random.Random(12)
    rows = []
    for c in [*range(260), None]:
        for _ in range(r.randrange(1, 6)):
            text = r.choice(["Yes.", "No!", "cut off", " \t\x0b", "", "Why?\n ", "", None, "Yes.", "é。", "\xa0"])
            rows.append((c, r.choice([None, 0, 1, 2, 3, 5, 9]), r.choice(["user", "assistant", "system", "tool", "", None, "User"]), text, "x"))
    rows += [(c, 0, "user", "Yes.", "x") for c in range(1000, 1400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]  # all turns dropped
    rows = list({(a, b, c, d): (a, b, c, d, e) for a, b, c, d, e in rows}.values())
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string").repartition(5)
    want, present = {}, {}
    for c, turn, role, text, _ in rows:
        own, present[c] = want.setdefault(c, []), True
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        own += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    got = {x.conv_id: tuple(x)[1:] for x in repair.report(repair.damage(df), present_col="present").collect()}
    assert got.keys() == want.keys() and any(not v for v in want.values())
    for c, v in want.items():
        assert got[c] == (told(v) if v else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())), (c, v)


def test_repaired_turns_and_long_conversations(spark):
    rows = [(1, 1, "user", "Hi."), (1, 2, "user", "cut"), (1, 3, "assistant", "Yes."), (1, 3, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    out = [(x.at, x.turn, x.fault, x.edit, x.was, x.role, x.text) for x in repair.repair(df).orderBy("at").collect()]
    assert out == [(1, 1, None, "K", "user", "user", "Hi."), (2, 2, "truncated", "D", "user", None, None), (3, 3, None, "K", "assistant", "assistant", "Yes."), (4, 3, "duplicate", "D", "assistant", None, None)]
    long = spark.range(60_000).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("Text "), "id", F.lit(".")).alias("text"))
    x = repair.report(long.repartition(4)).first()
    assert (x.cost, x.audit, x.illegal, x.gaps) == (60_000, "KR" * 30_000, 59_999, 0)
    assert x.repaired_sha256 == hashlib.sha256("\n".join(f"{'assistant' if i % 2 else 'user'}:Text {i}." for i in range(60_000)).encode()).hexdigest()
    assert repair.report(df.limit(0)).count() == 0 and repair.repair(df.limit(0)).count() == 0


def features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(w), [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in itertools.pairwise(w)]]


def test_resampling_by_hand(spark):
    r = random.Random(21)
    texts = [(i, r.choice(["", "The ", "é`x "]) + prose(i % 40, r.randrange(60))) for i in range(300)] + [*ODD, (299, "a " * 40), (7, None), (301, "b-c_D " * 30)] + [(400, "same words here " * 9)] * 3
    target = [(i, prose(i, 25)) for i in range(5)] + [(9, None)]
    df = docs(spark, texts).repartition(7)
    goal = spark.createDataFrame(target, "item_id long, text string")
    found = [features(t) for _, t in texts]
    s, t = Counter(b for _, f in found for b in f), Counter(b for _, x in target for b in features(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ss + 10_000) / ((s[b] + 1) * (tt + 10_000)))) for b in s}
    rows = []
    for (i, _), (n, f) in zip(texts, found):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((x for x in rows if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = 25 * len(able) // 100
    got = resample.draw(resample.materialize(resample.importance(df, goal), "scores")).collect()
    assert Counter((x["__id"], x.n_words, x.n_features, x.weight, x.score) for x in got) == Counter(rows)
    ranked = sorted((x for x in got if x["rank"]), key=lambda x: x["rank"])
    assert [x["rank"] for x in ranked] == list(range(1, drawn + 1))
    assert [(x["__id"], x.score) for x in ranked] == [(x[0], x[4]) for x in able[:drawn]]
    kept = resample.resample(df, goal).collect()
    assert Counter(x.doc_id for x in kept) == Counter(x[0] for x in able[:drawn]) and kept[0].rank == 2
    assert resample.resample(df.limit(0), goal).count() == 0 and resample.resample(df, goal.limit(0)).count() == drawn


def test_runs_in_blocks(monkeypatch):
    text = prose(3, 500) + " Ünïcode " + "x" * 5000 + " end"
    whole = [list(map(int, np.concatenate(x))) for x in zip(*[runs for _, runs in resample.feature_hashes(text, 3)])]
    monkeypatch.setattr(resample, "_BLOCK", 50)
    parts = [list(map(int, np.concatenate(x))) for x in zip(*[runs for _, runs in resample.feature_hashes(text, 3)])]
    w = text.split()
    assert parts == whole == [[zlib.crc32(" ".join(w[i : i + n]).encode()) for i in range(len(w) - n + 1)] for n in (1, 2, 3)]


def test_long_runs_of_blanks(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.byte_bpe()
    for text in (" " * 2_000_000 + "word", "a" + "\n" * 2_000_000, "x" + " \n\t" * 666_666 + "<|endoftext|>" + "\xa0" * 1_200_000 + "\ny"):
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(packing.ByteBpe, "LONG_RUN", 3)
    monkeypatch.setattr(packing.ByteBpe, "BLANKS", re.compile(packing.ByteBpe.BLANKS.pattern.replace("10000", "3")))
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice([" ", "\n", "\x1c", "\x85", "　", "​", "a", "7", "!", "'s", "<|endoftext|>", " " * 5]) for _ in range(r.randrange(14)))
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    out = packing.pack_documents(docs(spark, [(1, "a" + " " * 1_100_000 + "b"), (2, "short")])).collect()
    assert sum(x.length for x in out if x.doc_id == 1) == len(library.encode("a" + " " * 1_100_000 + "b", add_special_tokens=False).ids) + 1
    for bad in ({"max_tokens": 0}, {"max_loss": 0}):
        with pytest.raises(ValueError, match="room"):
            packing.cut_pieces(docs(spark, []), **bad)


def test_whole_licences_by_digest(spark):
    import os

    from docloom.llm import licenses

    folder = "/usr/share/common-licenses"
    names = [("GPL-3", "GPL-3.0"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0")]
    if not all(os.path.exists(f"{folder}/{n}") for n, _ in names):
        pytest.skip("no licence texts on this machine")
    texts = [open(f"{folder}/{n}", encoding="utf-8").read() for n, _ in names]
    rows = [(i, t.upper().replace(" ", "   ").replace("\n", " \n\n")) for i, t in enumerate(texts)] + [(i + 10, t + " and one word") for i, t in enumerate(texts)]
    known = spark.createDataFrame(licenses.KNOWN, "license string, text string")
    got = {r.doc_id: r.license for r in licenses.scan_licenses(docs(spark, rows), known).collect()}
    assert got == {0: "GPL-3.0", 1: "Apache-2.0", 2: "MPL-2.0", 10: None, 11: None, 12: None}


def test_spellings_in_turn(spark):
    from docloom.llm import licenses

    texts = ["sub licence", "The behaviour, WHILST authorised.", "nothing here", "", None, "licenced licence sub-licence fulfil"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(licenses.canonical(F.col("t"))).collect()]
    assert got == ["sublicense", "the behavior while authorized", "nothing here", "", "", "licensed license sublicense fulfill"]

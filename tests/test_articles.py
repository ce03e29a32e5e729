import random

from pyspark.sql import functions as F

from docloom.operators import articles
from docloom.sources import corpus


def utf8_by_hand(data):
    out, i = "", 0
    while i < len(data):
        need = 0 if data[i] < 0x80 else 1 if 0xC0 <= data[i] < 0xE0 else 2 if 0xE0 <= data[i] < 0xF0 else 3 if 0xF0 <= data[i] < 0xF8 else None
        if need is None:
            out, i = out + "�", i + 1
        elif need and i + need >= len(data):
            return out + "�"
        elif any(b & 0xC0 != 0x80 for b in data[i + 1 : i + 1 + need]):
            out, i = out + "�", i + 1
        else:
            try:
                out += data[i : i + 1 + need].decode()
            except UnicodeDecodeError:
                out += "�"
            i += 1 + need
    return out


def test_all_sequences_of_two_bytes():
    r = random.Random(1)
    cases = [bytes([a, b]) for a in range(256) for b in range(256)] + [bytes(r.choice([0x41, 0x80, 0xBF, 0xC1, 0xE0, 0xA0, 0xED, 0xF0, 0x90, 0xF4, 0xF8, 0xEA, 0xB0]) for _ in range(r.randrange(9))) for _ in range(30_000)]
    for data in cases:
        assert corpus.lenient_utf8(data) == utf8_by_hand(data), data
    for a in range(0, 256, 3):
        for units in ((0xD800 + a, 0xDC00), (0xD800 + a, 65), (0xDC00 + a, 65), (65, 0xD800 + a), (a, 0, 65)):
            data = b"".join(u.to_bytes(2, "little") for u in units)
            want, i = "", 0
            while i < len(units):
                pair = 0xD800 <= units[i] < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000
                want += chr(0x10000 + (units[i] - 0xD800 << 10) + units[i + 1] - 0xDC00) if pair else "�" if 0xD800 <= units[i] < 0xE000 else chr(units[i])
                i += 1 + pair
            assert corpus.lenient_utf16(data) == want and corpus.lenient_utf16(data + b"x") == want and corpus.lenient_utf16(data, True) == want.partition("\0")[0]


def test_encodings_and_contents(spark, tmp_path):
    law = "# 선박 법\n[시행 2021. 3-4.] [법률 제123호, 2020/1/2., 일부개정]\n제1조(목적) 가\n  ## 제 2 조의 3 나\n본문 제4조 다\n"
    for name, data in {"법_가.md": law.encode(), "시행령_나.md": law.encode("cp949"), "x_다.md": b"\xef\xbb\xbf" + law.encode(), "z_라.md": b"\xff\xff\xff", "y_마.md": law.encode()}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.name: r for r in corpus.contents(corpus.read_corpus(spark, str(tmp_path)), [("^시행령", "DECREE", 2)]).collect()}
    a = rows["법_가.md"]
    assert (a.kind, a["rank"], a.title, a.effective, a.revised, a.encoding, a.error, a.articles, a.lines) == ("LAW", 1, "선박 법", "2021.3.4", "2020.1.2", "utf-8-sig", None, 2, 6)
    assert (rows["시행령_나.md"].encoding, rows["시행령_나.md"].kind, rows["시행령_나.md"].articles) == ("cp949", "DECREE", 2) and rows["x_다.md"].chars == a.chars == len(law)
    assert a.same_as == "y_마.md" and rows["y_마.md"].same_as is None
    assert (rows["z_라.md"].encoding, rows["z_라.md"].error, rows["z_라.md"].title) == (None, "in none of the encodings", "라")
    odd = spark.createDataFrame([(b"",), (None,)], "b binary").coalesce(1).select(corpus.decoded(F.col("b")).alias("d"), corpus.lenient(F.col("b")).alias("l")).collect()
    assert odd[0].d.error == "empty" and odd[1].d is None and (odd[0].l, odd[1].l) == ("", None)


def test_spans_rebuild_the_text(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["제1조 (가)", "제 2조의3(나)", "  본문", "\n", "é𝄞", "x"]) for _ in range(r.randrange(30))) for _ in range(80)] + ["", None, "제1조(가)" * 3000, "y" * 1_000_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    pattern = r"(제\s?\d+조(?:의\s?\d+)?\s*\([^)]*\))"
    for row in df.select("t", articles.matches(F.col("t"), pattern).alias("m"), articles.chunks(F.col("t"), pattern).alias("c")).collect():
        if row.t is None:
            assert row.m is None and row.c is None
            continue
        whole = row.t[: row.m[0].start] + "".join(m.match + m.rest for m in row.m) if row.m else row.t
        assert whole == row.t and all(row.t.startswith(m.match, m.start) for m in row.m)
        assert [(c.article, c.text) for c in row.c] == ([(m.match, (m.match + m.rest).strip()[:1200]) for m in row.m] or [("전문", row.t[:2000])])
        assert all(row.t[c.start : c.end].strip()[:1200] == c.text for c in row.c if c.article != "전문")


def test_grounding_takes_one_more_when_kinds_fill_it(spark):
    ranked = spark.createDataFrame([("q", "a", i, 100 + i, i) for i in range(5)] + [("q", "b", 10, 5000, 9)], "g string, k string, i int, n int, o int")
    first = spark.createDataFrame([("a", 0, 100), ("b", 10, 5000), ("c", 20, 50)], "k string, i int, n int")
    pick = lambda most, budget: [(r.i, r.covers) for r in articles.grounding(ranked, first, "g", "k", "i", "n", ["o"], ["c", "b", "a", "d"], most, budget).orderBy("place").collect()]
    assert pick(3, 10_000) == [(20, True), (10, True), (0, True), (1, False)]
    assert pick(5, 10_000) == [(20, True), (10, True), (0, True), (1, False), (2, False)]
    assert pick(9, 1900) == [(20, True), (10, True)] and pick(9, 49) == []
    assert pick(9, 2051) == [(20, True), (10, True), (0, True), (1, False)]

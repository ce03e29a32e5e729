from pyspark.sql import functions as F

from docloom.operators import extraction as x


def run(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"c {kind}").coalesce(1).select(f(F.col("c"))).collect()]


def test_labels(spark):
    cases = {"사고 일시 : 2020": None, "□ 일 시: 2020. 1. 3.": ": 2020. 1. 3.", "장소": "", "선장, 소형선박조종사": None, "장소에서 a": None, None: None}
    assert run(spark, cases, lambda c: x.after(c, "일시"))[:2] == [" : 2020", ": 2020. 1. 3."]
    assert run(spark, cases, lambda c: x.after(c, "장소"))[2:] == ["", None, None, None]
    assert run(spark, ["My KEY-word: v", "monkey word"], lambda c: x.after(c, "key word")) == [": v", None]
    garbled = {"□ 일 A}: 2020. 1. 3.": " 2020. 1. 3.", "일 가: x": None, "일: 한글": None, "일 abcdefghijklmnop: x": None, "매일 A: x": None, "일 abcdefghijklm: 1": " 1", "일 abcdefghijklmn: 1": None, None: None}
    assert run(spark, garbled, lambda c: x.after_garbled(c, "일")) == list(garbled.values())


def test_sections(spark):
    cases = {"주 문 a": True, "위와 같은 이유로": False, "1. 이유": False, "□ 이유": True, "해양사고관련자의 행위": True, "해양사고관련자 이 선박 선장 A가 조종하였다": False, "": False}
    assert run(spark, cases, lambda c: x.begins_section(c, x.DECISION)) == list(cases.values())
    cases = {"배가 침몰하였다 이 충돌사건은 발생": "배가 침몰하였다 ", "이 배. 사건은": None, "이 이 사고는": "이 ", "이 " + "가" * 18 + "사고는": "", "이 " + "가" * 19 + "사고는": None, None: None}
    assert run(spark, cases, lambda c: x.before_verdict(c, x.DECISION)) == list(cases.values())


def test_fields(spark):
    doc = ["□ 사건개요: 어선 충돌.", "□ 일 A}: 2020. 1. 3. 15:00", "□ 장 소: 부산 앞바다", "□ 사고 경위 배가 나갔다. 배가 나갔다. 안개가 끼었다. 이 충돌사건은 경계 소홀로 발생하였다.", "주 문 견책한다."]
    other = ["나. 사고발생원인 이 충돌사건은 과실로 발생한 것이다.", "교훈 조심하자."]
    got = run(spark, [doc, other, [], [None, ""], None], x.fields, "array<string>")
    assert [{r.label: r.sentences for r in f} for f in got[:2]] == [
        # a garbled label begins its field, but doesn't end the one before
        {"사건 개요": ["어선 충돌.", "일 A}: 2020. 1. 3. 15:00"], "일시": ["2020. 1. 3. 15:00"], "장소": ["부산 앞바다"], "사고 경위": ["배가 나갔다.", "안개가 끼었다."]},
        {"사건 개요": [], "일시": [], "장소": [], "사고 경위": ["이 충돌사건은 과실로 발생한 것이다."]},
    ]
    assert all(r.sentences == [] for f in got[2:] for r in f)
    long = ["사고경위"] + [f"문장 {chr(0xAC00 + i)}." for i in range(20)]
    assert len(run(spark, [long], x.fields, "array<string>")[0][3].sentences) == 12


def test_places(spark):
    ls = run(spark, [" a \t b\r\n\n장 소: 북위 34도 59분 1초\r동경 128도 3분 70초 (부산 해상)\n사고경위 c", None], x.lines)
    assert ls == [["a b", "장 소: 북위 34도 59분 1초", "동경 128도 3분 70초 (부산 해상)", "사고경위 c"], []]
    places = run(spark, ls + [["장소: 항구", "사고경위 해상"]], x.place, "array<string>")
    assert places == ["북위 34도 59분 1초 동경 128도 3분 70초 (부산 해상)", "", ""]
    assert run(spark, places + [None], x.position_suspect) == [True, False, False, False]
    assert run(spark, ["□ - 가. 값 ", None], x.clean_value) == ["값", None]


def test_confidence_and_tiers(spark):
    rows = [("v", "native", False, 1.0), ("v", "paddle", True, 0.4), ("v", "else", None, 0.5), (" ", "native", False, 0.0), (None, None, None, 0.0)]
    df = spark.createDataFrame(rows, "v string, o string, s boolean, want double")
    assert all(r[0] == r[1] for r in df.select(x.confidence(F.col("v"), F.col("o"), F.col("s")), "want").collect())
    rows = [("a", "bb", ("a", "one", 1)), ("", "bb", ("bb", "two", 2)), (None, None, (None, None, 2))]
    df = spark.createDataFrame([r[:2] for r in rows], "a string, b string").coalesce(1)
    assert [tuple(r[0]) for r in df.select(x.tiered({"one": F.col("a"), "two": F.col("b")})).collect()] == [r[2] for r in rows]
    long = {"one": F.length("a") > 1, "two": F.length("b") > 2}
    assert [tuple(r[0]) for r in df.select(x.tiered({"one": F.col("a"), "two": F.col("b")}, long)).collect()] == [("bb", "two", 2), ("bb", "two", 2), (None, None, 2)]

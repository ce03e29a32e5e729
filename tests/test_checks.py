import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import checks


def test_quality_and_review(spark):
    good = "가" * 60 + "b" * 250
    rows = [(good, "x", "북위 34도 5분 1초 동경 128도 3분 7초", "native"), (good, " ", "북위 34도 5분 1초 동경 128도 3분 70초", "native"), (good[:290], "x", "장소", "ocrmypdf"), (None, None, None, "else"), ("b" * 900, "x", "y", "else")]
    df = spark.createDataFrame(rows, "text string, a string, place string, o string").coalesce(1)
    r = checks.review({"a": F.col("a"), "place": F.col("place")}, {"a": F.col("o"), "place": F.col("o")}, place="place")
    out = df.select(checks.native_quality_ok(F.col("text"), F.col("a"), F.col("place")).alias("ok"), r.alias("r")).collect()
    assert [x.ok for x in out] == [True, False, False, False, False]
    assert [x.r.reasons for x in out] == [[], ["missing a", "suspect position", "doubtful place"], [], ["missing a", "missing place"], ["doubtful a", "doubtful place"]]
    assert [x.r.needs_review for x in out] == [False, True, False, True, True] and out[1].r.confidence == {"a": 0.0, "place": 0.4}


def test_terms_and_records(spark):
    tagged = [("사건", "NNG"), ("선박", "NNG"), ("배", "NNG"), ("가다", "VV"), ("선박", "NNG")]
    df = spark.createDataFrame([(tagged,), ([],), (None,)], "t array<struct<term:string,tag:string>>").coalesce(1)
    assert [r[0] for r in df.select(checks.kept_terms(F.col("t"))).collect()] == [["선박", "선박"], [], None]
    r = spark.createDataFrame([("충돌_가.나.hwp", "o", None, "p", "")], "n string, o string, d string, p string, a string").select(checks.stage_record(*map(F.col, "nodpa")).alias("r")).first().r
    assert tuple(r) == ("충돌_가.나", "충돌_가.나.hwp", "충돌", "o", "", "p", "", "o")
    p = spark.createDataFrame([("x" * 8000, None)], "t string, a string").select(checks.audit_payload(F.col("t"), a=F.col("a"))).first()[0]
    assert json.loads(p) == {"text": "x" * 7000, "fields": {"a": ""}}


def test_guards(spark, tmp_path):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (3, "y")], "k int, v string")
    with pytest.raises(ValueError, match=r"no persona for \[2\]"):
        checks.joined_or_fail(a, b, "k", "persona")
    assert checks.joined_or_fail(a.where("k = 1"), b, "k", "persona").collect() == [(1, "x")]
    (tmp_path / "t.json").write_text('{"categories": {"A": ["a1",\n "a2"], "B": []}}')
    assert sorted(checks.read_taxonomy(spark, str(tmp_path / "t.json")).collect()) == [("A", "a1"), ("A", "a2")]
    (tmp_path / "u.json").write_text('{"other": {}}')
    with pytest.raises(ValueError, match="no categories"):
        checks.read_taxonomy(spark, str(tmp_path / "u.json"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        checks.read_taxonomy(spark, str(tmp_path / "none.json"))
    files = spark.createDataFrame([("/d/a.md", 5, []), ("/d/b.md", 0, []), ("/d/c.md", 3, ["short"]), ("/d/other", 0, ["no"])], "path string, length long, faults array<string>")
    gate = checks.output_gate(files, ["a.md", "b.md", "c.md", "d.md"], F.col("faults")).first()
    assert (gate.status, gate.failures) == ("FAIL", ["b.md: empty", "c.md: short", "d.md: missing"])
    assert tuple(checks.output_gate(files, ["a.md"], F.col("faults")).first()) == ("PASS", []) and checks.gold_evaluation(spark, "none").first().evaluated is False


def test_exact_signed_ranks(spark):
    from itertools import product

    from docloom.operators import paired

    values = [1.5, -2.0, 3.0, -4.5, 5.0, 6.0, 7.0]
    low = min(sum(r for r, v in zip(range(1, 8), values) if v > 0), sum(r for r, v in zip(range(1, 8), values) if v < 0))
    want = sum(min(s := sum(r for r, x in zip(range(1, 8), signs) if x), 28 - s) <= low for signs in product((0, 1), repeat=7)) / 2**7
    p = lambda v: paired.wilcoxon_p(spark.createDataFrame([(x, 0.0) for x in v] + [(None, 1.0)], "a double, b double"), F.col("a"), F.col("b")).first()
    assert p(values).p_value == pytest.approx(want) and p(values).ties == 0
    tied, zero = p([*values, -3.0]), p([*values, 0.0])
    assert (tied.ties, zero.ties) == (2, 1) and tied.p_value == pytest.approx(paired.chi2_tail(tied.z**2)) and p([]).p_value is None


def test_numeric_references(spark):
    from docloom.operators.fields import unescape_xml

    cases = {"&#44032;&#x1F600;x&#65;": "가😀xA", "&#0;&#xD800;&#1114112;&#38;lt;": "&#0;&#xD800;&#1114112;&lt;", "a &lt;&amp;amp;": "a <&amp;", "&#": "&#", "": "", None: None}
    assert [r[0] for r in spark.createDataFrame([(c,) for c in cases], "c string").coalesce(1).select(unescape_xml(F.col("c"))).collect()] == list(cases.values())


def test_a_second_reading(spark):
    from docloom.operators import runs

    rows = [("a", "b", "x", "y", "가나", "가나다라"), ("a", " ", "x", "y", "가", ""), ("a", None, "x", None, "가", "가나"), ("a", "b", "x", "y", "가", "가나다"), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, s string, t string").coalesce(1)
    took = lambda always: [(tuple(r.fields), r.added, r.adopted, r.richer) for (r,) in df.select(runs.taken_over({"a": F.col("a"), "b": F.col("b")}, {"a": F.col("c"), "b": F.col("d")}, F.col("s"), F.col("t"), always=always)).collect()]
    assert took(False) == [(("a", "b"), [], False, False), (("a", "y"), ["b"], True, False), (("a", None), [], True, True), (("a", "b"), [], False, False), ((None, None), [], False, False)]
    assert [x[2] for x in took(True)] == [True] * 5

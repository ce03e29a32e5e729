from docloom.plans import reports


def test_whole_text_is_normalized(spark, tmp_path):
    cases = ["“a”  b′", "사건개요□장소", "a é b , c", "( é b )", "x.y?z", "a�b\u0007c|d", "wait...", "", None, "word ‘q’ \n" * 200]
    want = ["\"a\" b'", "사건개요 장소", "a b, c", "(b)", "x. y? z", "abc d", "wait. . .", "", None, ("word 'q' " * 200).strip()]
    spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.text for r in reports.normalize_whole_text(spark, str(tmp_path)).orderBy("doc_id").collect()] == want


def test_quality_goes_through_a_whole_text_once(spark):
    from pyspark.sql import functions as F

    from docloom.functions.text import quality

    plan = spark.createDataFrame([("a",)], "t string").select(quality(F.col("t")).alias("q"))._jdf.queryExecution().executedPlan()
    code = plan.toString()
    # every other pattern runs on what the first one leaves
    assert all("0-9A-Za-z" in x[:40] for x in code.split("regexp_replace(t#")[1:])
    texts = ["", "word one", "a\x00\x01b \ufffd\ufffd!", "\uac00\ub098 \u6f22\u5b57 \u2003\u3000 ?", "\n\n", "\x7f", "x" * 1500]
    got = [r.q for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(quality(F.col("t")).alias("q")).collect()]
    import math
    import re

    spaces, controls, replaced = r"\t\n\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f", "\ufffd"
    good = r"0-9A-Za-z\uac00-\ud7a3\u1100-\u11ff\u3130-\u318f\u4e00-\u9fff\u3040-\u30ff"
    for t, q in zip(texts, got):
        visible = len(re.sub(f"[{spaces}{controls}{replaced}]", "", t))
        want = 0.55 * len(re.findall(f"[{good}]", t)) / max(visible, 1) + 0.45 * min(1, math.log1p(visible) / math.log1p(1200)) - 1.5 * t.count(replaced) / max(len(t), 1) - len(re.findall(f"[{controls}]", t)) / max(len(t), 1)
        assert abs(q - max(0, min(1, want))) < 1e-12

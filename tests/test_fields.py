from pyspark.sql import functions as F

from docloom.operators import fields


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}")


def test_formats(spark):
    rows = [(b"%PDF-1.7", "a.hwp"), (bytes.fromhex("D0CF11E0A1B11AE100"), "x"), (b"PK\x03\x04..", "x.zip"), (b"text", "dir.pdf/name"), (b"", "B.HWPX"), (b"x", "b.txt"), (None, None)]
    df = spark.createDataFrame([(bytearray(c) if c is not None else None, p) for c, p in rows], "c binary, p string")
    out = df.select(fields.detect_format(F.col("c"), F.col("p")), fields.extension_lower(F.col("p"))).collect()
    assert [r[0] for r in out] == ["pdf", "hwp", "hwpx", None, "hwpx", None, None]
    assert [r[1] for r in out] == ["hwp", "", "zip", "", "hwpx", "txt", None]


def test_flags(spark):
    df = spark.createDataFrame([("충돌", True), ("a", False), ("2023.07.08", True), ("20", False), (None, False)], "c string, want boolean")
    assert all(r[0] == r[1] for r in df.select(fields.is_meaningful(F.col("c")), "want").collect())
    df = spark.createDataFrame([("this answer is in English", True), ("oneverylongwordwithoutblank", False), ("too short", False), ("선박이 충돌하였다 그리고 침몰 하였다 a b", False), (None, False)], "c string, want boolean")
    assert all(r[0] == r[1] for r in df.select(fields.language_drift(F.col("c")), "want").collect())
    df = spark.createDataFrame([(False, False, 96, False, True), (False, False, 90, False, False), (True, False, 100, False, False), (True, True, 1, True, True), (None, None, None, None, False)], "v boolean, p boolean, t int, s boolean, want boolean")
    assert all(r[0] == r[1] for r in df.select(fields.is_runaway(F.col("v"), F.col("p"), F.col("t"), 100, F.col("s")), "want").collect())


def test_dates_and_coordinates(spark):
    cases = {"2023.7.8.13.:30": "2023-07-08 13:30", "at 2021년 12월 1일 9시 5 분": "2021-12-01 09:05", "2023-13-01 10:00": None, "2023.1.2": None, "": None}
    out = {r.c: r[1] for r in spark.createDataFrame([(c,) for c in cases], "c string").select("c", fields.fuzzy_date(F.col("c"))).collect()}
    assert out == cases
    cases = {"북위 34도 59분 59초": False, "북위 34도 61분 00초": True, "35° 10' 75\"": True, "no": False}
    assert {r.c: r[1] for r in spark.createDataFrame([(c,) for c in cases], "c string").select("c", fields.coordinate_suspect(F.col("c"))).collect()} == cases
    assert one(spark, None).select(fields.fuzzy_date(F.col("c")), fields.coordinate_suspect(F.col("c"))).first()[:] == (None, False)


def test_texts(spark):
    assert one(spark, "&lt;a&gt; &amp;lt; &quot;").select(fields.unescape_xml(F.col("c"))).first()[0] == '<a> &lt; "'
    assert one(spark, "\x1b[1;31mred\x1b[0m x").select(fields.without_escapes(F.col("c"))).first()[0] == "red x"
    assert [one(spark, v, "double").select(fields.number_text(F.col("c"), 2)).first()[0] for v in (1.005, 0.125, float("nan"), None)] == ["1.00", "0.12", "N/A", "N/A"]
    out = one(spark, " x ").select(fields.first_filled(a=F.lit(None).cast("string"), b=F.lit("  "), c=F.col("c")).alias("f")).select("f.*").first()
    assert out[:] == ("x", "c")
    assert one(spark, "Qwen3-14B").select(fields.model_family(F.col("c"), {"llama": "l", "qwen": "q"})).first()[0] == "q"
    score = {k: F.lit(4.0) for k in fields.CONTRIBUTION}
    assert abs(one(spark, "x").select(fields.contribution(**score)).first()[0] - 1) < 1e-12


def test_budget(spark):
    rows = [("q", "a", 9, 700), ("q", "a", 8, 900), ("q", "b", 7, 1000), ("q", "c", 6, 300), ("q", "b", 5, 400), ("q", "a", 4, 100)]
    df = spark.createDataFrame(rows, "g string, file string, score int, cost int")
    out = fields.within_budget(df, "g", "file", [F.desc("score")], F.col("cost"), 1800, 2800, 4).orderBy("rank").collect()
    # a 700 and b 1000 cover; c would pass 1800 and ends that pass; then 900, and 300 passes 2800
    assert [(r.file, r.cost, r.covers) for r in out] == [("a", 700, True), ("a", 900, False), ("b", 1000, True)]


def test_layout(spark):
    boxes = [(0.0, 10.0), (5.0, 10.0), (9.0, 10.0), (20.0, 10.0), (27.0, 10.0), (29.0, 10.0)]
    df = spark.createDataFrame([([{"y": y, "height": h} for y, h in boxes],)], "items array<struct<y double, height double>>")
    assert df.select(fields.rows_by_height(F.col("items"))).first()[0] == [0, 0, 1, 2, 2, 3]
    df = spark.createDataFrame([(1, float(x)) for x in (0, 1, 2, 3, 50, 51, 52, 53)] + [(2, 1.0), (2, 9.0)], "p int, x double")
    assert {r.p: r.gutter for r in fields.gutter(df, "p", "x").collect()} == {1: 26.5, 2: None}

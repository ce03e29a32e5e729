import math

from pyspark.sql import functions as F

from docloom.functions.text import quality, strip_reasoning
from docloom.operators.paired import chi2_tail, kappa, mcnemar
from docloom.operators.similarity import group_gap
from docloom.operators.tables import last_before, segments


def test_gap_equals_pairs(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.6, 0.8]), (1, [0.0, 1.0])]
    r = group_gap(spark.createDataFrame(rows, "g int, v array<float>"), "v", "g").first()
    assert (r.intra_n, r.inter_n) == (1, 2) and math.isclose(r.intra_mean, 0.6, abs_tol=1e-6) and math.isclose(r.inter_mean, 0.4, abs_tol=1e-6)


def test_text_functions(spark):
    df = spark.createDataFrame([("a<think>x</think>b <think>c",), (None,)], "t string")
    assert [r[0] for r in df.select(strip_reasoning(F.col("t"))).collect()] == ["ab", None]
    assert 0 <= df.select(quality(F.col("t"))).first()[0] <= 1


def test_paired(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (0, 1), (1, 1)], "a int, b int")
    assert mcnemar(df, F.col("a") == 1, F.col("b") == 1).first().statistic == 0.0
    assert kappa(df, F.col("a"), F.col("b")).first().n == 4 and math.isclose(chi2_tail(0), 1)


def test_last_before_and_segments(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "x"), (1, 3, "b"), (2, 1, "b")], "g int, t int, k string")
    out = last_before(df, "g", ["t"], F.col("t"), F.col("k") == "x", "at")
    assert sorted((r.g, r.t, r.at) for r in out.collect()) == [(1, 1, None), (1, 2, 2), (1, 3, 2), (2, 1, None)]
    assert [r.segment for r in segments(df, "g", "t", F.col("k") == "x").orderBy("g", "t").collect()] == [0, 1, 1, 0]

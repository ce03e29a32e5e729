import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import kmeans, paired, pairs, tables


def test_bootstrap_of_any_statistic(spark):
    r = np.random.default_rng(8)
    x, on = r.gamma(2.0, 3.0, 4000), r.random(4000) < 0.4
    x[on] += 0.7
    df = spark.createDataFrame([("g", i, float(v), bool(b)) for i, (v, b) in enumerate(zip(x, on))] + [("h", 9000 + i, 2.0, True) for i in range(5)] + [(None, -1, None, None)], "k string, i long, x double, o boolean").repartition(6)
    o = F.col("o")
    parts = {"x": F.col("x"), "a": F.when(o, F.col("x")), "na": o.cast("int"), "b": F.when(~o, F.col("x")), "nb": (~o).cast("int")}
    statistics = {"mean": lambda s: s["x"] / s["n"], "rate": lambda s: s["na"] / s["n"], "difference": lambda s: s["a"] / F.nullif(s["na"], F.lit(0.0)) - s["b"] / F.nullif(s["nb"], F.lit(0.0))}
    by_hand = {"mean": lambda v, b: v.mean(), "rate": lambda v, b: b.mean(), "difference": lambda v, b: v[b].mean() - v[~b].mean()}
    for name, statistic in statistics.items():
        got = {row.k: row for row in paired.bootstrap(df, ["k"], ["i"], parts, statistic, 1500).collect()}
        draws = [by_hand[name](x[i], on[i]) for i in (r.integers(0, 4000, 4000) for _ in range(1500))]
        low, high = np.percentile(draws, [2.5, 97.5])
        assert got["g"].n == 4000 and got["g"].value == pytest.approx(by_hand[name](x, on), abs=1e-9)
        assert got["g"].low == pytest.approx(low, abs=0.12 * (high - low)) and got["g"].high == pytest.approx(high, abs=0.12 * (high - low))
        assert got[None].n == 1
    assert (got["h"].low, got["h"].value) == (None, None)
    again = paired.bootstrap(df.repartition(2), ["k"], ["i"], parts, statistics["mean"], 300).where("k = 'g'").first()
    first = paired.bootstrap(df, ["k"], ["i"], parts, statistics["mean"], 300).where("k = 'g'").first()
    assert (again.low, again.high) == pytest.approx((first.low, first.high), abs=1e-9)
    assert paired.bootstrap(df.limit(0), ["k"], ["i"], parts, statistics["mean"], 10).count() == 0


def test_labels_stand_before_their_bodies(spark):
    labels = spark.createDataFrame([("p", 1.0, 1), ("p", 5.0, 2), ("p", 5.0, 3), ("p", 9.0, 4), ("q", 1.0, 5)], "g string, y double, i int")
    bodies = spark.createDataFrame([("p", 0.5, 10), ("p", 5.0, 11), ("p", 5.0, 12), ("p", 6.0, 13), ("r", 1.0, 14)], "g string, y double, i int")
    out = tables.interleaved(labels, bodies, "g", "y", "i").orderBy("g", "place").collect()
    assert [(x.g, x.i, x.opens) for x in out] == [("p", 10, None), ("p", 1, 11), ("p", 2, 11), ("p", 3, 11), ("p", 11, None), ("p", 12, None), ("p", 13, None), ("p", 4, None), ("q", 5, None), ("r", 14, None)]


def test_silhouettes_of_several_labellings_at_once(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    one, two = ["ab"[i % 2] for i in range(60)], [i // 21 for i in range(59)] + [None]
    df = spark.createDataFrame([(f"i{i:02d}", v.tolist(), one[i], two[i]) for i, v in enumerate(x)] + [("nan", [float("nan")] * 5, "a", 0), ("null", [None] * 5, "a", 0), ("none", None, "b", 1)], "id string, v array<double>, one string, two long")
    got = {row.labelling: row for row in pairs.silhouettes(df, "id", "v", ["one", "two"]).collect()}
    d = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T))
    for name, own in (("one", one), ("two", two)):
        s = []
        for i in range(60):
            mine = [j for j in range(60) if own[j] == own[i] and j != i]
            if mine:
                b = min(d[i, [j for j in range(60) if own[j] == g]].mean() for g in set(own) if g != own[i])
                a = d[i, mine].mean()
                s.append((b - a) / max(a, b))
        assert got[name].n == len(s) and got[name].silhouette == pytest.approx(np.mean(s), abs=2e-6)
    assert sorted(r.grp for r in pairs.within_group(df, "id", "v", "one").collect()) == ["a", "b"]


def test_an_empty_cluster_takes_the_farthest_row(spark, monkeypatch):
    x = [[0.0], [1.0], [2.0], [50.0], [10.0]]
    df = spark.createDataFrame(list(enumerate(x)), "id int, v array<double>").repartition(3)
    monkeypatch.setattr(kmeans, "seeds", lambda *a: np.array([[[1.0], [900.0], [901.0]]]))
    wcss, centres = kmeans.sweep(df, "id", "v", [3], restarts=1, steps=10)[3]
    assert sorted(centres[:, 0].tolist()) == [1.0, 10.0, 50.0] and wcss == pytest.approx(2.0)

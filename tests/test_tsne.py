import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import tsne


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)


def test_perplexity_is_met(spark):
    x = np.random.default_rng(1).normal(size=(300, 6)) * np.linspace(0.1, 9, 300)[:, None]
    near = tsne.neighbours(table(spark, x), "id", "v", 45).cache()
    d2 = ((x[:, None] - x) ** 2).sum(axis=2)
    np.fill_diagonal(d2, np.inf)
    want = {(i, int(j)) for i in range(300) for j in np.argsort(d2[i], kind="stable")[:45]}
    assert {(r.i, r.j) for r in near.collect()} == want
    p = tsne.affinities(near, 15.0).toPandas()
    assert (abs(p.perplexity - 15) < 1e-3).all() and len(p) == 300 * 45
    whole = np.array([np.exp(-b * np.sort(d2[i])[:45]).sum() for i, b in zip(p.i, p.beta)])
    assert np.allclose(p.p, np.exp(-p.beta * d2[p.i, p.j]) / whole)
    s = tsne.symmetric(tsne.affinities(near, 15.0), 300).toPandas()
    assert s.p.sum() == pytest.approx(1) and {(i, j) for i, j in zip(s.i, s.j)} == {(j, i) for i, j in zip(s.i, s.j)}


@pytest.mark.parametrize("dims, scale, tolerance", [(2, 1.0, 1e-3), (2, 20.0, 5e-3), (3, 2.0, 2e-3), (2, 1e-4, 1e-3)])
def test_gradient_by_hand(spark, dims, scale, tolerance):
    r = np.random.default_rng(7)
    n = 500
    y = r.normal(size=(n, dims)) * scale
    picks = [(i, int(j)) for i in range(n) for j in r.choice(n, 12, replace=False) if i != j]
    pairs = {(i, j): r.random() for i, j in picks}
    total = 2 * sum(pairs.values())
    p = np.zeros((n, n))
    for (i, j), w in pairs.items():
        p[i, j] += w / total
        p[j, i] += w / total
    q = 1 / (1 + ((y[:, None] - y) ** 2).sum(axis=2))
    np.fill_diagonal(q, 0)
    diff = y[:, None] - y
    want = 4 * ((2.5 * p * q)[:, :, None] * diff).sum(axis=1) - 4 * ((q * q / q.sum())[:, :, None] * diff).sum(axis=1)
    edges = spark.createDataFrame([(int(i), int(j), float(p[i, j])) for i, j in zip(*np.nonzero(p))], "i long, j long, p double")
    state = table(spark, y).select("id", F.col("v").alias("y"))
    got = np.array([g.grad for g in sorted(tsne.gradient(state, edges, 2.5).collect(), key=lambda g: g.id)])
    assert np.abs(got - want).max() < tolerance * np.abs(want).max()


def test_layout_parts_clusters(spark, tmp_path):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(c, 0.2, size=(20, 5)) for c in np.eye(5)[:3] * 6])

    def write(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    out = sorted(tsne.layout(table(spark, x), "id", "v", write, perplexity=8, steps=24, early=20, rate=5.0).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    y = np.array([o.y for o in out])
    d = np.sqrt(((y[:, None] - y) ** 2).sum(axis=2))
    own = np.repeat(np.arange(3), 20)
    np.fill_diagonal(d, np.inf)
    assert (own[d.argmin(axis=1)] == own).all()
    assert tsne.layout(table(spark, x).limit(0), "id", "v", write).count() == 0

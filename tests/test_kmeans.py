import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import kmeans


def test_sweep_by_hand(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, size=(25, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>")
    first = kmeans.seeds(df, "id", "v", 4, 2)
    assert first.shape == (2, 4, 2) and all((x == s).all(axis=1).any() for r in first for s in r)
    assert (first == kmeans.seeds(df.repartition(7), "id", "v", 4, 2)).all()
    found = kmeans.sweep(df, "id", "v", [2, 3, 4], restarts=2, steps=20)
    for k in (2, 3, 4):
        results = []
        for r in range(2):
            c = first[r][:k].copy()
            for _ in range(20):
                own = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
                c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(k)])
            results.append(((x[:, None] - c) ** 2).sum(axis=2).min(axis=1).sum())
        assert abs(found[k][0] - min(results)) < 1e-6
    out = kmeans.assigned(df, "v", found[3][1]).groupBy("cluster").count().where("cluster is not null").collect()
    assert sorted(r["count"] for r in out) == [25, 25, 25]
    assert kmeans.elbow({k: w for k, (w, _) in found.items()}) == 3


def test_seeds_go_with_squared_distance(spark):
    """Over many restarts the second seed falls on each row as often as its squared distance says."""
    x = np.array([0.0, 1.0, 3.0])
    df = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(x)], "id long, v array<double>")
    got = kmeans.seeds(df, "id", "v", 2, 600)
    from_zero = got[got[:, 0, 0] == 0.0][:, 1, 0]
    assert len(from_zero) > 120 and np.mean(from_zero == 3.0) == pytest.approx(0.9, abs=0.09)


@pytest.mark.parametrize("n", [0, 2])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(n)], "id long, v array<double>")
    if n:
        assert kmeans.sweep(df, "id", "v", [2])[2][0] == 0
    else:
        assert kmeans.seeds(df, "id", "v", 2, 1).size == 0
    assert kmeans.assigned(df, "v", np.zeros((1, 2))).where(F.col("cluster") == 0).count() == n

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.sources import matrices as m


def test_round_trip_and_tasks(spark, tmp_path):
    a = np.random.default_rng(1).normal(size=(10_000, 7)).astype("<f4")
    a[3, 2], a[4, 1] = np.nan, np.inf
    (tmp_path / "a.f32").write_bytes(a.tobytes())
    df = m.read_matrix(spark, str(tmp_path / "a.f32"), 7, task_bytes=7 * 4 * 999)
    assert df.rdd.getNumPartitions() == 11
    rows = sorted(df.collect())
    assert [r.row for r in rows] == list(range(10_000)) and np.array_equal(np.array([r.vector for r in rows], dtype="<f4"), a, equal_nan=True)
    m.write_matrix(df.repartition(5), str(tmp_path / "b"), "vector", ["row"])
    again = m.read_matrix(spark, f"file://{tmp_path}/b", task_bytes=10_000)
    assert np.array_equal(np.array([r.vector for r in sorted(again.collect())], dtype="<f4"), a, equal_nan=True)
    m.write_matrix(df.limit(3), str(tmp_path / "b"), "vector", ["row"])
    assert m.read_matrix(spark, str(tmp_path / "b")).count() == 3 and len(list((tmp_path / "b").glob("*.f32"))) == 1
    m.write_matrix(df.limit(0), str(tmp_path / "c"), "vector", ["row"])
    assert m.read_matrix(spark, str(tmp_path / "c")).count() == 0


def test_what_is_refused(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"\0" * 30)
    for path, width, error in (("a", 7, "multiple of 28"), ("a", None, "width"), ("none", 7, "none")):
        with pytest.raises(Exception, match=error):
            m.read_matrix(spark, str(tmp_path / path), width).collect()
    for bad in ([[1.0], [1.0, 2.0]], [[1.0], None], [[1.0], [None]]):
        with pytest.raises(Exception, match="one length|several lengths"):
            m.write_matrix(spark.createDataFrame([(i, v) for i, v in enumerate(bad)], "i int, v array<float>"), str(tmp_path / "w"), "v", ["i"])
    assert not list((tmp_path / "w").glob("_matrix.json"))


def test_rows_by_position(spark, tmp_path):
    for k, n in enumerate((2500, 1, 700)):
        spark.range(n).select((F.col("id") + 10_000 * k).alias("x")).coalesce(1).write.option("parquet.block.size", 4096).mode("append").parquet(str(tmp_path / f"t/k={k}"))
    import pyarrow.parquet as pq

    files = sorted((tmp_path / "t").rglob("*.parquet"))
    want = [x for f in files for x in pq.ParquetFile(f).read()["x"].to_pylist()]
    left = m.numbered_parquet(spark, str(tmp_path / "t"))
    assert [r.x for r in left.orderBy("row").collect()] == want and left.agg(F.max("row")).first()[0] == len(want) - 1
    right = spark.range(len(want)).select(F.col("id").alias("row"), (F.col("id") * 2).alias("y"))
    assert {(r.x, r.y) for r in m.joined_by_row(left, right).collect()} == {(x, 2 * i) for i, x in enumerate(want)}
    with pytest.raises(ValueError, match="beside"):
        m.joined_by_row(left, right.where("row > 0"))

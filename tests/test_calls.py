import json
import os

import pytest
from pyspark.sql import functions as F

from docloom.operators import calls
from docloom.sources import cells


def keeper(spark, root):
    def write(df, name):
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    return write


def logged(log, fails_at=None, dies_at=None, flag=None):
    """A stub that notes each request it answers; at some text it raises, or, once, ends its process."""

    def client():
        def answer(requests):
            if any(r["t"] == fails_at for r in requests):
                raise RuntimeError("no")
            if dies_at and any(r["t"] == dies_at for r in requests) and not os.path.exists(flag):
                open(flag, "w").close()
                os._exit(3)
            with open(log, "a") as f:
                f.write("".join(json.dumps(r["t"]) + "\n" for r in requests))
            return [r["t"].upper() for r in requests]

        return answer

    return client


def test_one_call_a_key_even_when_a_task_dies(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i % 40}") for i in range(100)] + [(900, None)], "i int, t string").repartition(3)
    request, write = F.when(F.col("t").isNotNull(), F.struct("t")), keeper(spark, tmp_path)
    log = tmp_path / "log"
    with pytest.raises(Exception):
        calls.call_model(df, request, logged(log, dies_at="t17", flag=str(tmp_path / "flag")), str(tmp_path / "store"), batch=4, write=write).collect()
    before = log.read_text().split() if log.exists() else []
    out = calls.call_model(df, request, logged(log, dies_at="t17", flag=str(tmp_path / "flag")), str(tmp_path / "store"), batch=4, write=write).collect()
    asked = log.read_text().split()
    assert before and len(before) < 40 and len(asked) == len(set(asked)) == 40
    assert {(r.i, r.t, r.reply, r.error) for r in out} == {(i, f"t{i % 40}", f"T{i % 40}", None) for i in range(100)} | {(900, None, None, None)}
    again = calls.call_model(df, request, logged(log), str(tmp_path / "store"), batch=4, write=write).count()
    assert again == 101 and len(log.read_text().split()) == 40


def test_errors_are_rows(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "t string")
    out = {r.t: r for r in calls.call_model(df, F.struct("t"), logged(tmp_path / "log", fails_at="bad"), str(tmp_path / "s"), tries=4).collect()}
    assert (out["bad"].reply, out["bad"].error, out["bad"].attempts) == (None, "RuntimeError: no", 4) and out["a"].reply == "A" and out["c"].error is None
    assert calls.call_model(df.limit(0), F.struct("t"), logged(tmp_path / "log"), str(tmp_path / "s")).count() == 0


def test_requests_come_to_python_a_batch_at_a_time(spark, tmp_path):
    # in tables of pandas all requests that Spark hands over at once are Python strings
    df = spark.range(50).selectExpr("concat('t', id) AS t")
    out = calls.call_model(df, F.struct("t"), logged(tmp_path / "log"), str(tmp_path / "s"), batch=4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    assert {r.t: r.reply for r in out.collect()} == {f"t{i}": f"T{i}" for i in range(50)}


def test_vectors_have_length_one(spark, tmp_path):
    df = spark.createDataFrame([("abc",), ("",), (None,)], "t string")
    client = lambda: lambda rs: [[3.0 * len(r["text"]), 4.0 * len(r["text"])] for r in rs]
    out = {r.t: r.reply for r in calls.embed(df, F.col("t"), client, str(tmp_path / "s")).collect()}
    assert out["abc"] == pytest.approx([0.6, 0.8]) and out[""] == [0.0, 0.0] and out[None] is None


def test_repair_and_fallback(spark, tmp_path):
    df = spark.createDataFrame([(1, "good", "f1"), (2, "bad", "f2"), (3, "bad bad bad", "f3")], "i int, d string, f string")
    faults = lambda c: F.transform(F.filter(F.split(c, " "), lambda w: w == "bad"), lambda w: F.concat(F.lit("has "), w))
    repair = lambda x: x.withColumn("d", F.expr("regexp_replace(d, '^bad ?', '')"))
    out = {r.i: (r.content, r.method) for r in calls.repaired(df, "i", "d", faults, repair, F.col("f"), F.lit("end"), 2, keeper(spark, tmp_path)).collect()}
    assert out == {1: ("good\n\n---\n\nend", "model"), 2: ("\n\n---\n\nend", "model"), 3: (f"f3\n\n## {calls.FAILED}\n\n- has bad", "fallback")}


def test_a_stopped_grid_goes_on(spark, tmp_path):
    grid = spark.createDataFrame([(u, s, c) for u in range(4) for s in ("a", "b") for c in ("on", None)], "unit int, stage string, cond string")
    schema, ran = "unit int, value string, stage string, cond string", []

    def run(todo, stop=None):
        rows = [tuple(r) for r in todo.select("unit", "stage", "cond").collect()]
        if any(r[1] == stop for r in rows):
            raise RuntimeError("stopped")
        ran.extend(rows)
        return todo.withColumn("value", F.when((F.col("unit") == 3) & F.lit(len(ran) <= 16), "bad").otherwise("ok"))

    args = (grid, ["unit", "stage", "cond"], ["stage", "cond"])
    with pytest.raises(RuntimeError):
        cells.run_grid(*args, lambda t: run(t, "b"), F.col("value") == "ok", str(tmp_path / "g"), schema)
    out = cells.run_grid(*args, run, F.col("value") == "ok", str(tmp_path / "g"), schema, passes=2)
    once = cells.run_grid(*args, run, F.col("value") == "ok", str(tmp_path / "other"), schema, passes=4)
    key = lambda df: sorted(map(repr, df.collect()))
    done = [r for r in ran[:20] if r[0] != 3]
    assert len(done) == len(set(done)) and key(once) == key(cells.run_grid(*args, run, F.col("value") == "ok", str(tmp_path / "g"), schema))
    assert out.count() >= 12 and cells.pending(grid, once, ["unit", "stage", "cond"]).count() == 0
    cells.flat_labels(once.withColumn("parsed", F.struct("unit")), str(tmp_path / "flat"), ["parsed"])
    assert spark.read.parquet(str(tmp_path / "flat/labels.parquet")).columns == ["unit", "value", "stage", "cond"]


def test_whole_passes_until_the_target():
    saved, turns = [], iter([True, False, None, True, True])

    def one():
        x = next(turns)
        if x is None:
            raise OSError
        if x:
            saved.append(1)
        return x

    assert cells.runs_until(lambda: len(saved), one, 2, 9) == (2, 4)
    assert cells.runs_until(lambda: len(saved), one, 9, 1) == (3, 1)

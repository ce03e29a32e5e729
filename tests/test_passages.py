import numpy as np
from pyspark.sql import functions as F

from docloom.operators.clusters import assign, lloyd
from docloom.operators.paired import bootstrap_mean, wilcoxon
from docloom.operators.paired import chi2_tail, with_p_values
from docloom.operators.passages import json_object, line_windows, slice_until, until_boundary
from docloom.operators.sentences import blank_run, excerpt, latin_ratio, normalize_symbols, sentences
from docloom.sources.records import last_of_each, read_csv, read_json_lines, record_counts, remaining, write_csv, write_json_lines


def test_sentences_and_measures(spark):
    df = spark.createDataFrame([("Pi is 3.14. “Yes!” he  said (twice.) v1.2.3 runs",), ("",), (None,), ("?",)], "t string")
    out = [r[0] for r in df.select(sentences(normalize_symbols(F.col("t")))).collect()]
    assert out == [["Pi is 3.14.", '"Yes!"', "he said (twice.)", "v1.2.3 runs"], [], None, ["?"]]
    r = spark.createDataFrame([("a" + " " * 120 + "b é" + " " * 30,)], "t string").select(blank_run(F.col("t")), latin_ratio(F.col("t")), excerpt(F.col("t"), 3)).first()
    assert r[0] == 120 and abs(r[1] - 2 / 3) < 1e-9 and r[2] == "a  …"


def test_line_windows_cover_everything():
    lines = ["x" * (i * 37 % 90) for i in range(60)] + ["y" * 500]
    w = line_windows("\n".join(lines), 200, 3)
    assert {i for a, b in w for i in range(a, b + 1)} == set(range(1, 62))
    assert all(a2 > a and a2 <= b + 1 for (a, b), (a2, _) in zip(w, w[1:], strict=False))
    assert all(a == b or sum(len(x) + 1 for x in lines[a - 1 : b]) <= 200 for a, b in w)
    assert line_windows(None) == line_windows("") == [] and line_windows("a") == [(1, 1)]


def test_until_boundary(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate("..s.x.")] + [(2, 0, "x")] + [(3, i, "s") for i in range(20)], "g int, p int, c string")
    out = until_boundary(df, "g", "p", F.col("c") == "s", F.col("c") == "x")
    assert sorted((r.g, r.p) for r in out.collect()) == [(1, 2), (1, 3)] + [(3, i) for i in range(12)]


def test_slice_until(spark):
    df = spark.createDataFrame([(1, list("..s.x.")), (2, ["x"]), (3, ["s"] * 20), (4, []), (5, None)], "g int, c array<string>")
    first, found = slice_until(F.col("c"), lambda c: c == "s", lambda c: c == "x")
    out = {r.g: r[1:] for r in df.select("g", first, found).collect()}
    assert out[1] == (2, ["s", "."]) and out[2][1] == [] and out[3] == (0, ["s"] * 12) and out[4][1] == [] and not out[5][1]


def test_p_values(spark):
    df = spark.createDataFrame([(3.841459, -1.959964), (0.0, 0.0), (None, None)], "x double, z double")
    assert [round(r.p_value, 5) if r.p_value is not None else None for r in with_p_values(df, statistic="x").collect()] == [0.05, 1.0, None]
    assert [round(r.p_value, 5) if r.p_value is not None else None for r in with_p_values(df, z="z").collect()] == [0.05, 1.0, None]
    assert chi2_tail(0) == 1


def test_json_object(spark):
    df = spark.createDataFrame([('{"a":1}',), ('so {"a":{"b":2}} then',), ("none",), ("bad {x",), (None,)], "t string")
    assert [r[0] for r in df.select(json_object(F.col("t"))).collect()] == ['{"a":1}', '{"a":{"b":2}}', None, None, None]


def test_clusters(spark):
    m = np.random.default_rng(3).normal(size=(30, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id int, v array<double>")
    c = m[:4].copy()
    for _ in range(2):
        at = ((m[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        c = np.stack([m[at == k].mean(0) for k in range(4)])
    want = ((m[:, None] - c[None]) ** 2).sum(-1)
    got = {r.id: (r.cluster, r.d2) for r in lloyd(df, "id", "v", 4, 3).collect()}
    assert all(got[i][0] == want[i].argmin() and abs(got[i][1] - want[i].min()) < 1e-9 for i in range(30))
    assert assign(df.limit(1).select(F.array(F.lit(0.0)).alias("v")), "v", [(1, [1.0]), (2, [-1.0])]).first().cluster == 1


def test_statistics(spark):
    df = spark.createDataFrame([(3, 1), (1, 3), (5, 1), (2, 2), (9, 1)], "a int, b int")
    r = wilcoxon(df, F.col("a"), F.col("b")).first()
    assert (r.n, r.w_plus, r.w_minus) == (4, 8.5, 1.5)
    b = bootstrap_mean(df, F.col("a") - F.col("b")).first()
    assert b.n == 5 and abs(b.mean - 2.4) < 1e-9 and b.low <= b.mean <= b.high
    assert bootstrap_mean(df.limit(0), F.col("a")).first().n == 0


def test_records(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"id": 1, "t": "x", "r": true}\nno json\n{"id": 2, "t": " ", "r": false}\n{"id": 3, "t": null}\n')
    rows = read_json_lines(spark, str(p), "id long, t string, r boolean")
    assert tuple(record_counts(rows, F.col("t"), F.col("r")).first()) == (4, 1, 2, 1, 1)
    assert rows.where("_bad_record is not null").count() == 1
    write_json_lines(rows.where("id is not null"), str(tmp_path / "out"))
    assert read_json_lines(spark, str(tmp_path / "out"), "id long, t string, r boolean").where("_bad_record is null").count() == 3
    df = spark.createDataFrame([(1, 'a "q", \n b'), (2, None)], "id long, t string")
    write_csv(df, str(tmp_path / "csv"))
    assert {r.id: r.t for r in read_csv(spark, str(tmp_path / "csv"), "id long, t string").collect()}[1] == 'a "q", \n b'
    grid = spark.createDataFrame([(1, "a"), (1, None), (2, "a")], "x int, y string")
    assert [tuple(r) for r in remaining(grid, grid.where("x = 1"), ["x", "y"]).collect()] == [(2, "a")]
    assert last_of_each(spark.createDataFrame([(1, 1, "p"), (1, 2, "q")], "k int, o int, v string"), "k", "o").first().v == "q"


def test_no_text_goes_to_python_for_windows(spark):
    from docloom.operators.passages import overlap_windows

    texts = ["\n".join("x" * (7 * k % 23) for k in range(60)), "", None, "a", "\n", "\n\n\n", "é" * 90 + "\nb", "\U0001f600" * 40 + "\n\n" + "c" * 30 + "\r\nd\n", "one.two\\n|\nb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = overlap_windows(docs, "id", "t", 50, 2)
    want = {(i, pos, *w) for i, t in enumerate(texts) for pos, w in enumerate(line_windows(t, 50, 2))}
    assert {tuple(r) for r in found.collect()} == want
    plan = next(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "EvalPython" in x)
    assert "cut(lengths" in plan

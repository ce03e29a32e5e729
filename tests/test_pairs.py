import numpy as np
import pytest

from docloom.operators import pairs, tsne
from docloom.operators.pairs import pair_map as in_whole_blocks

ARGS = ("id", "v", "g")


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(23, 4))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[5] = m[4]  # a tie
    g = [i % 3 for i in range(23)]
    rows = [(i, g[i], m[i].tolist()) for i in range(23)]
    return spark.createDataFrame([*rows, (None, 1, [1.0] * 4), (99, 1, None)], "id long, g long, v array<double>"), m @ m.T, g


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    real = pairs.pair_map
    monkeypatch.setattr(pairs, "pair_map", lambda *a: real(*a, block=5))


def test_extremes(case):
    df, s, _ = case
    want = sorted((-round(s[i, j], 6), i, j) for i in range(23) for j in range(i + 1, 23))
    got = [(-r.similarity, r.id_a, r.id_b) for r in pairs.extreme_pairs(df, *ARGS, top=9).collect()]
    assert [x[1:] for x in got] == [x[1:] for x in want[:9]] and [x[0] for x in got] == pytest.approx([x[0] for x in want[:9]])
    assert len(pairs.extreme_pairs(df, *ARGS, top=500, largest=False).collect()) == len(want)


def test_neighbours(case):
    df, s, _ = case
    want = {(min(i, j), max(i, j)) for i in range(23) for j in sorted(set(range(23)) - {i}, key=lambda j: (-round(s[i, j], 6), j))[:4]}
    assert {(r.id_a, r.id_b) for r in pairs.knn_edges(df, *ARGS).collect()} == want


def test_group_statistics(case):
    df, s, g = case
    inside = [s[i, j] for i in range(23) for j in range(i + 1, 23) if g[i] == g[j] == 1]
    r = {r.grp: r for r in pairs.within_group(df, *ARGS).collect()}[1]
    assert (r.n, r.mean, r.std) == (len(inside), pytest.approx(np.mean(inside), abs=1e-6), pytest.approx(np.std(inside), abs=1e-6))
    h = pairs.pair_histogram(df, *ARGS).collect()
    assert sum(r.intra_count + r.inter_count for r in h) == 23 * 22 // 2


def test_silhouette(case, spark):
    df, s, g = case
    d, g = np.sqrt(np.maximum(0, 2 - 2 * s)), np.array(g)
    np.fill_diagonal(d, 0)
    score = []
    for i in range(23):
        a = d[i, g == g[i]].sum() / ((g == g[i]).sum() - 1)
        b = min(d[i, g == k].mean() for k in set(g.tolist()) - {g[i]})
        score.append((b - a) / max(a, b))
    r = pairs.silhouette(df.where("id is not null and v is not null"), *ARGS).first()
    assert (r.n, r.silhouette) == (23, pytest.approx(np.mean(score), abs=1e-6))
    assert pairs.silhouette(df.limit(0), *ARGS).first().n == 0 and pairs.pair_histogram(df.limit(0), *ARGS).count() == 0


@pytest.mark.parametrize("report", [pairs.extreme_pairs, pairs.knn_edges, pairs.pair_histogram, pairs.within_group, pairs.silhouette])
def test_blocks_are_not_shuffled_to_each_other(case, report):
    # a join of all blocks with all others shuffles every vector once a block; silhouette joins sizes of groups only
    df = case[0].where("id is not null and v is not null")
    plan = report(df, *ARGS)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "Join Inner, ((lo" not in plan


def test_neighbours_come_once_a_row(case, monkeypatch):
    # no row returns neighbours from each block it meets
    df, _, _ = case
    seen, real = [], pairs.pair_map
    monkeypatch.setattr(pairs, "pair_map", lambda *a: seen.append(real(*a)) or seen[-1])
    pairs.knn_edges(df, *ARGS)
    assert seen[0].count() == 23 * 4


def test_copies_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TILE", 3)
    monkeypatch.setattr(pairs, "WIDE", 4)
    rng = np.random.default_rng(5)
    m = np.repeat(rng.normal(size=(4, 3)), [30, 9, 1, 1], axis=0)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    n = len(m)
    df = spark.createDataFrame([(i, i % 2, m[i].tolist()) for i in rng.permutation(n).tolist()], "id long, g long, v array<double>")
    s = np.round(m @ m.T, 6) + 0.0
    want = sorted((-s[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    assert [(r.id_a, r.id_b) for r in pairs.extreme_pairs(df, *ARGS, top=40).collect()] == [x[1:] for x in want[:40]]
    least = sorted((s[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    assert [(r.id_a, r.id_b) for r in pairs.extreme_pairs(df, *ARGS, top=40, largest=False).collect()] == [x[1:] for x in least[:40]]
    edges = {(min(i, j), max(i, j)) for i in range(n) for j in sorted(set(range(n)) - {i}, key=lambda j: (-s[i, j], j))[:4]}
    assert {(r.id_a, r.id_b) for r in pairs.knn_edges(df, *ARGS).collect()} == edges
    assert sum(r.intra_count + r.inter_count for r in pairs.pair_histogram(df, *ARGS).collect()) == n * (n - 1) // 2


def test_many_groups_return_in_parts(case, monkeypatch):
    df = case[0].where("id is not null and v is not null")
    whole = pairs.silhouette(df, *ARGS).first()
    monkeypatch.setattr(pairs, "CELLS", 1)
    assert pairs.silhouette(df, *ARGS).first() == whole


def test_equal_vectors_are_equally_near(spark):
    # nearness of a copy must not depend on where it stands in a tile: ids decide
    rng = np.random.default_rng(3)
    m = rng.normal(size=(40, 37)) * rng.uniform(0.1, 3, size=(40, 1))
    m = np.concatenate([m] * 30 + [m[:7]])
    n = len(m)
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(n)], "id long, v array<double>")
    distance = ((m[:40, None] - m[None, :40]) ** 2).sum(axis=2)
    np.fill_diagonal(distance, 0)
    got = {}
    for r in tsne.neighbours(df, "id", "v", 35).collect():
        got.setdefault(r.i, []).append((r.d2, r.j))
    for i in range(n):
        want = sorted((distance[i % 40, j % 40], j) for j in range(n) if j != i)[:35]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]


def test_blocks_are_large(spark):
    # every block is read once a block, so their number must not grow with the rows before memory asks for it
    df = spark.range(40000).selectExpr("id", "id % 3 AS g", "array(cos(id), sin(id)) AS v")
    found = in_whole_blocks(df, *ARGS, lambda ids, groups: pairs._Extremes(ids, groups, 5, 1), "id_a long, id_b long, similarity double")
    assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism


def test_keys_that_32_bits_cannot_tell(spark):
    # near ties, a length that overflows 32 bits and one that underflows
    rng = np.random.default_rng(2)
    m = np.concatenate([1 + 1e-9 * rng.normal(size=(60, 5)), 1e30 * rng.normal(size=(5, 5)), 1e-30 * rng.normal(size=(5, 5))])
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(len(m))], "id long, v array<double>")
    got = {}
    for r in tsne.neighbours(df, "id", "v", 4).collect():
        got.setdefault(r.i, []).append((r.d2, r.j))
    for i in range(len(m)):
        want = sorted((float(((m[i] - m[j]) ** 2).sum()), j) for j in range(len(m)) if j != i)[:4]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]


def test_sums_by_groups_are_returned_in_parts(monkeypatch):
    monkeypatch.setattr(pairs, "RETURNED", 10)
    rng = np.random.default_rng(1)
    ids, groups, v = np.arange(50), np.array([[str(i % 4)] for i in range(50)], dtype=object), rng.normal(size=(50, 3))
    kept = pairs._Distances(ids, groups)
    list(kept.meet(v, v, ids, groups, lambda at, to: None))
    tables = list(kept.rows())
    assert max(map(len, tables)) <= 10 and sum(map(len, tables)) == 200


def test_sums_of_rows_are_not_broadcast(case):
    # rows times groups of them would pass through the driver; the sizes of groups are the small side
    df = case[0].where("id is not null and v is not null")
    plan = pairs.silhouettes(df.withColumn("h", df.id % 2), "id", "v", ["g", "h"])._jdf.queryExecution().sparkPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_sums_of_rows_are_shuffled_once(case):
    # by row alone: what is then summed up by group and by row stays where it is; the other shuffles are of the sizes of groups and of the results
    df = case[0].where("id is not null and v is not null")
    plan = pairs.silhouettes(df.withColumn("h", df.id % 2), "id", "v", ["g", "h"])._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(k#" in line and "id#" in line for line in plan.splitlines()) == 1

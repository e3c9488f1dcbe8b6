"""Graph operators on random graphs against plain Python, also with tasks so small that graphs are cut into cells."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelweave.functions import metrics
from levelweave.operators import cells, graphs, grouping, levels, schedule, solve, symbolic, trees
from levelweave.operators.hierarchy import hierarchy

E, V = "graph_id long, src long, dst long", "graph_id long, node long"


def dag(seed, n=40, m=70, g=1):
    rnd = random.Random(seed)
    edges = {tuple(sorted(rnd.sample(range(n), 2))) for _ in range(m)}
    return [(g, a, b) for a, b in edges], [(g, v) for v in range(n)]


@pytest.fixture(scope="module")
def two(spark):
    a, b = dag(1), dag(2, 25, 30, g=2)
    e, v = a[0] + b[0], a[1] + b[1]
    return e, v, spark.createDataFrame(e, E), spark.createDataFrame(v, V)


def python_levels(e, v):
    lev = {x: 0 for x in v}
    for g, a, b in sorted(e, key=lambda x: x[2]):
        lev[g, b] = max(lev[g, b], lev[g, a] + 1)
    return lev


def python_components(e, v):
    up = {x: x for x in v}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for g, a, b in e:
        x, y = find((g, a)), find((g, b))
        up[max(x, y)] = min(x, y)
    return {x: find(x)[1] for x in v}


@pytest.mark.parametrize("most", [10**6, 12])
def test_levels_and_components(two, most):
    e, v, ed, vd = two
    got = {(r["graph_id"], r["node"]): r["level"] for r in levels.level_sets(ed, vd, max_task_rows=most).collect()}
    assert got == python_levels(e, v)
    got = {(r["graph_id"], r["node"]): r["component"] for r in cells.components(ed, vd, max_task_rows=most).collect()}
    assert got == python_components(e, v)


def test_hand_worked_levels(spark):
    chain = [(1, i, i + 1) for i in range(5)]
    diamond = [(2, 0, 1), (2, 0, 2), (2, 1, 3), (2, 2, 3)]
    star = [(3, 0, k) for k in range(1, 5)]
    clique = [(4, a, b) for a in range(4) for b in range(a + 1, 4)]
    e = chain + diamond + star + clique
    v = sorted({(g, x) for g, a, b in e for x in (a, b)} | {(5, 0)})
    got = {}
    for r in levels.histogram(levels.level_sets(spark.createDataFrame(e, E), spark.createDataFrame(v, V))).collect():
        got.setdefault(r["graph_id"], {})[r["level"]] = r["width"]
    assert got == {1: {k: 1 for k in range(6)}, 2: {0: 1, 1: 2, 2: 1}, 3: {0: 1, 1: 4}, 4: {k: 1 for k in range(4)}, 5: {0: 1}}
    reduced = graphs.two_hop_reduction(spark.createDataFrame(clique, E)).collect()
    assert sorted((r["src"], r["dst"]) for r in reduced) == [(0, 1), (1, 2), (2, 3)]
    one = grouping.supernodes(spark.createDataFrame(clique, E), spark.createDataFrame([(4, k) for k in range(4)], V))
    assert {r["group"] for r in one.collect()} == {0}


@pytest.mark.parametrize("most", [10**6, 15])
def test_solve(spark, most):
    rnd = random.Random(5)
    e, v = dag(5, 30, 60)
    dense = np.diag([rnd.uniform(1, 3) for _ in range(30)])
    for _, a, b in e:
        dense[b, a] = rnd.uniform(-1, 1)
    rows = [(1, i, j, float(dense[i, j])) for i in range(30) for j in range(30) if dense[i, j]]
    b = np.array([rnd.random() for _ in range(30)])
    m = spark.createDataFrame(rows, "graph_id long, row long, col long, val double")
    x = solve.solve_lower(m, spark.createDataFrame([(1, i, float(b[i])) for i in range(30)], "graph_id long, node long, b double"), max_task_rows=most)
    want = np.linalg.solve(dense, b)
    for r in x.collect():
        assert r["value"] == pytest.approx(want[r["node"]], abs=1e-8)
    for r in solve.product(m, x).collect():
        assert r["value"] == pytest.approx(b[r["node"]], abs=1e-8)


def spd(seed, n=18):
    rnd = np.random.default_rng(seed)
    a = np.where(rnd.random((n, n)) < 0.15, rnd.normal(size=(n, n)), 0)
    return np.tril(a + a.T, -1) + np.diag([12.0] * n)


def test_incomplete_cholesky(spark):
    low = spd(1)
    n = len(low)
    rows = [(1, i, j, float(low[i, j])) for i in range(n) for j in range(i + 1) if low[i, j]]
    m = spark.createDataFrame(rows, "graph_id long, row long, col long, val double")
    got = np.zeros((n, n))
    for r in solve.incomplete_cholesky(m, spark.createDataFrame([(1, i) for i in range(n)], V)).collect():
        got[r["row"], r["col"]] = r["val"]
    product = got @ got.T
    assert ((got != 0) == (low != 0)).all()
    for i in range(n):
        for j in range(i + 1):
            if low[i, j]:
                assert product[i, j] == pytest.approx(low[i, j], abs=1e-6)


def test_elimination_tree_and_factor(spark):
    low = spd(2, 25)
    n = len(low)
    full = np.linalg.cholesky(low + np.tril(low, -1).T)
    pattern = np.abs(np.tril(full, -1)) > 1e-14
    e = spark.createDataFrame([(1, j, i) for i in range(n) for j in range(i) if low[i, j]], E)
    v = spark.createDataFrame([(1, i) for i in range(n)], V)
    tree = trees.elimination_tree(e, v)
    for r in tree.collect():
        below = np.flatnonzero(pattern[:, r["node"]])
        assert r["parent"] == (int(below[0]) if len(below) else None)
    whole = hierarchy(tree, order=None)
    rows = trees.row_patterns(e, whole)
    assert {(r["row"], r["col"]) for r in rows.collect()} == set(zip(*map(list, np.nonzero(pattern))))
    counts = trees.column_counts(rows, v)
    assert {r["node"]: r["count"] for r in counts.collect()} == {j: int(pattern[:, j].sum()) + 1 for j in range(n)}
    total = trees.flops(counts).first()
    assert total["nnz"] == int(pattern.sum()) + n
    order = trees.post_order(whole)
    place = {r["node"]: r["post"] for r in order.collect()}
    assert sorted(place.values()) == list(range(n))
    moved = {(r["node"], r["parent"]) for r in trees.relabelled(whole, order).collect()}
    assert all(p is None or p > c for c, p in moved)


@pytest.mark.parametrize("seed", range(3))
def test_schedules_are_valid_and_mutations_are_found(spark, seed):
    e, v = dag(seed + 20, 60, 90)
    ed, vd = spark.createDataFrame(e, E), spark.createDataFrame(v, V)
    cost = spark.createDataFrame([(1, k, float(1 + k % 5)) for _, k in v], "graph_id long, node long, cost double")
    lev = levels.level_sets(ed, vd)
    for s in (schedule.coarsened(ed, lev, cost, bins=3, first=2, every=2), schedule.hybrid(ed, lev, cost, cores=3), schedule.hybrid(ed, lev, cost, cores=3, max_task_rows=10)):
        s = s.cache()
        assert schedule.violations(s, ed, vd).count() == 0
        assert s.agg(F.max("part")).first()[0] < 3
        moved = s.withColumn("level", F.when(F.col("node") == e[0][1], F.col("level") + 1000).otherwise(F.col("level")))
        assert schedule.violations(moved, ed, vd).filter("kind = 'order'").count() > 0
        assert schedule.violations(s.filter("node <> 3"), ed, vd).filter("kind = 'cover'").count() == 1
        m = metrics.schedule_metrics(metrics.part_costs(s, cost), 3).first()
        assert m["cost"] == sum(1 + k % 5 for _, k in v) and m["critical_path"] <= m["cost"]


@pytest.mark.parametrize("seed", range(2))
def test_hybrid_is_the_same_at_every_bound(spark, seed):
    e, v = dag(seed + 40, 80, 130)
    ed, vd = spark.createDataFrame(e, E), spark.createDataFrame(v, V)
    cost = spark.createDataFrame([(1, k, float(1 + k % 5)) for _, k in v], "graph_id long, node long, cost double")
    lev = levels.level_sets(ed, vd)
    whole, ranged = (sorted(map(tuple, schedule.hybrid(ed, lev, cost, cores=3, max_task_rows=n).collect())) for n in (500_000, 25))
    assert whole == ranged and len(whole) == 80


@pytest.mark.parametrize("seed", range(2))
def test_elimination_tree_in_ranges(spark, seed):
    e, v = dag(seed + 60, 70, 110)
    ed, vd = spark.createDataFrame(e, E), spark.createDataFrame(v, V)
    whole, ranged = (sorted(map(tuple, trees.elimination_tree(ed, vd, max_task_rows=n).collect())) for n in (400_000, 30))
    assert whole == ranged and len(whole) == 70


def test_scheduled_solve_follows_the_schedule(spark):
    e, v = dag(50, 40, 70)
    ed, vd = spark.createDataFrame(e, E), spark.createDataFrame(v, V)
    m = spark.createDataFrame([(1, d, s, -1.0) for _, s, d in e] + [(1, k, k, 2.0) for _, k in v], "graph_id long, row long, col long, val double")
    b = vd.withColumn("b", F.col("node") % 7)
    plan = schedule.coarsened(ed, levels.level_sets(ed, vd), bins=3, first=2, every=2).cache()
    want = {r["node"]: r["value"] for r in solve.solve_lower(m, b).collect()}
    for bound in (400_000, 30):
        got = {r["node"]: r["value"] for r in solve.solve_scheduled(m, b, plan, max_task_rows=bound).collect()}
        assert got == pytest.approx(want)
    early = plan.withColumn("level", F.when(F.col("node") == e[0][2], -1).otherwise(F.col("level")))
    assert [r["node"] for r in solve.solve_scheduled(m, b, early).filter("value is null").collect()] == [e[0][2]]


def test_worst_fit(spark):
    rnd = random.Random(8)
    costs = [float(rnd.randrange(1, 9)) for _ in range(40)]
    parts = spark.createDataFrame([(1, 0, k, c) for k, c in enumerate(costs)], "graph_id long, window int, component long, cost double")
    got = {r["component"]: r["bin"] for r in schedule.worst_fit(parts, 4).collect()}
    loads, want = [0.0] * 4, {}
    for k in sorted(range(40), key=lambda k: (-costs[k], k)):
        want[k] = loads.index(min(loads))
        loads[want[k]] += costs[k]
    assert got == want
    bundled = schedule.worst_fit(parts, 4, most=8).collect()
    assert {r["component"] for r in bundled} == set(range(40))


def test_merges(spark, two):
    _, _, ed, vd = two
    tied = ed.limit(3)
    assert graphs.merged_with(ed, tied, ed, vd).count() == 2 * ed.count() + 3


def test_padded_blocks(spark):
    e = [(1, 0, 1), (1, 0, 2), (1, 1, 2)]
    groups = grouping.supernodes(spark.createDataFrame(e, E), spark.createDataFrame([(1, k) for k in range(3)], V))
    m = spark.createDataFrame([(1, i, j, float(i + j + 1)) for i in range(3) for j in range(i + 1)], "graph_id long, row long, col long, val double")
    blocks = grouping.padded_blocks(m, groups)
    assert {tuple(r) for r in grouping.unpadded(blocks).collect()} == {tuple(r) for r in m.collect()}


def test_symbolic_sizes_against_elimination(spark):
    """Column counts, row costs and the relabelled tree, against eliminating column by column."""
    rows, ids = [], []
    for g, n, m in ((1, 30, 60), (2, 25, 20), (3, 1, 0), (4, 20, 150)):
        e, v = dag(g, n, m, g) if m else ([], [(g, 0)])
        rows, ids = rows + e, ids + v
    ed, vd = spark.createDataFrame(rows, E), spark.createDataFrame(ids, V)
    below = {x: {b for g, a, b in rows if (g, a) == x} for x in ids}
    orig = {x: len(s) + 1 for x, s in below.items()}
    for g, v in sorted(ids):
        if below[g, v]:
            first = min(below[g, v])
            below[g, first] |= below[g, v] - {first}
    tree = symbolic.factor_tree(ed, vd)
    counts = {(r["graph_id"], r["node"]): r["count"] for r in symbolic.column_counts(ed, tree).collect()}
    assert counts == {x: len(s) + 1 for x, s in below.items()}
    weights = spark.createDataFrame([(*x, k) for x, k in orig.items()], "graph_id long, node long, weight long")
    got = {(r["graph_id"], r["node"]): r["cost"] for r in symbolic.reach_costs(ed, tree, weights).collect()}
    assert got == {(g, i): orig[g, i] + sum(orig[g, j] for (h, j), s in below.items() if h == g and i in s) for g, i in ids}
    named = symbolic.symbolic_factor(ed, vd).collect()
    new = {(r["graph_id"], r["old"]): r["node"] for r in named}
    assert all(r["count"] == counts[r["graph_id"], r["old"]] for r in named)
    assert all(r["parent"] == (new[r["graph_id"], min(s)] if (s := below[r["graph_id"], r["old"]]) else None) for r in named)
    for g in (1, 2, 3, 4):
        assert sorted(v for (h, _), v in new.items() if h == g) == list(range(sum(h == g for h, _ in ids)))
    assert all(r["parent"] is None or r["parent"] > r["node"] for r in named)


def test_symbolic_of_empty_graph(spark):
    ed, vd = spark.createDataFrame([], E), spark.createDataFrame([], V)
    assert symbolic.symbolic_factor(ed, vd).collect() == []


def test_incomplete_cholesky_by_ranges(spark):
    e, v = dag(11, 40, 90)
    degree = {x: sum(x in (a, b) for _, a, b in e) for _, x in v}
    low = [(1, b, a, -1.0) for _, a, b in e] + [(1, x, x, 1.0 + degree[x]) for x in degree]
    m = spark.createDataFrame(low, "graph_id long, row long, col long, val double")
    vd = spark.createDataFrame(v, V)
    key = lambda df: {(r["row"], r["col"]): round(r["val"], 9) for r in df.collect()}
    whole = solve.incomplete_cholesky(m, vd)
    assert key(whole) == key(solve.incomplete_cholesky(m, vd, max_task_rows=15))
    back = {(r["row"], r["col"]): r["val"] for r in solve.factor_product(whole).collect()}
    assert back == pytest.approx({(r, c): x for _, r, c, x in low})

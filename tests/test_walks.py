import random

from levelweave.operators import schedule, walks
from levelweave.sql import register

E, V = "graph_id long, src long, dst long", "graph_id long, node long"


def make(spark, seed=1, n=50, m=70):
    rnd = random.Random(seed)
    e = sorted({tuple(sorted(rnd.sample(range(n), 2))) for _ in range(m)})
    return e, spark.createDataFrame([(1, *x) for x in e], E), spark.createDataFrame([(1, k) for k in range(n)], V)


def test_depth_first_order_is_topological(spark):
    e, ed, vd = make(spark)
    got = {r["node"]: (r["component"], r["pos"]) for r in walks.depth_first_order(ed, vd).collect()}
    assert len(got) == 50
    assert all(got[a][0] == got[b][0] and got[a][1] < got[b][1] for a, b in e)


def test_depth_first_by_hand(spark):
    ed = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 1, 3)], E)
    order = walks.depth_first_order(ed, spark.createDataFrame([(1, k) for k in range(4)], V)).orderBy("pos").collect()
    assert [r["node"] for r in order] == [0, 1, 3, 2]


def test_capped_trees(spark):
    e, ed, vd = make(spark, 2, 60, 55)
    succ = {}
    for a, b in e:
        succ.setdefault(a, []).append(b)
    for wide in (False, True):
        group = {r["node"]: r["group"] for r in walks.capped_trees(ed, vd, 4, wide).collect()}
        assert len(group) == 60
        sizes = {}
        for v, g in group.items():
            sizes[g] = sizes.get(g, 0) + 1
            assert v == g or (len(succ[v]) == 1 and group[succ[v][0]] == g)
        assert max(sizes.values()) <= 4
    chain = spark.createDataFrame([(1, k, k + 1) for k in range(5)], E)
    got = walks.capped_trees(chain, spark.createDataFrame([(1, k) for k in range(6)], V), 3).collect()
    assert {r["node"]: r["group"] for r in got} == {5: 5, 4: 5, 3: 5, 2: 2, 1: 2, 0: 2}


def test_runs_and_parts(spark):
    _, ed, vd = make(spark, 3)
    runs = {r["node"]: r["group"] for r in walks.greedy_runs(ed, vd, 8).collect()}
    assert len(runs) == 50 and all(g <= v for v, g in runs.items())
    parts = walks.breadth_first_parts(ed, vd, 5.0).collect()
    held = {}
    for r in parts:
        held[r["component"], r["part"]] = held.get((r["component"], r["part"]), 0) + 1
    assert len(parts) == 50 and max(held.values()) <= 5


def python_capped(e, n, most, wide):
    """The rule on the whole graph at once."""
    succ, pred, group = {v: [] for v in range(n)}, {v: [] for v in range(n)}, {}
    for a, b in e:
        succ[a].append(b)
        pred[b].append(a)
    for top in reversed(range(n)):
        if top in group:
            continue
        group[top], size, queue, closed = top, 1, [top], False
        while queue and not closed:
            v = queue.pop(0 if wide else -1)
            for u in pred[v]:
                if u in group:
                    continue
                if len(succ[u]) > 1:
                    closed = closed or wide
                elif size < most:
                    group[u], size = top, size + 1
                    queue.append(u)
    return group


def python_runs(e, n, window):
    succ, group = {v: sorted(b for a, b in e if a == v) for v in range(n)}, {}
    for head in range(n):
        if head in group:
            continue
        group[head], last, pending = head, head, set(succ[head][:window])
        while last + 1 in pending:
            last += 1
            group[last] = head
            pending = set(sorted((pending | set(succ[last])) - {last})[:window])
    return group


def test_units_give_what_the_whole_graph_gives(spark):
    for seed, n, m in ((5, 60, 55), (6, 60, 90), (7, 40, 300)):
        e, ed, vd = make(spark, seed, n, m)
        for wide in (False, True):
            assert {r["node"]: r["group"] for r in walks.capped_trees(ed, vd, 4, wide).collect()} == python_capped(e, n, 4, wide)
        for window in (1, 3, 50):
            for most in (10**6, 7):
                assert {r["node"]: r["group"] for r in walks.greedy_runs(ed, vd, window, max_task_rows=most).collect()} == python_runs(e, n, window)


def test_walks_of_empty_graphs(spark):
    ed, vd = spark.createDataFrame([], E), spark.createDataFrame([], V)
    assert walks.capped_trees(ed, vd, 4).collect() == [] and walks.greedy_runs(ed, vd, 4).collect() == []


def test_split_and_bundles(spark):
    items = spark.createDataFrame([(1, k, float(1 + k % 3)) for k in range(90)], "graph_id long, pos long, weight double")
    parts = {r["pos"]: r["part"] for r in schedule.partition_by_weight(items, 4).collect()}
    loads = [sum(1 + k % 3 for k in range(90) if parts[k] == p) for p in range(4)]
    assert sum(loads) == 180 and max(loads) - min(loads) <= 6 and all(parts[k] <= parts[k + 1] for k in range(89))
    bundles = {r["pos"]: r["bundle"] for r in schedule.bundles(items, 10.0).collect()}
    assert all(bundles[k] <= bundles[k + 1] for k in range(89)) and len(set(bundles.values())) == 18


def test_root_end_cuts():
    assert schedule._root_end_cuts([9, 9, 8, 5, 3, 1], 4, 1, 2) == [(0, 3, 4), (3, 4, 2), (4, 6, 1)]


def test_sql_function(spark):
    register(spark)
    spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 0, 2), (2, 4, 7)], E).createOrReplaceTempView("some_edges")
    got = spark.sql("SELECT * FROM level_sets(TABLE(SELECT graph_id, src, dst FROM some_edges) PARTITION BY graph_id ORDER BY dst)").collect()
    assert {tuple(r) for r in got} == {(1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 4, 0), (2, 7, 1)}

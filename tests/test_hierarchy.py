import random

import pytest
from pyspark.sql import functions as F

from levelweave.operators.hierarchy import cycles, descendants, figures, forest_components, hierarchy, walk

SCHEMA = "graph_id long, node long, parent long, loaded_at long"


def brute(rows):
    """Fault, root, depth and path by following each link."""
    latest = {}
    for g, v, p, t in rows:
        if v is not None:
            key = (t is not None, t or 0, p is not None and p != -1, p or 0)
            if (g, v) not in latest or key > latest[g, v][0]:
                latest[g, v] = (key, None if p == -1 else p)
    up = {k: p for k, (_, p) in latest.items()}
    out = {}
    for g, v in up:
        path, seen = [v], {v}
        while True:
            p = up[g, path[-1]]
            if p is None:
                out[g, v] = (None, path[-1], len(path) - 1, path[::-1])
            elif (g, p) not in up:
                out[g, v] = ("orphan", None, None, None)
            elif p in seen:
                out[g, v] = ("cycle" if p == v else "under_cycle", None, None, None)
                if p != v:
                    on = path[path.index(p) :]
                    if v in on:
                        out[g, v] = ("cycle", None, None, None)
            else:
                path.append(p)
                seen.add(p)
                continue
            break
    return out


def united(up):
    """Least node of the connected component of each node."""
    label = {k: k[1] for k in up}
    moved = True
    while moved:
        moved = False
        for (g, v), p in up.items():
            if (g, p) in label and label[g, v] != label[g, p]:
                label[g, v] = label[g, p] = min(label[g, v], label[g, p])
                moved = True
    return label


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["graph_id"], r["node"]): r for r in hierarchy(df, **how).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    component = united({k: r["parent"] for k, r in got.items()})
    for k, (fault, root, depth, path) in want.items():
        r = got[k]
        assert (r["fault"], r["root"], r["depth"]) == (fault, root, depth), (k, r, want[k])
        assert r["component"] == component[k]
        if fault is None:
            assert r["path"] == path


def random_forest(seed, graphs=4, n=60):
    rnd = random.Random(seed)
    rows = []
    for g in range(graphs):
        names = rnd.sample(range(3 * n), n)
        for i, v in enumerate(names):
            kind = rnd.random()
            p = None if i == 0 or kind < 0.05 else -1 if kind < 0.08 else 10_000 if kind < 0.1 else rnd.choice(names) if kind < 0.2 else names[rnd.randrange(i)]
            rows.append((g, v, p, rnd.randrange(3)))
            if rnd.random() < 0.1:
                rows.append((g, v, p, 5))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_following_links(spark, seed):
    check(spark, random_forest(seed))


@pytest.mark.parametrize("seed", range(3))
def test_cut_into_cells(spark, seed, monkeypatch):
    """Graphs too large for a task: cells of one or two nodes, solved by pointer jumping between them."""
    import levelweave.operators.hierarchy as h

    monkeypatch.setattr(h, "BLOCK", 2)
    check(spark, random_forest(10 + seed, graphs=2, n=40), max_task_rows=6)


def test_long_chain_and_long_cycle_in_cells(spark, monkeypatch):
    import levelweave.operators.hierarchy as h

    monkeypatch.setattr(h, "BLOCK", 8)
    chain = [(1, v, v - 1 if v else None, 0) for v in range(200)]
    ring = [(2, v, (v + 1) % 100, 0) for v in range(100)] + [(2, 100 + v, v, 0) for v in range(50)]
    check(spark, chain + ring, max_task_rows=40)


def test_cases(spark):
    rows = [
        (1, 5, 5, 0),  # its own parent
        (1, 6, 5, 0),
        (1, 1, None, 0),
        (1, 2, 1, 0),
        (1, 2, 9, 1),  # a later row of the same node counts
        (1, None, 1, 0),  # names no node
        (None, 1, None, 0),  # a null graph is a graph
        (None, 2, 1, None),
        (2, 7, -1, 0),
        (2, 8, 7, 0),
        (2, 8, 7, 0),
    ]
    check(spark, rows)


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hierarchy(empty).count() == 0
    clash = spark.createDataFrame([(1, 1, None, 0), (1, 2, 1, 0)], SCHEMA)
    for name in ("root", "depth", "path", "fault", "top", "g", "o", "m", "state", "cells", "cell"):
        clash = clash.withColumn(name, F.lit("x"))
    got = {r["node"]: (r["root"], r["depth"], r["path"]) for r in hierarchy(clash).collect()}
    assert got == {1: (1, 0, [1]), 2: (1, 1, [1, 2])}


def test_descendants(spark):
    df = spark.createDataFrame([(1, 0, None, 0), (1, 1, 0, 0), (1, 2, 0, 0), (1, 3, 1, 0)], SCHEMA)
    tree = hierarchy(df)
    pairs = {(r["ancestor"], r["descendant"], r["distance"]) for r in descendants(tree).collect()}
    assert pairs == {(0, 1, 1), (0, 2, 1), (1, 3, 1), (0, 3, 2)}
    counts = {r["node"]: (r["descendants"], r["height"]) for r in figures(tree).collect()}
    assert counts == {0: (3, 2), 1: (1, 1), 2: (0, 0), 3: (0, 0)}


def brute_figures(up, cost, rank):
    below = {v: [] for v in up}
    for v, p in up.items():
        if p is not None:
            below[p].append(v)
    out = {}

    def visit(v, at):
        size, height, total = 1, 0, cost[v]
        for c in sorted(below[v], key=lambda c: (rank[c], c)):
            at, (s, h, t) = visit(c, at)
            size, height, total = size + s, max(height, h + 1), total + t
        out[v] = (size - 1, height, total, at)
        return at + 1, (size, height, total)

    for v in up:
        if up[v] is None:
            visit(v, 0)
    return out


@pytest.mark.parametrize("bound", [500_000, 5])
def test_figures_in_a_task_and_by_doubling(spark, bound):
    rnd = random.Random(bound)
    rows = []
    for g in (1, 2, None):
        names = rnd.sample(range(200), 60)
        rows += [(g, v, None if i % 20 == 0 else names[rnd.randrange(i - i % 20, i)], 0) for i, v in enumerate(names)]
    rows += [(4, v, v + 1 if v < 40 else None, 0) for v in range(41)] + [(5, 1, 1, 0), (6, 1, 99, 0)]
    tree = hierarchy(spark.createDataFrame(rows, SCHEMA), max_task_rows=bound)
    tree = tree.withColumn("c", F.col("node") % 5).withColumn("r", F.col("node") % 3)
    got = {(r["graph_id"], r["node"]): (r["descendants"], r["height"], r["cost"], r["place"]) for r in figures(tree, cost="c", rank="r", max_task_rows=bound).collect()}
    want = {}
    for g in (1, 2, None, 4):
        up = {v: p for h, v, p, _ in rows if h == g}
        want |= {(g, v): x for v, x in brute_figures(up, {v: v % 5 for v in up}, {v: v % 3 for v in up}).items()}
    assert got == want


def test_a_chain_of_a_million(spark):
    """Linear work: neither a path nor a pair of nodes is made."""
    n = 1_000_000
    chain = spark.range(n).select(F.lit(1).cast("long").alias("graph_id"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(0).alias("loaded_at"))
    tree = hierarchy(chain, paths=False)
    odd = figures(tree, max_task_rows=2 * n).filter(f"descendants <> {n} - 1 - node or height <> {n} - 1 - node or place <> {n} - 1 - node")
    assert odd.count() == 0 and tree.filter("depth = node and component = 0").count() == n


@pytest.mark.parametrize("bound", [500_000, 6])
def test_cycles(spark, bound):
    rows = [(1, v, (v + 1) % 9, 0) for v in range(9)] + [(1, 20 + v, v, 0) for v in range(9)] + [(1, 50, 50, 0), (2, 3, 4, 0), (2, 4, 3, 0), (2, 5, None, 0), (None, 1, 1, 0)]
    got = {tuple(r) for r in cycles(hierarchy(spark.createDataFrame(rows, SCHEMA), paths=False, max_task_rows=bound)).collect()}
    assert got == {(1, 0, v, (v + 1) % 9, 9) for v in range(9)} | {(1, 50, 50, 50, 1), (2, 3, 3, 4, 2), (2, 3, 4, 3, 2), (None, 1, 1, 1, 1)}


def test_components_of_positions():
    import numpy as np

    assert forest_components(np.array([-1, 0, 1, 4, 3, 3, -1])).tolist() == [0, 0, 0, 3, 3, 3, 6]
    assert forest_components(np.array([], dtype=int)).tolist() == []


def test_walk():
    state, top, depth = walk([-1, 0, 1, 3, 3, 6, 5])
    assert (state, top, depth) == ([0, 0, 0, 1, 2, 1, 1], [0, 0, 0, 3, 3, 5, 6], [0, 1, 2, 0, 1, 0, 0])

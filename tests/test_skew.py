import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from levelweave.operators.columns import column_results, matrix_results, pointer_counts
from levelweave.plans.skew import heavy_keys, skew_aggregate, skew_join

M = "graph_id long, row long, col long, val double"


def hot_matrix(n=4000):
    rnd = random.Random(3)
    rows = [(1, rnd.randrange(10**6), 7 if i % 3 else rnd.randrange(50), float(i % 11)) for i in range(n)]
    return rows + rows[:100] + [(2, 1, 1, None), (2, 2, 1, float("nan")), (None, 1, 1, 2.0), (3, 5, None, 1.0)]


@pytest.mark.parametrize("share", [0.0005, 0.9])
def test_aggregate_against_brute_force(spark, share):
    rows = hot_matrix()
    df = spark.createDataFrame(rows, M)
    got = {(r["graph_id"], r["col"]): (r["entries"], r["values"], r["sum_val"]) for r in skew_aggregate(df, ["graph_id", "col"], ["row"], "val", share=share).collect()}
    once = defaultdict(dict)
    for g, r, c, v in rows:
        old = once[g, c].get(r)
        once[g, c][r] = v if old is None else max(old, v)
    assert set(got) == set(once)
    for k, cells in once.items():
        good = [v for v in cells.values() if v is not None and v == v]
        assert got[k][:2] == (len(cells), len(good))
        assert got[k][2] == (pytest.approx(sum(good)) if good else None)


def test_heavy_keys(spark):
    df = spark.createDataFrame(hot_matrix(), M)
    heavy = {(r["graph_id"], r["col"]) for r in heavy_keys(df, ["graph_id", "col"], 0.2, 1.0).collect()}
    assert heavy == {(1, 7)}
    assert heavy_keys(df.limit(0), ["col"]).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("limit", [10**6, 3, 0])
def test_join_is_the_join(spark, how, limit):
    """Broadcast, heavy keys broadcast, heavy keys salted: always what a plain join gives."""
    rnd = random.Random(4)
    left = spark.createDataFrame([(rnd.choice([1] * 6 + list(range(9)) + [None]), i) for i in range(2000)], "k int, a int")
    right = spark.createDataFrame([(k % 7, k) for k in range(12)] + [(None, 99)], "k int, b int")
    if how in ("inner", "left"):
        right = right.dropDuplicates(["k"]) if limit == 0 else right
    want = sorted(map(tuple, left.join(right, ["k"], how).collect()), key=repr)
    got = sorted(map(tuple, skew_join(left, right, ["k"], how, share=0.1, rows=limit, rows_per_salt=40).collect()), key=repr)
    assert got == want


def test_unknown_join(spark):
    with pytest.raises(ValueError):
        skew_join(spark.range(1), spark.range(1), ["id"], "full")


def test_columns_and_matrices(spark):
    m = spark.createDataFrame([(1, 0, 0, 2.0), (1, 1, 0, 3.0), (1, 1, 0, 3.0), (1, 2, 2, None)], M).withColumn("entries", F.lit("x")).withColumn("_v", F.lit(0))
    slabs = spark.createDataFrame([(9, 1, 0, 3, 3, None, [0, 2, 2, 3]), (10, 2, 5, 1, 1, 4, [0, 4]), (11, 3, 0, 0, 0, 0, None), (12, 4, 0, 0, 0, 0, [0])], "csc_id long, graph_id long, col_lo long, m long, n long, nnz long, p array<int>")
    cols = column_results(m, slabs)
    got = {(r["graph_id"], r["col"]): (r["entries"], r["sum_val"], r["csc_entries"], r["agree"]) for r in cols.collect()}
    assert got == {(1, 0): (2, 5.0, 2, True), (1, 1): (0, None, 0, True), (1, 2): (1, None, 1, True), (2, 5): (0, None, 4, False)}
    graphs = spark.createDataFrame([(1, "a"), (2, "b"), (5, "c")], "graph_id long, fname string")
    per = {r["graph_id"]: r for r in matrix_results(cols, slabs, graphs).collect()}
    assert (per[1]["entries"], per[1]["nnz"], per[1]["fname"], per[1]["longest_column"]) == (3, 3, "a", 2)
    assert per[2]["columns_differing"] == 1 and set(per) == {1, 2}
    assert column_results(m.limit(0), slabs.limit(0)).count() == 0 and pointer_counts(slabs.limit(0)).count() == 0

"""Sparse linear algebra as relational algebra on (graph_id, row, col, val)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from levelweave.plans.skew import skew_join

POSITION = ["graph_id", "row", "col"]


def transpose(m: DataFrame) -> DataFrame:
    return m.select("graph_id", F.col("col").alias("row"), F.col("row").alias("col"), "val")


def lower_half(m: DataFrame) -> DataFrame:
    return m.filter("row >= col")


def upper_half(m: DataFrame) -> DataFrame:
    return m.filter("row <= col")


def full(half: DataFrame) -> DataFrame:
    """Both triangles of a symmetric matrix stored as one."""
    return half.unionByName(transpose(half.filter("row <> col")))


def add(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """alpha A + beta B; a null value adds nothing, a position of either has a row."""
    scaled = lambda m, f: m.select(*POSITION, (F.col("val") * f).alias("val"))
    return scaled(a, alpha).unionByName(scaled(b, beta)).groupBy(*POSITION).agg(F.sum("val").alias("val"))


def symmetric_part(m: DataFrame) -> DataFrame:
    """Lower triangle of (A + A^T) / 2."""
    return lower_half(add(m, transpose(m), 0.5, 0.5))


def columns_sorted(m: DataFrame) -> DataFrame:
    """Compressed-column order: hash-partitioned by column, sorted within."""
    return m.repartition("graph_id", "col").sortWithinPartitions("graph_id", "col", "row")


def rows_sorted(m: DataFrame) -> DataFrame:
    """Compressed-row order."""
    return m.repartition("graph_id", "row").sortWithinPartitions("graph_id", "row", "col")


def inverse_permutation(perm: DataFrame) -> DataFrame:
    """(graph_id, old, new) with both sides swapped."""
    return perm.select("graph_id", F.col("new").alias("old"), F.col("old").alias("new"))


def permute(m: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """C with C[rows(i), cols(j)] = A[i, j]; positions without an image are left out."""
    r = rows.select("graph_id", F.col("old").alias("row"), F.col("new").alias("new_row"))
    c = cols.select("graph_id", F.col("old").alias("col"), F.col("new").alias("new_col"))
    return skew_join(skew_join(m, r, ["graph_id", "row"]), c, ["graph_id", "col"]).select("graph_id", F.col("new_row").alias("row"), F.col("new_col").alias("col"), "val")


def permute_symmetric(half: DataFrame, perm: DataFrame) -> DataFrame:
    """P A P^T of a symmetric lower triangle, again a lower triangle."""
    m = permute(half, perm, perm)
    return m.select("graph_id", F.greatest("row", "col").alias("row"), F.least("row", "col").alias("col"), "val")


def degree_order(m: DataFrame) -> DataFrame:
    """(graph_id, old, new): nodes numbered by falling degree, ties by number: a fill-reducing order's stand-in.

    Numbers are given in two steps, so no graph passes one task: by degree first (counts of a
    degree are few rows), then within a degree.
    """
    ends = m.filter("row <> col").select("graph_id", F.explode(F.array("row", "col")).alias("old")).groupBy("graph_id", "old").agg(F.count(F.lit(1)).alias("degree"))
    alone = m.select("graph_id", F.explode(F.array("row", "col")).alias("old")).distinct()
    d = alone.join(ends, ["graph_id", "old"], "left").select("graph_id", "old", F.coalesce("degree", F.lit(0)).alias("degree"), F.floor(F.col("old") / 65536).alias("block"))
    blocks = d.groupBy("graph_id", "degree", "block").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("graph_id").orderBy(F.col("degree").desc(), "block")
    start = blocks.withColumn("start", F.sum("n").over(w) - F.col("n")).drop("n")
    own = W.partitionBy("graph_id", "degree", "block").orderBy("old")
    return d.join(start, ["graph_id", "degree", "block"]).select("graph_id", "old", (F.col("start") + F.row_number().over(own) - 1).cast("long").alias("new"))


def is_permutation(perm: DataFrame) -> DataFrame:
    """Per graph whether ``new`` takes each of 0 .. n-1 once."""
    return perm.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), ((F.countDistinct("new") == F.count(F.lit(1))) & (F.min("new") == 0) & (F.max("new") == F.count(F.lit(1)) - 1)).alias("is_permutation"))


def diagonal(m: DataFrame) -> DataFrame:
    return m.filter("row = col").select("graph_id", F.col("row").alias("node"), "val")


def missing_diagonals(m: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes without a diagonal entry: none where every column starts with its diagonal."""
    return nodes.join(diagonal(m).select("graph_id", "node"), ["graph_id", "node"], "left_anti")


def with_diagonals(m: DataFrame, nodes: DataFrame, val: float = 0.0) -> DataFrame:
    """``m`` with the missing diagonals put in, also in columns that had no entry."""
    return m.unionByName(missing_diagonals(m, nodes).select("graph_id", F.col("node").alias("row"), F.col("node").alias("col"), F.lit(val).alias("val")))


def empty_columns(m: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per graph the nodes in whose column nothing stands."""
    bare = nodes.join(m.select("graph_id", F.col("col").alias("node")).distinct(), ["graph_id", "node"], "left_anti")
    return bare.groupBy("graph_id").agg(F.count(F.lit(1)).alias("empty_columns"))


def per_column(m: DataFrame) -> DataFrame:
    return m.groupBy("graph_id", "col").agg(F.count(F.lit(1)).alias("nnz"))


def row_sums(m: DataFrame) -> DataFrame:
    """b = A 1; nulls and NaN count as nothing."""
    return m.groupBy("graph_id", "row").agg(F.sum(F.when(~F.isnan("val"), F.col("val"))).alias("b"))


def norm(m: DataFrame) -> DataFrame:
    """Per graph the greatest absolute value."""
    return m.groupBy("graph_id").agg(F.max(F.when(~F.isnan("val"), F.abs("val"))).alias("norm"))


def residual(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per graph the greatest absolute difference; a position of one side counts in full."""
    x, y = a.select(*POSITION, F.col("val").alias("x")), b.select(*POSITION, F.col("val").alias("y"))
    d = F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))
    return x.join(y, POSITION, "full").groupBy("graph_id").agg(F.max(d).alias("residual"))


def is_equal(a: DataFrame, b: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Per graph whether both have the same positions and values within ``eps``; NaN equals nothing."""
    x, y = a.select(*POSITION, F.col("val").alias("x")), b.select(*POSITION, F.col("val").alias("y"))
    same = F.coalesce((F.abs(F.col("x") - F.col("y")) <= eps) & ~F.isnan("x") & ~F.isnan("y"), F.lit(False))
    return x.join(y, POSITION, "full").groupBy("graph_id").agg(F.min(same).alias("equal"))


def coarsen(m: DataFrame, k: int) -> DataFrame:
    """The pattern after each k consecutive rows and columns became one."""
    return m.select("graph_id", F.floor(F.col("row") / k).alias("row"), F.floor(F.col("col") / k).alias("col")).distinct()


def non_zeros(dense: DataFrame) -> DataFrame:
    return dense.filter(F.col("val") != 0)


def dense_rows(m: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, row, vals): each row over all columns that occur, zeros filled in.

    A row is one array as long as its graph has columns; for graphs whose rows fit a record.
    """
    cols = nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list("node")).alias("cols"))
    per_row = m.groupBy("graph_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "val"))).alias("at"))
    return per_row.join(cols, "graph_id").select("graph_id", "row", F.transform("cols", lambda c: F.coalesce(F.element_at("at", c), F.lit(0.0))).alias("vals"))


def one_based(m: DataFrame) -> DataFrame:
    return m.select("graph_id", (F.col("row") + 1).alias("row"), (F.col("col") + 1).alias("col"), "val")


def compressed(m: DataFrame, width: int = 4096) -> DataFrame:
    """(graph_id, col_lo, n, nnz, p): column pointers in slabs of ``width`` columns, empty columns included."""
    counts = per_column(m).withColumn("slab", F.floor(F.col("col") / width))
    per_slab = counts.groupBy("graph_id", "slab").agg(F.max("col").alias("last"), F.sum("nnz").alias("nnz"))
    lo = F.col("slab") * width
    dense = per_slab.select("graph_id", "slab", "last", "nnz", F.explode(F.sequence(lo, F.col("last"))).alias("col"))
    filled = dense.join(counts.select("graph_id", "slab", "col", F.col("nnz").alias("own")), ["graph_id", "slab", "col"], "left")
    end = F.sum(F.coalesce("own", F.lit(0))).over(W.partitionBy("graph_id", "slab").orderBy("col"))
    ends = filled.withColumn("end", end).groupBy("graph_id", "slab", "last", "nnz").agg(F.array_sort(F.collect_list("end")).alias("ends"))  # ends never fall; at most ``width`` a row
    return ends.select("graph_id", lo.alias("col_lo"), (F.col("last") - lo + 1).alias("n"), "nnz", F.concat(F.array(F.lit(0).cast("long")), "ends").alias("p"))

"""Results per column and per matrix although a few matrices and columns own most entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelweave.plans.skew import skew_aggregate, skew_join


def pointer_counts(slabs: DataFrame) -> DataFrame:
    """(graph_id, col, csc_entries) from column pointers; null or short pointer arrays give no columns."""
    counts = F.expr("transform(slice(p, 2, greatest(size(p) - 1, 0)), (x, i) -> x - p[i])")
    return slabs.filter(F.size("p") > 1).select("graph_id", "col_lo", F.posexplode(counts).alias("j", "csc_entries")).select("graph_id", (F.col("col_lo") + F.col("j")).alias("col"), F.col("csc_entries").cast("long").alias("csc_entries"))


def column_results(matrix: DataFrame, slabs: DataFrame) -> DataFrame:
    """Per (graph_id, col): entries (doubled rows once), finite values and their sum, and what the pointers say.

    Every column of either table has a row; ``agree`` tells whether both count the same.
    """
    own = skew_aggregate(matrix, ["graph_id", "col"], ["row"], "val")
    joined = own.join(pointer_counts(slabs), ["graph_id", "col"], "full")
    entries = F.coalesce("entries", F.lit(0))
    return joined.select("graph_id", "col", entries.alias("entries"), F.coalesce("bad_values", F.lit(0)).alias("bad_values"), "sum_val", "csc_entries", (entries == F.coalesce("csc_entries", F.lit(0))).alias("agree"))


def matrix_results(columns: DataFrame, slabs: DataFrame, graphs: DataFrame) -> DataFrame:
    """Per graph_id, from ``column_results``: entries, filled columns, longest column, sum of val, and nnz of the slabs.

    ``nnz`` of a slab without one is its last pointer. Sums per graph combine map-side
    from columns, so a graph with most of the rows is no more than one partial row a task.
    """
    per = columns.groupBy("graph_id").agg(
        F.sum("entries").alias("entries"), F.count(F.when(F.col("entries") > 0, 1)).alias("filled_columns"), F.max("entries").alias("longest_column"),
        F.sum("sum_val").alias("sum_val"), F.count(F.when(~F.col("agree"), 1)).alias("columns_differing"),
    )
    nnz = slabs.groupBy("graph_id").agg(F.sum(F.coalesce(F.col("nnz"), F.element_at("p", -1).cast("long"))).alias("nnz"))
    named = graphs.groupBy("graph_id").agg(F.max("fname").alias("fname"))
    return skew_join(per.join(nnz, "graph_id", "left"), named, ["graph_id"], "left")

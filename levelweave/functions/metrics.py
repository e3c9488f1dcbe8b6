"""Figures of matrices and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelweave.functions.quantiles import later_middle, percentiles, value_counts


def matrix_stats(entries: DataFrame) -> DataFrame:
    """Per graph n (columns that occur), nnz, flops and accesses of a forward solve, and entries next to the diagonal."""
    m = entries.groupBy("graph_id").agg(F.countDistinct("col").alias("n"), F.count(F.lit(1)).alias("nnz"), F.count(F.when(F.col("row") == F.col("col") + 1, 1)).alias("reuse"))
    return m.select("graph_id", "n", "nnz", (2 * (F.col("nnz") - F.col("n")) + F.col("n")).alias("flops"), (3 * (F.col("nnz") - F.col("n")) + 2 * F.col("n")).alias("accesses"), "reuse", F.round(F.col("nnz") / F.col("n"), 6).alias("nnz_per_row"))


def part_costs(schedule: DataFrame, costs: DataFrame) -> DataFrame:
    """(graph_id, level, part, nodes, cost)."""
    return schedule.join(costs, ["graph_id", "node"], "left").groupBy("graph_id", "level", "part").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.coalesce("cost", F.lit(0))).alias("cost"))


def schedule_metrics(parts: DataFrame, threads: int) -> DataFrame:
    """Per graph: levels, parts, average and weighted parallelism, critical path, potential gain, imbalance.

    ``parts`` comes from ``part_costs``. Imbalance is the cost-weighted mean over the levels of the greatest minus
    the least part cost; ``deviation`` is the sample deviation of that difference.
    """
    level = parts.groupBy("graph_id", "level").agg(F.count(F.lit(1)).alias("parts"), F.sum("nodes").alias("nodes"), F.sum("cost").alias("cost"), F.max("cost").alias("most"), F.min("cost").alias("least"))
    gap = F.col("most") - F.col("least")
    total, critical = F.sum("cost"), F.sum("most")
    r = lambda c: F.round(c, 6)
    return level.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("levels"), F.sum("parts").alias("parts"), r(F.sum("parts") / F.count(F.lit(1))).alias("average_parallelism"), r(F.sum(F.col("parts") * F.col("nodes")) / F.sum("nodes")).alias("weighted_parallelism"),
        r(F.sum(F.col("parts") * F.col("cost")) / total).alias("cost_parallelism"), total.alias("cost"), critical.alias("critical_path"), r(1 - total / threads / critical).alias("potential_gain"),
        r(F.sum(F.col("cost") * gap) / total).alias("imbalance"), F.max(gap).alias("greatest_gap"), r(F.stddev_samp(gap)).alias("deviation"),
    )


def first_levels(parts: DataFrame, levels: int = 3) -> DataFrame:
    """Per graph the greatest and all nodes of the parts of the first levels, and the sum of level maxima over all nodes."""
    level = parts.groupBy("graph_id", "level").agg(F.max("nodes").alias("most"), F.sum("nodes").alias("nodes"))
    per = [x for k in range(levels) for x in (F.max(F.when(F.col("level") == k, F.col("most"))).alias(f"most_{k}"), F.max(F.when(F.col("level") == k, F.col("nodes"))).alias(f"nodes_{k}"))]
    return level.groupBy("graph_id").agg(*per, F.round(F.sum("most") / F.sum("nodes"), 6).alias("serial_share"))


def adjacency_share(schedule: DataFrame) -> DataFrame:
    """Per graph the share of nodes whose part also holds the node before them."""
    before = schedule.select("graph_id", "level", "part", (F.col("node") + 1).alias("node"), F.lit(1).alias("next"))
    return schedule.join(before, ["graph_id", "level", "part", "node"], "left").groupBy("graph_id").agg(F.round(F.count("next") / F.count(F.lit(1)), 6).alias("consecutive"))


def profitable(scheduling: Column, serial: Column, parallel: Column) -> Column:
    """Runs after which a schedule has paid for its making; null where the parallel run saves nothing."""
    return F.when(serial > parallel, scheduling / (serial - parallel))


def factor_stats(entries: DataFrame) -> DataFrame:
    """Per graph flops and accesses of an incomplete Cholesky by columns.

    A column of k entries below its diagonal is scaled (k flops and a root) and updates the columns of its k
    entries, each at the entries both have: counted as pairs of entries of a column, k (k + 1) / 2.
    """
    k = entries.filter("row > col").groupBy("graph_id", "col").agg(F.count(F.lit(1)).alias("k"))
    every = entries.select("graph_id", "col").distinct().join(k, ["graph_id", "col"], "left").select("graph_id", F.coalesce("k", F.lit(0)).alias("k"))
    pairs = F.floor(F.sum(F.col("k") * (F.col("k") + 1)) / 2)
    return every.groupBy("graph_id").agg((F.count(F.lit(1)) + F.sum("k") + 2 * pairs).alias("flops"), (2 * F.count(F.lit(1)) + 2 * F.sum("k") + 3 * pairs).alias("accesses"))


def middle(times: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The element n // 2 of each key's sorted times, as a runner's median is taken: of two middles the later."""
    state = value_counts(times, keys, [column], F.lit(0))
    return percentiles(state, [*keys, "metric"], [500], later_middle).select(*keys, F.col("percentile").alias("middle"), F.col("n").alias("runs"))

"""Percentiles of numeric columns by cumulative frequencies, from counts that combine.

The state is a table of (keys, part, value, n): how often a value occurs in a part (a day, a
file, a partition). States combine by union and sum, so any set of parts can be asked.
Percentiles of exact states have no error; with ``rel_error`` values are
rounded to the middle of logarithmic bins first, which bounds the state's size by the
range of the values and the relative error of every percentile by ``rel_error``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from levelweave.plans.running import sorted_sums
from levelweave.plans.skew import skew_join


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The latest delivery of each record; records without a key are all kept."""
    w = W.partitionBy(key, "_own").orderBy(F.col(order).desc_nulls_last())
    return rows.withColumn("_own", F.when(F.col(key).isNull(), F.monotonically_increasing_id())).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_own")


def rounded(value: Column, rel_error: float) -> Column:
    """``value`` moved by at most ``rel_error`` of itself to the middle of a logarithmic bin; 0 stays."""
    gamma = (1 + rel_error) / (1 - rel_error)
    k = F.ceil(F.log(F.abs(value)) / math.log(gamma))
    middle = F.pow(F.lit(gamma), k) * (2 / (1 + gamma))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.signum(value) * middle)


def value_counts(rows: DataFrame, keys: list[str], metrics: list[str], part: Column, rel_error: float = 0.0) -> DataFrame:
    """The state of ``rows``: (keys, ``metric``, ``part``, ``value``, ``n``); nulls, NaN and infinities don't count."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    long = rows.select(*keys, part.alias("part"), pairs.alias("m")).select(*keys, "part", "m.metric", "m.value")
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    if rel_error:
        long = long.withColumn("value", rounded(F.col("value"), rel_error))
    return long.groupBy(*keys, "metric", "part", "value").agg(F.count(F.lit(1)).alias("n"))


def least_rank(n: Column, permille: Column) -> Column:
    """Rank, from 1, of the least value that p/1000 of n values don't exceed."""
    return F.floor((permille * n + 999) / 1000)


def later_middle(n: Column, permille: Column) -> Column:
    """Rank of element n // 2, counted from 0: of two middles the later."""
    return F.floor(n / 2) + 1


def percentiles(state: DataFrame, keys: list[str], permille: list[int], rank: Callable[[Column, Column], Column] = least_rank) -> DataFrame:
    """Per key the value at the rank of each p: the least that at least p/1000 of its values don't exceed.

    Columns: keys, ``permille``, ``percentile``, ``n`` (values counted). Counts of all parts are
    summed, range-partitioned and sorted by (keys, value), so a key however large is spread over
    tasks; running sums within a partition get the sums of earlier partitions added (a table of
    one row per key and partition), and the first value that reaches a target rank is picked.
    Null keys are a key of their own; an empty state gives no rows.
    """
    slim = state.groupBy(*keys, "value").agg(F.sum("n").cast("long").alias("n"))
    sums = sorted_sums(slim, keys, ["value"], "n")
    piece = sums.groupBy(*keys, "pid").agg(F.max("running").alias("held"))
    w = W.partitionBy(*keys)
    piece = piece.withColumn("total", F.sum("held").over(w)).withColumn("offset", F.sum("held").over(w.orderBy("pid")) - F.col("held"))
    wanted = piece.withColumn("permille", F.explode(F.array(*[F.lit(p) for p in permille])))
    target = F.greatest(F.lit(1), rank(F.col("total"), F.col("permille"))).cast("long")
    wanted = wanted.withColumn("rank", target - F.col("offset")).filter((F.col("rank") > 0) & (F.col("rank") <= F.col("held")))
    asked = wanted.groupBy(*keys, "pid").agg(F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("rank", "permille"))).alias("targets"))  # one entry per percentile
    names = [F.coalesce(F.hash(*keys), F.lit(0)).alias("h")]
    left = sums.select(*keys, "pid", "value", "n", "running", *names)
    right = asked.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("pid"), "total", "targets", *names)
    hit = skew_join(left, right, ["h", "pid"])
    for k in keys:
        hit = hit.filter(F.col(k).eqNullSafe(F.col(f"_{k}")))
    reached = F.filter("targets", lambda t: (t["rank"] <= F.col("running")) & (t["rank"] > F.col("running") - F.col("n")))
    return hit.select(*keys, "value", "total", F.explode(reached).alias("t")).select(*keys, F.col("t.permille").alias("permille"), F.col("value").alias("percentile"), F.col("total").alias("n"))

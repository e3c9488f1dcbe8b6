"""Matrices made from sizes: stencils, diagonals, random patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diagonal(nodes: DataFrame, val: float) -> DataFrame:
    """val times the identity on ``nodes`` (graph_id, node)."""
    return nodes.select("graph_id", F.col("node").alias("row"), F.col("node").alias("col"), F.lit(val).alias("val"))


def tridiagonal(nodes: DataFrame, below: float, on: float, above: float) -> DataFrame:
    """Three-point stencil on ``nodes``; neighbours that don't occur get no entry."""
    pick = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(float(v)).alias("val")) for d, v in ((-1, above), (0, on), (1, below))])).alias("s")
    stencil = nodes.select("graph_id", F.col("node").alias("col"), pick).select("graph_id", (F.col("col") + F.col("s.d")).alias("row"), "col", "s.val")
    return stencil.join(nodes.select("graph_id", F.col("node").alias("row")), ["graph_id", "row"], "left_semi").select("graph_id", "row", "col", "val")


def random_square(sizes: DataFrame, density: float, seed: int = 1, top: float = 1e4) -> DataFrame:
    """Each column of ``sizes`` (graph_id, n): a diagonal and about density * n other rows, values uniform in (0, top).

    Every column draws its own rows, by a hash of seed, column and draw; a row drawn twice counts once.
    """
    ranges = sizes.filter("n > 0").select("graph_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(65536).cast("long"))).alias("lo")).repartition("graph_id", "lo")
    cols = ranges.select("graph_id", "n", F.explode(F.sequence("lo", F.least(F.col("lo") + 65535, F.col("n") - 1))).alias("col"))
    draws = cols.select("*", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") * density).cast("int"))).alias("k"))
    row = F.when(F.col("k") == 0, F.col("col")).otherwise(F.pmod(F.xxhash64(F.lit(seed), "graph_id", "col", "k"), F.col("n")))
    part = F.pmod(F.xxhash64(F.lit(seed + 1), "graph_id", "col", "row"), F.lit(1_000_000_007)) / 1_000_000_007
    return draws.select("graph_id", row.alias("row"), "col").distinct().withColumn("val", part * top)


def sampled(rows: DataFrame, m: int, seed: int = 1) -> DataFrame:
    """``m`` rows drawn without replacement (a limit is what the operator is for)."""
    return rows.orderBy(F.rand(seed)).limit(m)

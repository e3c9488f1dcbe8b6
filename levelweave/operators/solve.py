"""Consumers of schedules: triangular solves and incomplete Cholesky."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelweave.operators.cells import components, substitute, sweep
from levelweave.operators.schedule import run_order
from levelweave.plans.running import running_sums
from levelweave.plans.skew import skew_join
from levelweave.plans.storage import cut


def solve_lower(entries: DataFrame, rhs: DataFrame, **bounds: int) -> DataFrame:
    """(graph_id, node, value): x of L x = b.

    ``rhs`` has graph_id, node, b for every row. A missing or zero diagonal is taken as 1, null and NaN values as 0.
    """
    val = F.coalesce(F.when(~F.isnan("val"), F.col("val")), F.lit(0.0))
    diag = entries.filter("row = col").select("graph_id", F.col("row").alias("node"), val.alias("d"))
    nodes = rhs.join(diag, ["graph_id", "node"], "left").select("graph_id", "node", F.col("b").cast("double").alias("base"), F.when(F.coalesce("d", F.lit(0.0)) == 0, 1.0).otherwise(F.col("d")).alias("scale"))
    off = entries.filter("row > col").select("graph_id", F.col("col").alias("src"), F.col("row").alias("dst"), val.alias("weight"))
    return sweep(off, nodes, substitute, **bounds)


def solve_scheduled(entries: DataFrame, rhs: DataFrame, schedule: DataFrame, **bounds: int) -> DataFrame:
    """(graph_id, node, value): ``solve_lower`` with the nodes run in the order of ``schedule``, level after level, part after part.

    Nodes are named by their place in the schedule, and the matrix is permuted so; a node that would run before
    one it depends on has an entry above the diagonal then, and gets a null value.
    """
    order = cut(run_order(schedule))
    place = lambda c: order.select("graph_id", F.col("node").alias(c), F.col("place").alias(f"{c}_at"))
    moved = cut(skew_join(skew_join(entries, place("row"), ["graph_id", "row"]), place("col"), ["graph_id", "col"]).select("graph_id", F.col("row_at").alias("row"), F.col("col_at").alias("col"), "val"))
    b = rhs.join(order, ["graph_id", "node"]).select("graph_id", F.col("place").alias("node"), "b")
    early = moved.filter("row < col").select("graph_id", F.col("row").alias("place"), F.lit(True).alias("early")).distinct()
    x = solve_lower(moved, b, **bounds).withColumnRenamed("node", "place").join(early, ["graph_id", "place"], "left")
    return x.join(order, ["graph_id", "place"]).select("graph_id", "node", F.when(F.col("early").isNull(), F.col("value")).alias("value"))


def product(entries: DataFrame, x: DataFrame) -> DataFrame:
    """(graph_id, node, value): L x."""
    v = x.select("graph_id", F.col("node").alias("col"), "value")
    return entries.join(v, ["graph_id", "col"]).groupBy("graph_id", F.col("row").alias("node")).agg(F.sum(F.col("val") * F.col("value")).alias("value"))


def _factor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of the factor, in order; rows that are ``known`` are factored already and only read."""
    kept = [b for b in batches if len(b)]
    if not kept:
        return
    pdf = pd.concat(kept, ignore_index=True).sort_values(["g", "row", "col"])
    rows: dict[tuple[int, int], dict[int, float]] = {}
    out: list[tuple[int, int, int, float]] = []
    for (g, i, known), part in pdf.groupby(["g", "row", "known"], sort=False):
        given = zip(part["col"].tolist(), part["val"].tolist())
        if known:
            rows[g, i] = dict(given)
            continue
        mine: dict[int, float] = {}
        for j, a in given:
            other = mine if j == i else rows.get((g, j), {})
            s = a - sum(v * other[k] for k, v in mine.items() if k in other and k < j)
            if j == i:
                mine[j] = math.sqrt(s) if s > 0 else math.nan
            else:
                d = other.get(j, math.nan)
                mine[j] = s / d if d else math.nan
        rows[g, i] = mine
        out += [(g, i, j, v) for j, v in mine.items()]
    yield pd.DataFrame(out, columns=["g", "row", "col", "val"])


_FACTOR = "g long, row long, col long, val double"


def incomplete_cholesky(entries: DataFrame, nodes: DataFrame, max_task_rows: int = 400_000) -> DataFrame:
    """IC(0): L with the pattern of the given lower triangle and L L^T = A on it.

    Rows of a weak component are taken in order; components are spread over the tasks. One of more than ``max_task_rows``
    entries is taken in ranges of rows, each with the earlier rows of the factor that its entries name. A pivot that is
    not positive makes its row NaN; null values count as 0.
    """
    edges = entries.filter("row > col").select("graph_id", F.col("col").alias("src"), F.col("row").alias("dst"))
    comp = components(edges, nodes).select("graph_id", F.col("node").alias("row"), "component")
    work = cut(skew_join(entries, comp, ["graph_id", "row"]).select(F.col("graph_id").alias("g"), "component", "row", "col", F.coalesce("val", F.lit(0.0)).alias("val"), F.lit(False).alias("known")))
    giants = cut(work.groupBy("g", "component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > max_task_rows).select("g", "component"))  # at most rows / max_task_rows
    none = giants.isEmpty()
    whole = work if none else skew_join(work, giants, ["g", "component"], "left_anti")
    found = whole.repartition("g", "component").drop("component").mapInPandas(_factor, _FACTOR)
    if not none:
        found = found.unionByName(_factor_ranges(cut(skew_join(work, giants, ["g", "component"], "left_semi")), max_task_rows))
    return found.withColumnRenamed("g", "graph_id")


def _factor_ranges(work: DataFrame, max_task_rows: int) -> DataFrame:
    """The factor of components larger than a task, range of rows after range."""
    sizes = work.groupBy("g", "component", "row").agg(F.count(F.lit(1)).alias("n"))
    ranged = running_sums(sizes, ["g", "component"], ["row"], "n").select("g", "row", F.floor((F.col("running") - F.col("n")) / max_task_rows).cast("int").alias("range"))
    placed = cut(skew_join(work, ranged, ["g", "row"]), ["range"])
    done = None
    for k in range(placed.agg(F.max("range")).first()[0] + 1):
        now = placed.filter(F.col("range") == k).drop("range")
        if done is not None:
            named = now.select("g", "component", F.col("col").alias("row")).distinct()
            now = now.unionByName(done.join(named, ["g", "row"]).select("g", "component", "row", "col", "val", F.lit(True).alias("known")))
        new = cut(now.repartition("g", "component").drop("component").mapInPandas(_factor, _FACTOR))
        done = new if done is None else done.unionByName(new)
    return done


def factor_product(factor: DataFrame) -> DataFrame:
    """(graph_id, row, col, val): L L^T at the positions of L; for each entry (i, j) the columns of row j are looked up in row i."""
    at = factor.select("graph_id", F.col("row").alias("j"), F.col("col").alias("k"), F.col("val").alias("y"))
    other = factor.select("graph_id", "row", F.col("col").alias("k"), F.col("val").alias("x"))
    pairs = factor.select("graph_id", "row", F.col("col").alias("j")).join(at, ["graph_id", "j"]).join(other, ["graph_id", "row", "k"])
    return pairs.groupBy("graph_id", "row", F.col("j").alias("col")).agg(F.sum(F.col("x") * F.col("y")).alias("val"))

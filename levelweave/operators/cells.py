"""Recursive work on many graphs at once, in tasks of bounded size.

Graphs of at most ``max_task_rows`` rows are co-located whole, many to a task. A larger graph is
cut into cells of neighbouring node numbers. ``sweep`` takes the cells of a graph in
order: as node numbers are topological, a cell needs only values of earlier ones, which are
joined to its incoming edges; so every edge is read once, whatever the depth of the graph.
``components`` unites each cell on its own and then the cells' labels, which are few.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelweave.plans.skew import skew_join
from levelweave.plans.storage import Cut, cut

MAX_TASK_ROWS = 400_000


def _bounds(rows: DataFrame, max_task_rows: int) -> tuple[DataFrame, int, int]:
    """(g, bounds) of the graphs that need cells, how many cells the largest has, and tasks for all rows.

    At most ``rows / max_task_rows`` graphs are that large, and each has ``size / max_task_rows`` bounds; one
    aggregate of approximate percentiles gives the bounds of all of them.
    """
    sizes = cut(rows.groupBy("g").agg(F.count(F.lit(1)).alias("size")))
    total, most = sizes.agg(F.sum("size"), F.max("size")).first()
    total, cells = total or 0, math.ceil((most or 0) / max_task_rows)
    tasks = max(2, math.ceil(total / max_task_rows), min(total // 5000, rows.sparkSession.sparkContext.defaultParallelism))
    if cells <= 1:
        return rows.sparkSession.createDataFrame([], "g long, bounds array<long>"), 1, tasks
    large = sizes.filter(F.col("size") > max_task_rows).select("g", F.ceil(F.col("size") / max_task_rows).cast("int").alias("cells"))
    steps = max(200, 4 * cells)
    marks = rows.join(F.broadcast(large), "g").groupBy("g").agg(F.percentile_approx("node", [k / steps for k in range(1, steps)], 10 * steps).alias("marks"), F.first("cells").alias("cells"))
    picked = F.transform(F.sequence(F.lit(1), F.col("cells") - 1), lambda k: F.element_at("marks", F.greatest(F.lit(1), F.round(k * steps / F.col("cells")).cast("int"))))
    bounds = cut(marks.select("g", F.array_sort(F.array_distinct(picked)).cast("array<long>").alias("bounds")))
    return bounds, 1 + bounds.agg(F.max(F.size("bounds"))).first()[0], tasks


def _cell(node: str) -> Column:
    return F.when(F.col("bounds").isNull(), F.lit(0)).otherwise(F.size(F.filter("bounds", lambda b: b < F.col(node))))


def longest(base: float, scale: float, inputs: list[tuple[float, float]]) -> float:
    """Level of a node: one more than its highest predecessor."""
    return max((v for v, _ in inputs), default=-1.0) + 1.0


def substitute(base: float, scale: float, inputs: list[tuple[float, float]]) -> float:
    """Forward substitution: (b - sum of w * x) / diagonal."""
    for v, w in inputs:
        base -= w * v
    return base / scale if scale else math.nan


def sweep(edges: DataFrame, nodes: DataFrame, step: Callable[[float, float, list[tuple[float, float]]], float] = longest, max_task_rows: int = MAX_TASK_ROWS) -> DataFrame:
    """(graph_id, node, value): ``step(base, scale, [(value of src, weight), ...])`` along all edges.

    ``edges`` has graph_id, src, dst and, if ``step`` needs it, weight; ``nodes`` has graph_id, node and,
    if needed, base and scale. Inputs of a node come by ascending src. Nodes that only edges name get no value.
    """
    zero = lambda df, c: F.col(c).cast("double") if c in df.columns else F.lit(0.0)
    own = nodes.select(F.col("graph_id").alias("g"), "node", F.lit(-1).cast("long").alias("src"), zero(nodes, "base").alias("x"), zero(nodes, "scale").alias("w"))
    into = edges.select(F.col("graph_id").alias("g"), F.col("dst").alias("node"), "src", F.lit(None).cast("double").alias("x"), zero(edges, "weight").alias("w"))
    rows = cut(own.unionByName(into))
    bounds, cells, tasks = _bounds(rows, max_task_rows)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [b for b in batches if len(b)]
        if not kept:
            return
        pdf = pd.concat(kept, ignore_index=True).sort_values(["g", "node", "src"], kind="stable")
        values: dict[tuple[int, int], float] = {}
        out: list[tuple[int, int, float]] = []
        at, base, scale, inputs = None, 0.0, 0.0, []
        for g, node, src, x, w in zip(pdf["g"].tolist(), pdf["node"].tolist(), pdf["src"].tolist(), pdf["x"].tolist(), pdf["w"].tolist()):
            if at != (g, node):
                if at is not None and base is not None:
                    values[at] = step(base, scale, inputs)
                    out.append((*at, values[at]))
                at, base, scale, inputs = (g, node), None, 0.0, []
            if src < 0:
                base, scale = x, w
            else:
                got = x if x == x else values.get((g, src))
                if got is not None:
                    inputs.append((got, w))
        if base is not None:
            values[at] = step(base, scale, inputs)
            out.append((*at, values[at]))
        yield pd.DataFrame(out, columns=["g", "node", "value"]).astype({"g": "int64", "node": "int64", "value": "float64"})

    schema = "g long, node long, value double"
    if cells == 1:
        done = rows.repartition(tasks, "g").mapInPandas(solve, schema)
    else:
        crosses = (F.col("src") >= 0) & (_cell("src") < _cell("node"))  # only such edges need values of earlier cells
        placed = cut(rows.join(F.broadcast(bounds), "g", "left").withColumn("cell", _cell("node")).withColumn("crosses", crosses).drop("bounds"), ["cell"])
        done = None
        for k in range(cells):
            now = placed.filter(F.col("cell") == k).drop("cell")
            if done is not None:
                before = done.select("g", F.col("node").alias("src"), F.col("value").alias("known"))
                far = skew_join(now.filter("crosses"), before, ["g", "src"], "left").select("g", "node", "src", F.coalesce("x", "known").alias("x"), "w")
                now = now.filter("not crosses").select("g", "node", "src", "x", "w").unionByName(far)
            else:
                now = now.drop("crosses")
            solved = cut(now.repartition(tasks, "g").mapInPandas(solve, schema))
            done = solved if done is None else done.unionByName(solved)
    return done.select(F.col("g").alias("graph_id"), "node", "value")


def least_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least position of its component for each of n positions, from links (a, b): hook to the lesser label, then jump."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Least node of its component for every node that the links of a task name."""
    kept = [b for b in batches if len(b)]
    if not kept:
        return
    pdf = pd.concat(kept, ignore_index=True)
    ends = pd.concat([pdf[["g", "k", "node"]], pdf[["g", "k", "other"]].rename(columns={"other": "node"})], ignore_index=True)
    names = ends.drop_duplicates().sort_values(["g", "k", "node"], ignore_index=True)
    codes = ends.merge(names.assign(code=np.arange(len(names))), on=["g", "k", "node"], how="left")["code"].to_numpy()
    label = least_of(codes[: len(pdf)], codes[len(pdf) :], len(names))
    yield names.assign(label=names["node"].to_numpy()[label]).astype("int64")


def components(edges: DataFrame, nodes: DataFrame, within: str | None = None, max_task_rows: int = MAX_TASK_ROWS) -> DataFrame:
    """(graph_id[, within], node, component): weak components, named by their least node.

    ``within`` (a column of both tables) keeps components apart, as in a window of levels.
    """
    k = F.col(within).cast("long") if within else F.lit(0).cast("long")
    pairs = edges.select(F.col("graph_id").alias("g"), k.alias("k"), F.col("dst").alias("node"), F.col("src").alias("other"))
    rows = cut(pairs.unionByName(nodes.select(F.col("graph_id").alias("g"), k.alias("k"), "node", F.col("node").alias("other"))))
    bounds, cells, tasks = _bounds(rows, max_task_rows)
    placed = rows.join(F.broadcast(bounds), "g", "left").withColumn("cell", _cell("node")).drop("bounds")
    local = placed.repartition(tasks, "g", "cell").drop("cell").mapInPandas(_united, "g long, k long, node long, label long")
    if cells > 1:
        local = cut(local)
        seen = local.groupBy("g", "k", "node").agg(F.min("label").alias("to"), F.max("label").alias("most"))
        bridges = local.join(seen.filter("`to` <> most"), ["g", "k", "node"]).filter("label <> `to`").select("g", "k", F.col("label").alias("a"), F.col("to").alias("b")).distinct()
        names = least_labels(bridges)
        local = skew_join(local.withColumnRenamed("label", "a"), names, ["g", "k", "a"], "left").select("g", "k", "node", F.coalesce("least", "a").alias("label")).groupBy("g", "k", "node").agg(F.min("label").alias("label"))
    out = [F.col("g").alias("graph_id"), *([F.col("k").alias(within)] if within else []), "node", F.col("label").alias("component")]
    return local.select(*out)


def least_labels(links: DataFrame) -> DataFrame:
    """(g, k, a, least) of the nodes of undirected links (g, k, a, b): hook to the least neighbour, then jump.

    Rounds grow with the logarithm of the longest chain of labels; each is a join and an aggregate.
    """
    both = cut(links.select("g", "k", "a", "b").unionByName(links.select("g", "k", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = Cut(both.groupBy("g", "k", "a").agg(F.least(F.min("b"), F.first("a")).alias("least")))
    while True:
        near = both.join(now.df.select("g", "k", F.col("a").alias("b"), F.col("least").alias("other")), ["g", "k", "b"]).groupBy("g", "k", "a").agg(F.min("other").alias("other"))
        hooked = now.df.join(near, ["g", "k", "a"], "left").select("g", "k", "a", F.least("least", F.coalesce("other", "least")).alias("mid"), "least")
        jump = now.df.select("g", "k", F.col("a").alias("mid"), F.col("least").alias("far"))
        after = Cut(hooked.join(jump, ["g", "k", "mid"], "left").select("g", "k", "a", F.least("mid", F.coalesce("far", "mid")).alias("least"), F.col("least").alias("was")))
        moved = after.df.filter("least <> was").limit(1).count()
        now.drop()
        now = after
        if not moved:
            return now.df.select("g", "k", "a", "least")
        now.df = now.df.drop("was")

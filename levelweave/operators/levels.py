"""Level sets (wavefronts): the level of a node is 0 without predecessors, else one more than their highest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelweave.operators.cells import longest, sweep
from levelweave.operators.graphs import merged_copies
from levelweave.operators.grouping import group_edges


def level_sets(edges: DataFrame, nodes: DataFrame, **bounds: int) -> DataFrame:
    """(graph_id, node, level). Works on any depth; node numbers must be topological."""
    return sweep(edges, nodes, longest, **bounds).select("graph_id", "node", F.col("value").cast("int").alias("level"))


def reversed_graph(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges turned round; numbers are negated, so that they stay a topological order."""
    return edges.select("graph_id", (-F.col("dst") - 1 + 2**40).alias("src"), (-F.col("src") - 1 + 2**40).alias("dst")), nodes.select("graph_id", (-F.col("node") - 1 + 2**40).alias("node"))


def depth_from_sinks(edges: DataFrame, nodes: DataFrame, **bounds: int) -> DataFrame:
    """(graph_id, node, depth): longest way to a sink."""
    e, n = reversed_graph(edges, nodes)
    return level_sets(e, n, **bounds).select("graph_id", (-F.col("node") - 1 + 2**40).alias("node"), F.col("level").alias("depth"))


def histogram(levels: DataFrame) -> DataFrame:
    """(graph_id, level, width)."""
    return levels.groupBy("graph_id", "level").agg(F.count(F.lit(1)).alias("width"))


def level_sets_of_copies(edges: DataFrame, nodes: DataFrame, copies: int, **bounds: int) -> DataFrame:
    """Level sets of several copies of a graph of which each waits, node by node, for the one before."""
    n = nodes.groupBy("graph_id").agg((F.max("node") + 1).alias("n"))
    q = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("q")
    all_nodes = nodes.join(n, "graph_id").select("graph_id", "node", "n", q).select("graph_id", (F.col("node") + F.col("q") * F.col("n")).alias("node"))
    return level_sets(merged_copies(edges, nodes, copies), all_nodes, **bounds)


def level_sets_of_groups(edges: DataFrame, groups: DataFrame, **bounds: int) -> DataFrame:
    """(graph_id, group, level) of the quotient graph (supernodes, blocks, chains, trees)."""
    members = groups.select("graph_id", F.col("group").alias("node")).distinct()
    return level_sets(group_edges(edges, groups), members, **bounds).withColumnRenamed("node", "group")

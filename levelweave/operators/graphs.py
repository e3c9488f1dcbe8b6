"""Building, merging and reducing dependency graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelweave.operators.grouping import supernodes


def two_cycles(edges: DataFrame) -> DataFrame:
    """Pairs of nodes with an edge each way; self-loops are no pair."""
    back = edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, ["graph_id", "src", "dst"], "left_semi").filter("src < dst")


def two_hop_reduction(edges: DataFrame) -> DataFrame:
    """Edges i->j for which no k has i->k and k->j.

    Only pairs that are edges matter, so two-hop paths are made from each edge's end with the fewer
    ways on: of edge i->j either i's successors k are looked up as k->j, or j's predecessors as i->k.
    """
    e = edges.select("graph_id", "src", "dst")
    outs = e.groupBy("graph_id", "src").agg(F.count(F.lit(1)).alias("outs"))
    ins = e.groupBy("graph_id", "dst").agg(F.count(F.lit(1)).alias("ins"))
    sized = e.join(outs, ["graph_id", "src"]).join(ins, ["graph_id", "dst"])
    sized = sized.filter("outs > 1 and ins > 1")
    forward = sized.filter("outs <= ins").join(e.select("graph_id", "src", F.col("dst").alias("k")), ["graph_id", "src"]).filter("k < dst").select("graph_id", "src", "dst", F.col("k").alias("a"), F.col("dst").alias("b"))
    backward = sized.filter("outs > ins").join(e.select("graph_id", "dst", F.col("src").alias("k")), ["graph_id", "dst"]).filter("k > src").select("graph_id", "src", "dst", F.col("src").alias("a"), F.col("k").alias("b"))
    found = forward.unionByName(backward).join(e.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b")), ["graph_id", "a", "b"], "left_semi")
    return e.join(found.select("graph_id", "src", "dst").distinct(), ["graph_id", "src", "dst"], "left_anti")


def cliques_to_chains(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Within a run of nested columns each node keeps only the edge to the next; the last keeps its own edges."""
    g = supernodes(edges, nodes)
    last = g.groupBy("graph_id", "group").agg(F.max("node").alias("last"))
    own = g.join(last, ["graph_id", "group"]).select("graph_id", F.col("node").alias("src"), "last")
    return edges.join(own, ["graph_id", "src"]).filter((F.col("src") == F.col("last")) | (F.col("dst") == F.col("src") + 1)).select("graph_id", "src", "dst")


def merged_copies(edges: DataFrame, nodes: DataFrame, copies: int) -> DataFrame:
    """``copies`` of each graph side by side, node v of one copy before v of the next."""
    n = nodes.groupBy("graph_id").agg((F.max("node") + 1).alias("n"))
    q = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("q")
    at = lambda c: (F.col(c) + F.col("q") * F.col("n")).alias(c)
    own = edges.join(n, "graph_id").select("*", q).select("graph_id", at("src"), at("dst"))
    couple = nodes.join(n, "graph_id").select("graph_id", "n", F.col("node").alias("src"), q).filter(F.col("q") < copies - 1)
    return own.unionByName(couple.select("graph_id", at("src"), (F.col("src") + (F.col("q") + 1) * F.col("n")).alias("dst")))


def merged_with(first: DataFrame, between: DataFrame, second: DataFrame, nodes: DataFrame) -> DataFrame:
    """Two graphs on the same nodes, the second shifted, coupled by the edges ``between`` (src of the first, dst of the second)."""
    n = nodes.groupBy("graph_id").agg((F.max("node") + 1).alias("n"))
    moved = second.join(n, "graph_id").select("graph_id", (F.col("src") + F.col("n")).alias("src"), (F.col("dst") + F.col("n")).alias("dst"))
    tied = between.join(n, "graph_id").select("graph_id", "src", (F.col("dst") + F.col("n")).alias("dst"))
    return first.select("graph_id", "src", "dst").unionByName(moved).unionByName(tied)

"""Grouping of vertices: islands of consecutive nodes, chains, trees, supernodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from levelweave.operators.hierarchy import hierarchy
from levelweave.plans.skew import skew_join

BLOCK = 65536


def islands(flags: DataFrame, node: str = "node") -> DataFrame:
    """(graph_id, node, group) from (graph_id, node, joins): a node joins the group of the node before it if ``joins``.

    The group is the last node at or before that doesn't join. Running maxima are taken
    in blocks of node numbers and then over the blocks, so no graph passes one task.
    """
    head = F.when(~F.coalesce("joins", F.lit(False)), F.col(node))
    b = flags.withColumn("_block", F.floor(F.col(node) / BLOCK)).withColumn("_head", head)
    w = W.partitionBy("graph_id", "_block").orderBy(node)
    inner = b.withColumn("_in", F.max("_head").over(w.rowsBetween(W.unboundedPreceding, 0)))
    ends = b.groupBy("graph_id", "_block").agg(F.max("_head").alias("_end"))
    over = W.partitionBy("graph_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("_before", F.max("_end").over(over)).select("graph_id", "_block", "_before")
    return inner.join(carried, ["graph_id", "_block"]).select("graph_id", node, F.coalesce("_in", "_before", F.col(node)).alias("group"))


def consecutive_rows(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Row i joins row i-1 if its last off-diagonal column is i-1."""
    last = edges.groupBy("graph_id", F.col("dst").alias("node")).agg(F.max("src").alias("far"))
    return islands(nodes.join(last, ["graph_id", "node"], "left").withColumn("joins", F.col("far") == F.col("node") - 1))


def consecutive_columns(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Column i+1 joins column i if i's first off-diagonal row is i+1."""
    first = edges.groupBy("graph_id", "src").agg(F.min("dst").alias("near")).filter(F.col("near") == F.col("src") + 1).select("graph_id", (F.col("src") + 1).alias("node"), F.lit(True).alias("joins"))
    return islands(nodes.join(first, ["graph_id", "node"], "left"))


def blocks(nodes: DataFrame, size: int) -> DataFrame:
    """Fixed blocks of consecutive numbers."""
    return nodes.select("graph_id", "node", (F.floor(F.col("node") / size) * size).cast("long").alias("group"))


def _roots(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each node's group along ``links`` (graph_id, node, parent), named by its last node.

    Only that node has edges to other groups, so edges between groups ascend too.
    """
    tree = nodes.join(links, ["graph_id", "node"], "left")
    return hierarchy(tree, order=None, root_values=(), paths=False).select("graph_id", "node", F.col("root").alias("group"))


def chains(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """u and v are one group if v is u's only successor and u is v's only predecessor."""
    outs = edges.groupBy("graph_id", "src").agg(F.count(F.lit(1)).alias("outs"), F.max("dst").alias("dst"))
    ins = edges.groupBy("graph_id", "dst").agg(F.count(F.lit(1)).alias("ins"))
    links = outs.filter("outs = 1").join(ins.filter("ins = 1"), ["graph_id", "dst"]).select("graph_id", F.col("src").alias("node"), F.col("dst").alias("parent"))
    return _roots(links, nodes)


def trees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A node belongs to the group of its only successor; with several successors it starts one."""
    links = edges.groupBy("graph_id", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outs"), F.max("dst").alias("parent")).filter("outs = 1").drop("outs")
    return _roots(links, nodes)


def supernodes(edges: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Runs of adjacent columns of which each one's pattern is the next's and the next itself.

    Patterns are compared as (count, sum of hashes) of the rows below the next column, which
    one aggregate gives; no list of rows is collected. With ``limit`` runs are cut at that length.
    """
    h = F.xxhash64("dst").cast("decimal(38,0)")
    own = edges.groupBy("graph_id", "src").agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("sum"), F.min("dst").alias("first"))
    nxt = own.select("graph_id", (F.col("src") - 1).alias("src"), F.col("n").alias("n2"), F.col("sum").alias("sum2"))
    after = F.xxhash64(F.col("src") + 1).cast("decimal(38,0)")
    nested = (F.col("first") == F.col("src") + 1) & (F.col("n") - 1 == F.coalesce("n2", F.lit(0))) & (F.col("sum") - after == F.coalesce("sum2", F.lit(0)))
    joins = own.join(nxt, ["graph_id", "src"], "left").filter(nested).select("graph_id", (F.col("src") + 1).alias("node"), F.lit(True).alias("joins"))
    found = islands(nodes.join(joins, ["graph_id", "node"], "left"))
    if limit:
        found = found.withColumn("group", F.col("group") + F.floor((F.col("node") - F.col("group")) / limit) * limit)
    return found


def group_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """The quotient graph: distinct edges between groups."""
    s = groups.select("graph_id", F.col("node").alias("src"), F.col("group").alias("s"))
    t = groups.select("graph_id", F.col("node").alias("dst"), F.col("group").alias("t"))
    return skew_join(skew_join(edges, s, ["graph_id", "src"]), t, ["graph_id", "dst"]).filter("s <> t").select("graph_id", F.col("s").alias("src"), F.col("t").alias("dst")).distinct()


def group_sizes(groups: DataFrame, cost: Column | None = None) -> DataFrame:
    return groups.groupBy("graph_id", "group").agg(F.count(F.lit(1)).alias("size"), *([F.sum(cost).alias("cost")] if cost is not None else []))


def padded_blocks(m: DataFrame, groups: DataFrame) -> DataFrame:
    """(graph_id, group, row, cols, vals): rows of supernode blocks, filled with zeros to its columns."""
    cols = groups.groupBy("graph_id", "group").agg(F.array_sort(F.collect_list("node")).alias("cols"))
    own = groups.select("graph_id", F.col("node").alias("col"), "group")
    rows = m.join(own, ["graph_id", "col"]).groupBy("graph_id", "group", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "val"))).alias("at"))
    return rows.join(cols, ["graph_id", "group"]).select("graph_id", "group", "row", "cols", F.transform("cols", lambda c: F.coalesce(F.element_at("at", c), F.lit(0.0))).alias("vals"))


def unpadded(blocks_: DataFrame) -> DataFrame:
    """Entries of padded blocks, without the zeros put in."""
    pairs = F.explode(F.arrays_zip("cols", "vals")).alias("z")
    return blocks_.select("graph_id", "row", pairs).select("graph_id", "row", F.col("z.cols").alias("col"), F.col("z.vals").alias("val")).filter("val <> 0 and row >= col")

"""Symbolic factorisation: sizes, reaches and orders of a factor L from its elimination tree, without its pattern.

The columns that row i of L touches form a subtree of the elimination tree, rooted at i. Its leaves are few, and
with the nodes where neighbouring leaves meet they say all about it; both come from joins whose number
is the logarithm of the depth. Work and tables are as large as the matrix, not as the factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from levelweave.operators.hierarchy import figures, hierarchy
from levelweave.operators.trees import elimination_tree, post_order, relabelled
from levelweave.plans.skew import skew_join
from levelweave.plans.storage import Cut, cut


def factor_tree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``hierarchy`` of the elimination tree, without paths."""
    return cut(hierarchy(elimination_tree(edges, nodes), order=None, root_values=(), paths=False))


def _ranks(tree: DataFrame) -> DataFrame:
    """(graph_id, node, post, first): place in the post order, and the least place below."""
    below = figures(tree).select("graph_id", "node", "descendants")
    return cut(post_order(tree).join(below, ["graph_id", "node"]).select("graph_id", "node", "post", (F.col("post") - F.col("descendants")).alias("first")))


def _jumps(tree: DataFrame, ranks: DataFrame, weights: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (graph_id, node, up, up_post, held) of the ancestors 1, 2, 4, ... links up, and (graph_id, node, held): sums of ``weights`` up to the root.

    ``held`` sums over the node and all below the ancestor; where there is none, up to the root.
    """
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    above = ranks.select("graph_id", F.col("node").alias("parent"), F.col("post").alias("up_post"))
    own = tree.join(weights.select("graph_id", "node", "weight"), ["graph_id", "node"], "left").select("graph_id", "node", "parent", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("held"))
    now = cut(skew_join(own, above, ["graph_id", "parent"], "left").select("graph_id", "node", F.col("parent").alias("up"), "up_post", "held"))
    jumps = []
    for _ in range(int(deepest).bit_length()):
        jumps.append(now)
        far = now.select("graph_id", F.col("node").alias("up"), F.col("up").alias("next"), F.col("up_post").alias("next_post"), F.col("held").alias("more"))
        now = cut(skew_join(now.drop("up_post"), far, ["graph_id", "up"], "left").select("graph_id", "node", F.col("next").alias("up"), F.col("next_post").alias("up_post"), (F.col("held") + F.coalesce("more", F.lit(0.0))).alias("held")))
    return jumps, now.select("graph_id", "node", "held")


def _row_leaves(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """(graph_id, row, leaf, post, before): the leaves of every row's subtree, each with the leaf before it in post order.

    A column is a leaf if nothing below it is in the row, that is if the row's column before it lies before its first descendant.
    """
    at = ranks.select("graph_id", F.col("node").alias("src"), "post", "first")
    w = W.partitionBy("graph_id", "dst").orderBy("post")
    seen = skew_join(edges.select("graph_id", "src", "dst"), at, ["graph_id", "src"]).withColumn("seen", F.lag("post").over(w))
    leaves = seen.filter(F.coalesce(F.col("first") > F.col("seen"), F.lit(True)))
    return cut(leaves.select("graph_id", F.col("dst").alias("row"), F.col("src").alias("leaf"), "post", F.lag("src").over(w).alias("before")))


def _meets(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(graph_id, row, node): where a leaf and the one before it meet: the first ancestor of the earlier that isn't before the later in post order."""
    now = Cut(leaves.filter("before is not null").select("graph_id", "row", F.col("before").alias("node"), F.col("post").alias("goal")))
    if not jumps:  # trees of one node each have no rows with two leaves
        return now.df.select("graph_id", "row", "node")
    for jump in reversed(jumps):
        moved = skew_join(now.df, jump.select("graph_id", "node", "up", "up_post"), ["graph_id", "node"], "left")
        after = Cut(moved.select("graph_id", "row", F.when(F.col("up_post") < F.col("goal"), F.col("up")).otherwise(F.col("node")).alias("node"), "goal"))
        now.drop()
        now = after
    return cut(skew_join(now.df, jumps[0].select("graph_id", "node", "up"), ["graph_id", "node"]).select("graph_id", "row", F.col("up").alias("node")))


def column_counts(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """(graph_id, node, count): entries of each column of L with its diagonal; ``tree`` is the ``factor_tree``.

    A column counts the rows whose subtree holds it: leaves begin rows, meetings and parents end what would count twice.
    """
    ranks = _ranks(tree)
    leaves = _row_leaves(edges, ranks)
    jumps, _ = _jumps(tree, ranks, ranks.select("graph_id", "node", F.lit(0).alias("weight")))
    delta = lambda df, by: df.select("graph_id", "node", F.lit(by).alias("delta"))
    begin = delta(ranks.filter("first = post"), 1).unionByName(delta(leaves.withColumnRenamed("leaf", "node"), 1))
    end = delta(tree.filter("parent is not null").select("graph_id", F.col("parent").alias("node")), -1).unionByName(delta(_meets(leaves, jumps), -1))
    change = begin.unionByName(end).groupBy("graph_id", "node").agg(F.sum("delta").alias("cost"))
    return figures(tree.join(change, ["graph_id", "node"], "left"), cost="cost").select("graph_id", "node", F.col("cost").cast("long").alias("count"))


def reach_costs(edges: DataFrame, tree: DataFrame, weights: DataFrame) -> DataFrame:
    """(graph_id, node, cost): the ``weights`` (graph_id, node, weight) of all columns that row ``node`` of L touches, its own with them."""
    ranks = _ranks(tree)
    leaves = _row_leaves(edges, ranks)
    jumps, sums = _jumps(tree, ranks, weights)
    part = lambda df, by: skew_join(df, sums, ["graph_id", "node"]).select("graph_id", "row", (F.col("held") * by).alias("held"))
    ways = part(leaves.select("graph_id", "row", F.col("leaf").alias("node")), 1).unionByName(part(_meets(leaves, jumps), -1)).unionByName(part(leaves.select("graph_id", "row").distinct().withColumn("node", F.col("row")), -1))
    below = ways.groupBy("graph_id", F.col("row").alias("node")).agg(F.sum("held").alias("below"))
    own = tree.select("graph_id", "node").join(weights.select("graph_id", "node", "weight"), ["graph_id", "node"], "left").join(below, ["graph_id", "node"], "left")
    return own.select("graph_id", "node", (F.coalesce("weight", F.lit(0)) + F.coalesce("below", F.lit(0.0))).alias("cost"))


def symbolic_factor(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, node, parent, old, count): the elimination tree named by its post order, in which children with fewer entries come first.

    ``old`` is the node's number in the matrix, ``count`` the entries of its column of L.
    """
    tree = factor_tree(edges, nodes)
    counts = cut(column_counts(edges, tree))
    order = cut(post_order(tree, counts.withColumnRenamed("count", "weight")))
    sizes = order.join(counts, ["graph_id", "node"]).select("graph_id", F.col("node").alias("old"), F.col("post").alias("node"), "count")
    return relabelled(tree, order).join(sizes, ["graph_id", "node"])

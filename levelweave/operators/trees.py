"""Elimination trees: making them, orders and costs on them, and the factor patterns they give."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelweave.operators.cells import components
from levelweave.operators.hierarchy import figures
from levelweave.plans.running import running_sums
from levelweave.plans.skew import skew_join
from levelweave.plans.storage import cut


def children(nodes: DataFrame) -> DataFrame:
    """(graph_id, parent, children, first, last): how many children each inner node has, and the outer two."""
    return nodes.filter(F.col("parent").isNotNull()).groupBy("graph_id", "parent").agg(F.count(F.lit(1)).alias("children"), F.min("node").alias("first"), F.max("node").alias("last"))


def subtree_costs(tree: DataFrame, costs: DataFrame) -> DataFrame:
    """(graph_id, node, cost): sum of ``costs`` (graph_id, node, cost) over each subtree of a ``hierarchy``."""
    return figures(tree.join(costs, ["graph_id", "node"], "left"), cost="cost").select("graph_id", "node", "cost")


def post_order(tree: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(graph_id, node, post): place of each node in the post order of a ``hierarchy``, trees by root.

    Children go by number or, with ``weights`` (graph_id, node, weight), by rising weight, then number.
    """
    ranked = tree.join(weights.select("graph_id", "node", "weight"), ["graph_id", "node"], "left") if weights is not None else tree
    f = cut(figures(ranked, rank="weight" if weights is not None else None).withColumn("graph_id", F.coalesce("graph_id", F.lit(-(2**63)))))
    roots = f.filter("node = root").select("graph_id", "root", (F.col("descendants") + 1).alias("size"))
    starts = running_sums(roots, ["graph_id"], ["root"], "size").select("graph_id", "root", (F.col("running") - F.col("size")).alias("start"))
    out = skew_join(f, starts, ["graph_id", "root"])
    return out.select(F.when(F.col("graph_id") != -(2**63), F.col("graph_id")).alias("graph_id"), "node", (F.col("start") + F.col("place")).alias("post"))


def relabelled(tree: DataFrame, order: DataFrame) -> DataFrame:
    """The tree with nodes named by their place in ``order`` (graph_id, node, post)."""
    up = order.select("graph_id", F.col("node").alias("parent"), F.col("post").alias("up"))
    return tree.select("graph_id", "node", "parent").join(order, ["graph_id", "node"]).join(up, ["graph_id", "parent"], "left").select("graph_id", F.col("post").alias("node"), F.col("up").alias("parent"))


def _parents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parents that the rows of a task give, in order, to their own nodes and to the tops of earlier trees, and the top of each after that."""
    kept = [b for b in batches if len(b)]
    if not kept:
        return
    pdf = pd.concat(kept, ignore_index=True).sort_values(["g", "dst", "src"])
    parent: dict[tuple[int, int], int | None] = {}
    above: dict[tuple[int, int], int] = {}
    fresh: set[tuple[int, int]] = set()
    for g, i, k in zip(pdf["g"].tolist(), pdf["dst"].tolist(), pdf["src"].tolist()):
        parent.setdefault((g, i), None)
        fresh.add((g, i))
        while k != i:  # climb from column k to the top known so far, and hang that below row i
            nxt = above.get((g, k), i)
            above[g, k] = i
            if nxt == i and parent.get((g, k)) is None:
                parent[g, k] = i
            k = nxt
    tops: dict[tuple[int, int], int] = {}
    for g, v in sorted(parent, reverse=True):  # an ancestor has a higher number
        tops[g, v] = tops[g, above[g, v]] if (g, v) in above else v
    rows = [(g, v, p, tops[g, v], (g, v) in fresh) for (g, v), p in parent.items()]
    yield pd.DataFrame({"g": [r[0] for r in rows], "node": [r[1] for r in rows], "parent": pd.array([r[2] for r in rows], dtype="Int64"), "top": [r[3] for r in rows], "fresh": [r[4] for r in rows]})


_FOUND = "g long, node long, parent long, top long, fresh boolean"


def _by_ranges(work: DataFrame, max_task_rows: int) -> DataFrame:
    """(g, node, parent) of components that are larger than a task: their rows in ranges, one after another.

    Of the trees of earlier ranges a range needs only the top above each column it names, so columns are replaced
    by these tops first; afterwards every earlier node's top is looked up once more.
    """
    sizes = work.groupBy("g", "component", "dst").agg(F.count(F.lit(1)).alias("n"))
    ranged = running_sums(sizes, ["g", "component"], ["dst"], "n").select("g", "dst", F.floor((F.col("running") - F.col("n")) / max_task_rows).cast("int").alias("range"))
    placed = cut(skew_join(work, ranged, ["g", "dst"]), ["range"])
    last = placed.agg(F.max("range")).first()[0]
    parents, tops = None, None
    for k in range(last + 1):
        now = placed.filter(F.col("range") == k).select("g", "component", "dst", "src")
        if tops is not None:
            known = tops.select("g", F.col("node").alias("src"), "top")
            now = skew_join(now, known, ["g", "src"], "left").select("g", "component", "dst", F.coalesce("top", "src").alias("src"))
        found = cut(now.repartition("g", "component").select("g", "dst", "src").mapInPandas(_parents, _FOUND))
        given = found.filter("parent is not null").select("g", "node", "parent")
        parents = given if parents is None else parents.unionByName(given)
        own = found.filter("fresh").select("g", "node", "top")
        if tops is not None:
            moved = found.filter("not fresh").select("g", F.col("node").alias("top"), F.col("top").alias("far"))
            own = own.unionByName(skew_join(tops, moved, ["g", "top"], "left").select("g", "node", F.coalesce("far", "top").alias("top")))
        tops = cut(own)
    return tops.select("g", "node").join(parents, ["g", "node"], "left")


def elimination_tree(edges: DataFrame, nodes: DataFrame, max_task_rows: int = 400_000) -> DataFrame:
    """(graph_id, node, parent) of the symmetric matrix with this lower pattern; parent null at roots.

    Liu's rule takes the rows of a component in order, so a weak component is a unit of work;
    components of all graphs are spread over the tasks. One of more than ``max_task_rows`` rows is taken in ranges of rows.
    """
    comp = components(edges, nodes)
    loops = nodes.select("graph_id", F.col("node").alias("dst"), F.col("node").alias("src"))
    own = comp.select("graph_id", F.col("node").alias("dst"), "component")
    work = cut(skew_join(edges.select("graph_id", "dst", "src").unionByName(loops), own, ["graph_id", "dst"]).select(F.col("graph_id").alias("g"), "component", "dst", "src"))
    giants = cut(work.groupBy("g", "component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > max_task_rows).select("g", "component"))  # at most rows / max_task_rows
    none = giants.isEmpty()
    whole = work if none else skew_join(work, giants, ["g", "component"], "left_anti")
    found = whole.repartition("g", "component").select("g", "dst", "src").mapInPandas(_parents, _FOUND).select("g", "node", "parent")
    if not none:
        found = found.unionByName(_by_ranges(cut(skew_join(work, giants, ["g", "component"], "left_semi")), max_task_rows))
    return found.select(F.col("g").alias("graph_id"), "node", "parent")


def row_patterns(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """(graph_id, row, col) of the factor L below its diagonal.

    Column j of row k's entries reaches every ancestor of j below k; ``tree`` is the
    ``hierarchy`` with paths of the elimination tree. As large as the factor itself.
    """
    paths = tree.select("graph_id", F.col("node").alias("src"), "path")
    reach = edges.join(paths, ["graph_id", "src"]).select("graph_id", F.col("dst").alias("row"), F.explode(F.filter("path", lambda a: a >= F.col("src"))).alias("col"))
    return reach.filter("col < row").distinct()


def column_counts(pattern: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, node, count): entries of each column of L with its diagonal."""
    n = pattern.groupBy("graph_id", F.col("col").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(n, ["graph_id", "node"], "left").select("graph_id", "node", (F.coalesce("n", F.lit(0)) + 1).alias("count"))


def flops(counts: DataFrame) -> DataFrame:
    """Per graph entries of L and the sum of squared column counts."""
    return counts.groupBy("graph_id").agg(F.sum("count").alias("nnz"), F.sum(F.col("count") * F.col("count")).alias("flops"))

"""Orders and groups that depend on a walk through a graph.

What is walked is the smallest unit that no other one depends on: trees of only successors, stretches of
consecutive nodes, else weak components. Units of all graphs are spread over the tasks, and each
task walks its own one after another. A component is walked whole.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from levelweave.operators.cells import components
from levelweave.operators.grouping import islands, trees
from levelweave.plans.skew import skew_join
from levelweave.plans.storage import cut

Graph = dict[int, list[int]]


def _by_component(edges: DataFrame, nodes: DataFrame, walk: Callable[[list[int], Graph, dict[int, float]], Iterator[tuple]], fields: str, costs: DataFrame | None = None) -> DataFrame:
    """Rows of ``walk(nodes, successors, costs)`` for every weak component, with its graph and name."""
    comp = components(edges, nodes)
    own = comp.join(costs, ["graph_id", "node"], "left") if costs is not None else comp.withColumn("cost", F.lit(1.0))
    own = own.select("graph_id", "component", "node", F.lit(None).cast("long").alias("dst"), F.coalesce("cost", F.lit(1.0)).alias("cost"))
    out = edges.join(comp.withColumnRenamed("node", "src"), ["graph_id", "src"]).select("graph_id", "component", F.col("src").alias("node"), "dst", F.lit(0.0).alias("cost"))
    names = [f.split()[0] for f in fields.split(", ")]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [b for b in batches if len(b)]
        if not kept:
            return
        pdf = pd.concat(kept, ignore_index=True).sort_values(["graph_id", "component", "node", "dst"], na_position="first")
        rows: list[tuple] = []
        at, members, succ, price = None, [], {}, {}
        for g, c, v, w, x in zip(pdf["graph_id"].tolist(), pdf["component"].tolist(), pdf["node"].tolist(), pdf["dst"].tolist(), pdf["cost"].tolist()):
            if at != (g, c):
                if at:
                    rows += [(*at, *r) for r in walk(members, succ, price)]
                at, members, succ, price = (g, c), [], {}, {}
            if w != w or w is None:
                members.append(v)
                succ[v], price[v] = [], x
            else:
                succ[v].append(int(w))
        rows += [(*at, *r) for r in walk(members, succ, price)]
        yield pd.DataFrame(rows, columns=["graph_id", "component", *names])

    return own.unionByName(out).repartition("graph_id", "component").mapInPandas(task, f"graph_id long, component long, {fields}")


def _predecessors(members: list[int], succ: Graph) -> Graph:
    pred: Graph = {v: [] for v in members}
    for v in members:
        for w in succ[v]:
            pred[w].append(v)
    return pred


def _depth_first(members: list[int], succ: Graph, _: dict[int, float]) -> Iterator[tuple[int, int]]:
    pred = _predecessors(members, succ)
    done: list[int] = []
    seen: set[int] = set()
    for source in (v for v in reversed(members) if not pred[v]):
        seen.add(source)
        stack = [(source, iter(reversed(succ[source])))]
        while stack:
            v, left = stack[-1]
            for w in left:
                if w not in seen:
                    seen.add(w)
                    stack.append((w, iter(reversed(succ[w]))))
                    break
            else:
                done.append(v)
                stack.pop()
    for pos, v in enumerate(reversed(done)):
        yield v, pos


def depth_first_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, component, node, pos): reversed post order, sources and successors by falling number; topological."""
    return _by_component(edges, nodes, _depth_first, "node long, pos long")


def capped_trees(edges: DataFrame, nodes: DataFrame, most: int, breadth_first: bool = False) -> DataFrame:
    """(graph_id, node, group): groups of trees of at most ``most`` nodes.

    From the last node down, a group takes in predecessors whose only successor is inside, until it is full.
    Depth-first by default; breadth-first a group also closes when it meets a predecessor with several successors.
    A group never leaves the tree of its nodes' only successors (``grouping.trees``), so these trees are the units of
    work, spread over the tasks: of a component only edges to an only successor and a mark of the others are kept.
    """
    outs = edges.groupBy("graph_id", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outs"), F.max("dst").alias("up"))
    links = cut(outs.select("graph_id", "node", F.when(F.col("outs") == 1, F.col("up")).alias("up")))
    shared = skew_join(edges, links.filter("up is null").select("graph_id", F.col("node").alias("src")), ["graph_id", "src"], "left_semi").select("graph_id", F.col("dst").alias("node"), F.lit(True).alias("closing")).distinct()
    own = trees(edges, nodes).withColumnRenamed("group", "tree").join(links, ["graph_id", "node"], "left").join(shared, ["graph_id", "node"], "left")

    def fill(members: list[int], below: Graph, closing: set[int]) -> Iterator[tuple[int, int]]:
        group: dict[int, int] = {}
        for top in reversed(members):
            if top in group:
                continue
            group[top], size, open_, closed = top, 1, deque([top]), False
            while open_ and not closed:
                v = open_.popleft() if breadth_first else open_.pop()
                closed = breadth_first and v in closing
                for u in below.get(v, ()):
                    if u not in group and size < most:
                        group[u], size = top, size + 1
                        open_.append(u)
        yield from group.items()

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [b for b in batches if len(b)]
        if not kept:
            return
        pdf = pd.concat(kept, ignore_index=True).sort_values(["graph_id", "tree", "node"])
        graph, tree, node = pdf["graph_id"].to_numpy(), pdf["tree"].to_numpy(), pdf["node"].tolist()
        inner, up, closing = pdf["up"].notna().tolist(), pdf["up"].tolist(), pdf["closing"].notna().tolist()
        starts = np.flatnonzero(np.append(True, (np.diff(graph) != 0) | (np.diff(tree) != 0))).tolist()
        rows: list[tuple[int, int, int]] = []
        for lo, hi in zip(starts, [*starts[1:], len(node)]):
            below: Graph = {}
            for i in range(lo, hi):
                if inner[i]:
                    below.setdefault(int(up[i]), []).append(node[i])
            g = int(graph[lo])
            rows += [(g, *r) for r in fill(node[lo:hi], below, {node[i] for i in range(lo, hi) if closing[i]})]
        yield pd.DataFrame(rows, columns=["graph_id", "node", "group"])

    return own.select("graph_id", "tree", "node", "up", "closing").repartition("graph_id", "tree").mapInPandas(task, "graph_id long, node long, group long")


def greedy_runs(edges: DataFrame, nodes: DataFrame, window: int, max_task_rows: int = 400_000) -> DataFrame:
    """(graph_id, node, group): a group grows from its head while the nearest pending successor is the next number.

    At most ``window`` successors are pending at a time, so of each node only the nearest ``window`` are read. A node
    without a predecessor or without the number before it begins a group, whatever came before: the stretches
    between such nodes are spread over the tasks. A stretch longer than ``max_task_rows`` is taken in ranges of nodes,
    which hand on their last head and what is pending.
    """
    near = edges.withColumn("rn", F.row_number().over(W.partitionBy("graph_id", "src").orderBy("dst"))).filter(F.col("rn") <= window)
    ahead = near.groupBy("graph_id", F.col("src").alias("node")).agg(F.collect_list("dst").alias("ahead"))
    before = nodes.select("graph_id", (F.col("node") + 1).alias("node"), F.lit(True).alias("follows"))
    joins = edges.select("graph_id", F.col("dst").alias("node")).distinct().join(before, ["graph_id", "node"])
    stretch = islands(nodes.join(joins, ["graph_id", "node"], "left").withColumnRenamed("follows", "joins")).withColumnRenamed("group", "stretch")
    work = cut(stretch.join(ahead, ["graph_id", "node"], "left").select("graph_id", "stretch", "node", "ahead", F.lit(None).cast("long").alias("head")))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [b for b in batches if len(b)]
        if not kept:
            return
        pdf = pd.concat(kept, ignore_index=True).sort_values(["graph_id", "stretch", "node"])
        rows: list[list] = []
        at, head, last, pending = None, None, None, set()
        for g, s, v, succ, known in zip(pdf["graph_id"].tolist(), pdf["stretch"].tolist(), pdf["node"].tolist(), pdf["ahead"], pdf["head"].tolist()):
            if at != (g, s):
                if rows:
                    rows[-1][4] = sorted(pending)
                at, head, last, pending = (g, s), None, None, set()
            succ = set() if succ is None else set(succ)
            if known == known and known is not None:  # what the range before handed on
                head, last, pending = int(known), v, succ
                continue
            if last is not None and v == last + 1 and v in pending:
                pending = set(sorted((pending | succ) - {v})[:window])
            else:
                head, pending = v, succ
            last = v
            rows.append([g, s, v, head, None])
        if rows:
            rows[-1][4] = sorted(pending)
        yield pd.DataFrame(rows, columns=["graph_id", "stretch", "node", "group", "ahead"])

    schema = "graph_id long, stretch long, node long, group long, ahead array<long>"
    giants = cut(work.groupBy("graph_id", "stretch").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > max_task_rows).select("graph_id", "stretch"))  # at most rows / max_task_rows
    none = giants.isEmpty()
    whole = work if none else skew_join(work, giants, ["graph_id", "stretch"], "left_anti")
    found = whole.repartition("graph_id", "stretch").mapInPandas(task, schema).select("graph_id", "node", "group")
    if none:
        return found
    # numbers of a stretch follow each other, so ranges need no counting
    ranged = skew_join(work, giants, ["graph_id", "stretch"], "left_semi").withColumn("range", F.floor((F.col("node") - F.col("stretch")) / max_task_rows).cast("int"))
    placed = cut(ranged, ["range"])
    handed = None
    for k in range(placed.agg(F.max("range")).first()[0] + 1):
        now = placed.filter(F.col("range") == k).drop("range")
        if handed is not None:
            now = now.unionByName(handed)
        done = cut(now.repartition("graph_id", "stretch").mapInPandas(task, schema))
        handed = done.filter("ahead is not null").select("graph_id", "stretch", "node", "ahead", F.col("group").alias("head"))
        found = found.unionByName(done.select("graph_id", "node", "group"))
    return found


def breadth_first_parts(edges: DataFrame, nodes: DataFrame, weight: float, costs: DataFrame | None = None) -> DataFrame:
    """(graph_id, component, node, part): parts grown breadth-first, over edges either way, up to ``weight``."""

    def walk(members: list[int], succ: Graph, price: dict[int, float]) -> Iterator[tuple[int, int]]:
        pred, part, k, held = _predecessors(members, succ), {}, 0, 0.0
        for start in members:
            if start in part:
                continue
            queue = deque([start])
            while queue:
                v = queue.popleft()
                if v in part:
                    continue
                if held and held + price[v] > weight:
                    k, held = k + 1, 0.0
                part[v], held = k, held + price[v]
                queue.extend(w for w in sorted(succ[v] + pred[v]) if w not in part)
        yield from part.items()

    return _by_component(edges, nodes, walk, "node long, part long", costs)

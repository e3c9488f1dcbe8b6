"""Parent links to whole hierarchies: root, depth, path and descendants of every node, and the nodes no root reaches.

A link table is a functional graph: every node has one parent or none, so each connected
component has exactly one top, which is a root, a node whose parent is missing, or a cycle.
Connected components come first; each is then co-located and walked depth-first with node colouring.

* Graphs that fit a task (``max_task_rows``) are co-located whole, many to a task: their components are found
  there and walked one after another.
* Of a larger graph, blocks of node numbers are labelled in cells, and the labels that links between
  cells tie together are united by ``least_labels``; its components are then co-located one by one.
* Only a component that is itself larger than a task is cut into cells once more: each is walked the same
  way, which shrinks it to its entry links; these few links are resolved between cells by pointer
  jumping, and every node takes the answer of its cell's top.

No task ever holds more than about ``max_task_rows`` rows, whatever the shape of the trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelweave.operators.cells import least_labels
from levelweave.plans.running import running_sums
from levelweave.plans.skew import skew_join
from levelweave.plans.storage import Cut, cut

MAX_TASK_ROWS = 500_000
ROOTED, CYCLE, UNDER, LOST = 0, 1, 2, 3
BLOCK = 4096
#: Node numbers in one record batch of paths that a task sends back.
PATH_VALUES = 1_000_000


def walk(parent: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Depth-first walks up the links, with colours; ``parent`` holds positions, -1 at a top.

    Gives for each node its state (ROOTED, CYCLE, UNDER), its top (for the last two the
    cycle node at which its links enter the cycle) and its distance from there.
    """
    n = len(parent)
    colour, state, top, depth = bytearray(n), [ROOTED] * n, [0] * n, [0] * n
    for start in range(n):
        if colour[start]:
            continue
        trail, v = [], start
        while v >= 0 and not colour[v]:
            colour[v] = 1  # grey: on the trail
            trail.append(v)
            v = parent[v]
        if v < 0:
            v = trail.pop()
            top[v], colour[v] = v, 2
        elif colour[v] == 1:  # a back edge closes a cycle
            while True:
                u = trail.pop()
                state[u], top[u], colour[u] = CYCLE, u, 2
                if u == v:
                    break
        s, t, d = UNDER if state[v] else ROOTED, top[v], depth[v]
        while trail:
            u = trail.pop()
            d += 1
            state[u], top[u], depth[u], colour[u] = s, t, d, 2
    return state, top, depth


def forest_components(up: np.ndarray) -> np.ndarray:
    """A key of its connected component for every node, from positions of parents (-1 at a top), by pointer doubling.

    After n steps up a node is at its root or somewhere on its cycle; the least position met from there on names both.
    """
    at = np.where(up < 0, np.arange(len(up)), up)
    least = np.minimum(np.arange(len(up)), at)
    for _ in range(max(1, len(up)).bit_length()):
        least = np.minimum(least, least[at])
        at = at[at]
    return least[at]


def _names(key: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The least node number of each node's component."""
    least = np.full(len(key), np.iinfo(np.int64).max)
    np.minimum.at(least, key, node)
    return least[key]


def _positions(group: np.ndarray, node: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Where each (group, parent) stands among the rows sorted by (group, node); -1: nowhere."""
    _, g = np.unique(group, return_inverse=True)
    names, code = np.unique(np.concatenate([node, parent]), return_inverse=True)
    own = g.astype(np.int64) * len(names) + code[: len(node)]
    wanted = g.astype(np.int64) * len(names) + code[len(node) :]
    at = np.searchsorted(own, wanted)
    at[at == len(own)] = 0
    return np.where(own[at] == wanted, at, -1) if len(own) else at


def _gather(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept).sort_by([("g", "ascending"), ("node", "ascending")]) if kept else None


def _walk_task(paths: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _gather(batches)
        if table is None:
            return
        g, node = table["g"].to_numpy(), table["node"].to_numpy()
        isroot = table["parent"].is_null().to_numpy()
        parent = table["parent"].fill_null(0).to_numpy()
        up = np.where(isroot, -1, _positions(g, node, parent))
        key = forest_components(up)
        if "component" in table.column_names:
            component = table["component"].to_numpy()
        else:
            component = _names(key, node)
        by = np.argsort(key, kind="stable")  # component after component
        place = np.empty_like(by)
        place[by] = np.arange(len(by))
        g, node, isroot, parent, component = g[by], node[by], isroot[by], parent[by], component[by]
        up = np.where(up[by] < 0, -1, place[up[by]])
        state, top, depth = (np.array(x, dtype=np.int64) for x in walk(up.tolist()))
        lost = (~isroot[top]) & (state == ROOTED)
        state[lost] = LOST
        leave = np.where(lost, parent[top], 0)
        offsets = np.concatenate([[0], np.cumsum(depth + 1)])
        begin = 0
        while begin < len(node):
            end = begin + 1 if not paths else max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + PATH_VALUES)) - 1)
            if not paths:
                end = len(node)
            part = slice(begin, end)
            columns = {
                "g": pa.array(g[part]),
                "node": pa.array(node[part]),
                "parent": pa.array(parent[part], mask=isroot[part]),
                "component": pa.array(component[part]),
                "state": pa.array(state[part].astype(np.int8)),
                "top": pa.array(node[top[part]]),
                "ldepth": pa.array(depth[part]),
                "leave": pa.array(leave[part], mask=~lost[part]),
            }
            if paths:
                base = offsets[begin:end] - offsets[begin]
                flat = np.empty(int(offsets[end] - offsets[begin]), dtype=np.int64)
                cur, left, at = np.arange(begin, end), depth[part].copy(), base + depth[part]
                while len(cur):
                    flat[at] = node[cur]
                    go = left > 0
                    cur, left, at = up[cur[go]], left[go] - 1, at[go] - 1
                columns["lpath"] = pa.ListArray.from_arrays(pa.array(np.append(base, len(flat)).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_pydict(columns)
            begin = end

    return task


def _label_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a cell with the least node of their component within it, and whether their link leaves the cell."""
    table = _gather(batches)
    if table is None:
        return
    g, node = table["g"].to_numpy(), table["node"].to_numpy()
    isroot = table["parent"].is_null().to_numpy()
    found = _positions(g, node, table["parent"].fill_null(0).to_numpy())
    label = _names(forest_components(np.where(isroot, -1, found)), node)
    out = table.append_column("label", pa.array(label)).append_column("leaves", pa.array(~isroot & (found < 0)))
    yield from out.select(["g", "node", "parent", "cell", "label", "leaves"]).to_batches()


def _mark_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes between a marked node and the top of its cell, both included."""
    table = _gather(batches)
    if table is None:
        return
    g, node = table["g"].to_numpy(), table["node"].to_numpy()
    isroot = table["parent"].is_null().to_numpy()
    up = np.where(isroot, -1, _positions(g, node, table["parent"].fill_null(0).to_numpy())).tolist()
    seen = np.zeros(len(node), dtype=bool)
    for v in np.flatnonzero(table["marked"].to_numpy(zero_copy_only=False)).tolist():
        while v >= 0 and not seen[v]:
            seen[v] = True
            v = up[v]
    yield pa.RecordBatch.from_pydict({"g": pa.array(g[seen]), "node": pa.array(node[seen])})


def _jump(links: DataFrame, paths: bool) -> DataFrame:
    """Pointer jumping over (g, x, nxt, plus, done, root[, before]): doubles every open link until none moves.

    ``done`` is a state, or null while ``nxt`` names another link. Links that stay open lie on or
    under cycles: by then every later jump maps the set of targets onto itself, and
    these targets are the links on cycles.
    """
    now, open_before, targets_before, only_cycles = Cut(links), None, None, False
    while True:
        open_links = now.df.filter(F.col("done").isNull())
        n_open = open_links.count()
        n_targets = open_links.select("g", "nxt").distinct().count() if only_cycles else None
        if n_open == 0 or (only_cycles and n_targets == targets_before):
            break
        only_cycles = only_cycles or n_open == open_before
        open_before, targets_before = n_open, n_targets
        nxt = now.df.select("g", F.col("x").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("plus").alias("plus2"), F.col("done").alias("done2"), F.col("root").alias("root2"), *([F.col("before").alias("before2")] if paths else []))
        moved = open_links.join(nxt, ["g", "nxt"]).select(
            "g", "x", F.col("nxt2").alias("nxt"), (F.when(F.lit(only_cycles), F.lit(0)).otherwise(F.col("plus") + F.col("plus2"))).cast("long").alias("plus"), F.col("done2").alias("done"), F.col("root2").alias("root"),
            *([F.when(F.lit(only_cycles), F.array().cast("array<long>")).otherwise(F.concat("before2", "before")).alias("before")] if paths else []),
        )
        after = Cut(now.df.filter(F.col("done").isNotNull()).unionByName(moved))
        now.drop()
        now = after
    if n_open == 0:
        return now.df.withColumn("on_cycle", F.lit(False))
    ring = now.df.filter(F.col("done").isNull()).select("g", F.col("nxt").alias("x")).distinct().withColumn("ring", F.lit(True))
    return now.df.join(ring, ["g", "x"], "left").withColumn("on_cycle", F.coalesce("ring", F.lit(False))).drop("ring")


def _components(large: DataFrame, tasks: int) -> DataFrame:
    """(g, node, parent, cell, component) of the rows of graphs that don't fit a task; components are named by their least node."""
    local = cut(large.repartition(tasks, "g", "cell").mapInArrow(_label_task, "g long, node long, parent long, cell int, label long, leaves boolean"))
    ends = local.filter("leaves").select("g", F.col("label").alias("a"), F.col("parent").alias("at"))
    ties = skew_join(ends, local.select("g", F.col("node").alias("at"), F.col("label").alias("b")), ["g", "at"])
    names = least_labels(ties.select("g", F.lit(0).alias("k"), "a", "b").distinct()).select("g", F.col("a").alias("label"), "least")
    return cut(skew_join(local, names, ["g", "label"], "left").select("g", "node", "parent", "cell", F.coalesce("least", "label").alias("component")))


def _rooted(df: DataFrame) -> DataFrame:
    return df.withColumn("root", F.when(F.col("state") == ROOTED, F.col("top"))).withColumn("depth", F.when(F.col("state") == ROOTED, F.col("ldepth")))


def hierarchy(rows: DataFrame, *, group: str = "graph_id", node: str = "node", parent: str = "parent", order: str | None = "loaded_at", root_values: tuple[int, ...] = (-1,), paths: bool = True, max_task_rows: int = MAX_TASK_ROWS) -> DataFrame:
    """One row per node of a table of parent links, with what its links lead to.

    Columns: ``group``, ``node``, ``parent`` (null at roots), ``component`` (least node of its connected
    component), ``root`` and ``depth`` (null where no root is reached), ``fault`` (null, ``cycle``, ``under_cycle``
    or ``orphan``), ``top`` (component's root; the node whose parent is missing; on or under a cycle a node of that
    cycle) and, with ``paths``, ``path`` from the top down to the node (of a node on a cycle in one cell: itself).

    Repeated rows of a node count once, the latest by ``order`` (ties: the greatest parent).
    A null group is a group; rows without a node number name no node and are left out;
    a parent that is null or one of ``root_values`` marks a root; a node that is its own parent is a cycle.
    Other columns are ignored. An empty table gives an empty result.
    """
    src = rows.select(F.col(group).cast("long").alias("g"), F.col(node).cast("long").alias("node"), F.when(~F.col(parent).isin(*root_values), F.col(parent).cast("long")).alias("parent"), (F.col(order) if order else F.lit(0)).alias("o"))
    links = src.filter(F.col("node").isNotNull()).groupBy("g", "node").agg(F.max(F.struct("o", "parent")).alias("m")).select(F.coalesce("g", F.lit(-(2**63))).alias("g"), "node", F.col("m.parent").alias("parent"))
    links = cut(links)
    sizes = links.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    large = cut(sizes.filter(F.col("size") > max_task_rows).select("g", F.ceil(F.col("size") / (max_task_rows / 2)).cast("int").alias("cells")))  # at most rows / max_task_rows groups
    total = links.count()
    tasks = max(2, math.ceil(total / (max_task_rows / 2)), min(total // 2000, links.sparkSession.sparkContext.defaultParallelism))
    schema = "g long, node long, parent long, component long, state tinyint, top long, ldepth long, leave long" + (", lpath array<long>" if paths else "")
    if large.isEmpty():
        return _named(_rooted(links.repartition(tasks, "g").mapInArrow(_walk_task(paths), schema)), group, node, parent, paths)

    cell = F.pmod(F.xxhash64(F.floor(F.col("node") / BLOCK)), F.col("cells")).cast("int")
    small = skew_join(links, large.select("g"), ["g"], "left_anti").repartition(tasks, "g").mapInArrow(_walk_task(paths), schema)
    labelled = _components(skew_join(links, large, ["g"]).withColumn("cell", cell).drop("cells"), tasks)
    giants = cut(labelled.groupBy("g", "component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > max_task_rows).select("g", "component"))  # at most rows / max_task_rows components
    whole = skew_join(labelled, giants, ["g", "component"], "left_anti").drop("cell").repartition(tasks, "g", "component").mapInArrow(_walk_task(paths), schema)
    done = _rooted(small.unionByName(whole))
    if giants.isEmpty():
        return _named(done, group, node, parent, paths)

    spread = cut(skew_join(labelled, giants, ["g", "component"], "left_semi"))
    big = cut(spread.repartition(tasks, "g", "cell").drop("cell").mapInArrow(_walk_task(paths), schema))
    exits = big.filter((F.col("state") == LOST) & (F.col("node") == F.col("top"))).select("g", F.col("node").alias("x"), F.col("leave").alias("at"))
    inside = big.select("g", F.col("node").alias("at"), F.col("state").alias("s"), F.col("top").alias("t"), (F.col("ldepth") + 1).alias("plus"), *([F.col("lpath").alias("before")] if paths else []))
    step = cut(skew_join(exits, inside, ["g", "at"], "left"))
    links2 = step.select(
        "g", "x", F.coalesce("t", "x").alias("nxt"), F.coalesce("plus", F.lit(0)).alias("plus"),
        F.when(F.col("s").isNull(), F.lit(LOST)).when(F.col("s") == CYCLE, F.lit(UNDER)).when(F.col("s") != LOST, F.col("s")).cast("int").alias("done"),
        F.coalesce("t", "x").alias("root"), *([F.coalesce("before", F.array().cast("array<long>")).alias("before")] if paths else []),
    )
    far = cut(_jump(links2, paths))
    ringed = far.filter("on_cycle")
    answer = far.select("g", F.col("x").alias("top"), F.when(F.col("done").isNull(), F.lit(UNDER)).otherwise(F.col("done")).alias("fstate"), F.when(F.col("done").isNull(), F.col("nxt")).otherwise(F.col("root")).alias("ftop"), F.col("plus").alias("fplus"), *(["before"] if paths else []))
    joined = skew_join(big, answer, ["g", "top"], "left")
    lost = F.col("state") == LOST
    solved = joined.select(
        "g", "node", "parent", "component", F.when(lost, F.col("fstate")).otherwise(F.col("state")).cast("tinyint").alias("state"), F.when(lost, F.col("ftop")).otherwise(F.col("top")).alias("top"),
        (F.col("ldepth") + F.when(lost, F.col("fplus")).otherwise(F.lit(0))).alias("ldepth"), *([F.when(lost, F.concat("before", "lpath")).otherwise(F.col("lpath")).alias("lpath")] if paths else []),
    )
    if not ringed.isEmpty():
        entered = skew_join(step, ringed.select("g", "x"), ["g", "x"], "left_semi").select("g", F.col("at").alias("node")).distinct().withColumn("hit", F.lit(True))
        marks = skew_join(spread, entered, ["g", "node"], "left").select("g", "node", "parent", "cell", F.coalesce("hit", F.lit(False)).alias("marked"))
        on = marks.repartition(tasks, "g", "cell").drop("cell").mapInArrow(_mark_task, "g long, node long").withColumn("on", F.lit(True))
        solved = solved.join(on, ["g", "node"], "left").withColumn("state", F.when(F.col("on") & (F.col("state") == UNDER), F.lit(CYCLE)).otherwise(F.col("state")).cast("tinyint")).drop("on")
    return _named(done.drop("leave").unionByName(_rooted(solved)), group, node, parent, paths)


def _named(df: DataFrame, group: str, node: str, parent: str, paths: bool) -> DataFrame:
    fault = F.when(F.col("state") == CYCLE, "cycle").when(F.col("state") == UNDER, "under_cycle").when(F.col("state") == LOST, "orphan")
    return df.select(F.when(F.col("g") != -(2**63), F.col("g")).alias(group), F.col("node").alias(node), F.col("parent").alias(parent), "component", "root", "depth", fault.alias("fault"), "top", *([F.col("lpath").alias("path")] if paths else []))


def descendants(nodes: DataFrame, *, group: str = "graph_id", node: str = "node") -> DataFrame:
    """(group, ancestor, descendant, distance) for every node below another, from ``hierarchy`` with paths.

    The path of a node holds its ancestors, so the pairs come out of one explode, without a join.
    """
    last = F.size("path") - 1
    return nodes.select(group, F.col(node).alias("descendant"), F.posexplode(F.slice("path", 1, last)).alias("at", "ancestor"), last.alias("last")).select(group, "ancestor", "descendant", (F.col("last") - F.col("at")).alias("distance"))


def cycles(nodes: DataFrame, *, group: str = "graph_id", node: str = "node", parent: str = "parent") -> DataFrame:
    """(group, cycle, node, parent, length) of every node on a cycle, from ``hierarchy``: its links, the cycle named by its least node.

    A component has one top, so one cycle at most: the nodes of a component that are on a cycle are that cycle.
    """
    on = nodes.filter(F.col("fault") == "cycle").select(group, "component", node, parent)
    per = on.groupBy(group, "component").agg(F.min(node).alias("cycle"), F.count(F.lit(1)).alias("length")).select(F.col(group).alias("_g"), F.col("component").alias("_c"), "cycle", "length")
    return on.join(per, F.col(group).eqNullSafe(F.col("_g")) & (F.col("component") == F.col("_c"))).select(group, "cycle", node, parent, "length")


def _figures_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = _gather(batches)
    if table is None:
        return
    g, node = table["g"].to_numpy(), table["node"].to_numpy()
    isroot = table["parent"].is_null().to_numpy()
    up = np.where(isroot, -1, _positions(g, node, table["parent"].fill_null(0).to_numpy()))
    depth, rank = table["depth"].to_numpy(), table["rank"].to_numpy()
    size, height, cost, above = [1] * len(node), [0] * len(node), table["cost"].to_pylist(), up.tolist()
    down = np.argsort(depth, kind="stable")
    for v in down[::-1].tolist():
        p = above[v]
        if p >= 0:
            size[p] += size[v]
            cost[p] += cost[v]
            if height[v] >= height[p]:
                height[p] = height[v] + 1
    sizes = np.array(size, dtype=np.int64)
    order = np.lexsort((node, rank, up))
    held = np.cumsum(sizes[order]) - sizes[order]
    first = np.flatnonzero(np.diff(up[order], prepend=-2))
    before = np.empty(len(node), dtype=np.int64)
    before[order] = held - np.repeat(held[first], np.diff(np.append(first, len(order))))
    start = before.tolist()
    for v in down.tolist():
        p = above[v]
        start[v] = start[v] + start[p] if p >= 0 else 0
    yield pa.RecordBatch.from_pydict({"g": pa.array(g), "node": pa.array(node), "root": table["root"].combine_chunks(), "size": pa.array(sizes), "height": pa.array(height, pa.int64()), "cost": pa.array(cost, pa.float64()), "place": pa.array(np.array(start, dtype=np.int64) + sizes - 1)})


def _doubled(rows: DataFrame) -> DataFrame:
    """(g, node, root, size, height, cost, place) of trees of any size, by doubling: after k rounds a node knows all below it nearer than 2^k.

    What lies between 2^k and 2^(k+1) below a node is near the nodes 2^k below it, so a
    round is one sum by the ancestor 2^k up and one join to it; rounds are the logarithm of the depth.
    """
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    base = rows.select("g", "node", "parent", "root", "rank")
    now = Cut(rows.select("g", "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("height"), "cost"))
    for k in range(int(deepest).bit_length()):
        below = now.df.filter("up is not null").groupBy("g", F.col("up").alias("node")).agg(F.sum("size").alias("s"), F.max("height").alias("h"), F.sum("cost").alias("c"))
        far = now.df.select("g", F.col("node").alias("up"), F.col("up").alias("next"))
        moved = skew_join(now.df, far, ["g", "up"], "left").join(below, ["g", "node"], "left")
        after = Cut(moved.select("g", "node", F.col("next").alias("up"), (F.col("size") + F.coalesce("s", F.lit(0))).alias("size"), F.greatest("height", F.col("h") + 2**k).alias("height"), (F.col("cost") + F.coalesce("c", F.lit(0.0))).alias("cost")))
        now.drop()
        now = after
    sizes = now.df.drop("up")
    siblings = base.join(sizes.select("g", "node", "size"), ["g", "node"])
    before = running_sums(siblings, ["g", "parent"], ["rank", "node"], "size")
    at = Cut(before.select("g", "node", "root", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.col("running") - F.col("size")).cast("long").alias("start")))
    for _ in range(int(deepest).bit_length()):
        far = at.df.select("g", F.col("node").alias("up"), F.col("up").alias("next"), F.col("start").alias("more"))
        after = Cut(skew_join(at.df, far, ["g", "up"], "left").select("g", "node", "root", F.col("next").alias("up"), (F.col("start") + F.coalesce("more", F.lit(0))).alias("start")))
        at.drop()
        at = after
    return sizes.join(at.df.select("g", "node", "root", "start"), ["g", "node"]).select("g", "node", "root", "size", "height", "cost", (F.col("start") + F.col("size") - 1).alias("place"))


def figures(nodes: DataFrame, *, group: str = "graph_id", node: str = "node", parent: str = "parent", cost: str | None = None, rank: str | None = None, max_task_rows: int = MAX_TASK_ROWS) -> DataFrame:
    """What lies below every node of the trees of a ``hierarchy`` (nodes with a fault are left out), in linear work.

    Columns: ``group``, ``node``, ``root``, ``descendants`` (nodes below), ``height`` (links to the deepest of them), ``cost`` (sum
    of column ``cost``, or of 1, over the node and all below), ``place`` (place in its tree's post order, from 0; children by
    ``rank``, if given, then number). Null costs and ranks are 0. No path or pair of nodes is made: a component is summed
    in one task from its deepest nodes up; one larger than a task by doubling.
    """
    null = -(2**63)
    slim = nodes.filter(F.col("fault").isNull()).select(
        F.coalesce(F.col(group), F.lit(null)).alias("g"), F.col(node).alias("node"), F.col(parent).alias("parent"), "component", "root", "depth",
        (F.coalesce(F.col(cost).cast("double"), F.lit(0.0)) if cost else F.lit(1.0)).alias("cost"), (F.coalesce(F.col(rank).cast("double"), F.lit(0.0)) if rank else F.lit(0.0)).alias("rank"),
    )
    slim = cut(slim)
    sizes = slim.groupBy("g", "component").agg(F.count(F.lit(1)).alias("size"))
    giants = cut(sizes.filter(F.col("size") > max_task_rows).select("g", "component"))  # at most rows / max_task_rows
    total = slim.count()
    tasks = max(2, math.ceil(total / (max_task_rows / 2)), min(total // 2000, slim.sparkSession.sparkContext.defaultParallelism))
    schema = "g long, node long, root long, size long, height long, cost double, place long"
    none = giants.isEmpty()
    whole = slim if none else skew_join(slim, giants, ["g", "component"], "left_anti")
    out = whole.repartition(tasks, "g", "component").select("g", "node", "parent", "root", "depth", "cost", "rank").mapInArrow(_figures_task, schema)
    if not none:
        out = out.unionByName(_doubled(cut(skew_join(slim, giants, ["g", "component"], "left_semi"))))
    return out.select(F.when(F.col("g") != null, F.col("g")).alias(group), F.col("node").alias(node), "root", (F.col("size") - 1).alias("descendants"), "height", "cost", "place")

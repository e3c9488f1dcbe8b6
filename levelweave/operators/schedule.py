"""Schedules: levels of independent parts, from windows of levels, their components and a packing."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from levelweave.operators.cells import components
from levelweave.operators.levels import histogram
from levelweave.plans.running import running_sums
from levelweave.plans.skew import skew_join
from levelweave.plans.storage import cut

#: Divergence below which a window of levels still counts as balanced.
BALANCED = 0.003


def coarsening(entries: DataFrame) -> DataFrame:
    """Per graph how many levels to merge: none below 10 entries a node, 6 below 100, else 9."""
    size = entries.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nnz"), F.countDistinct("col").alias("n"))
    return size.withColumn("levels", F.when(F.col("nnz") < 10 * F.col("n"), 0).when(F.col("nnz") < 100 * F.col("n"), 6).otherwise(9))


def dag_windows(levels: DataFrame, threads: int = 6, first: int = -1, every: int = 10) -> DataFrame:
    """(graph_id, window, lb, ub, parts): height cuts of a DAG.

    Graphs of at most ``first`` levels are one window. Else cuts come at ``first`` (if positive) and then
    every ``every`` levels, up to the level from which on all levels hold one node; the rest is the last
    window. ``parts`` is the width of the level before the cut, at most ``threads`` (at
    the first cut half of it), 1 for the last window. Works on the level histogram.
    """
    h = histogram(levels)
    per = h.groupBy("graph_id").agg((F.max("level") + 1).alias("height"), F.max(F.when(F.col("width") > 1, F.col("level") + 1)).alias("last"))
    last = F.coalesce("last", F.lit(0))
    start, end = F.lit(first + every), last - 1
    later = F.when(start <= end, F.sequence(start, end, F.lit(every))).otherwise(F.array().cast("array<int>"))
    cuts = F.when(F.col("height") <= first, F.array().cast("array<int>")).otherwise(F.concat(F.when((F.lit(first) > 0) & (F.lit(first) < F.col("height")), F.array(F.lit(first))).otherwise(F.array().cast("array<int>")), later))
    bounded = per.withColumn("cuts", F.filter(cuts, lambda c: (c > 0) & (c < F.col("height"))))
    ends = bounded.select("graph_id", "height", F.posexplode(F.concat("cuts", F.array("height"))).alias("window", "ub"), "cuts")
    spans = ends.withColumn("lb", F.when(F.col("window") == 0, F.lit(0)).otherwise(F.get("cuts", F.col("window") - 1)))
    width = h.select("graph_id", (F.col("level") + 1).alias("ub"), "width")
    size = F.when((F.lit(first) > 0) & (F.col("ub") == first), F.floor(F.col("width") / 2)).otherwise(F.col("width"))
    parts = F.when(F.col("ub") == F.col("height"), 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(threads), size))).cast("int")
    return spans.join(width, ["graph_id", "ub"], "left").select("graph_id", "window", "lb", "ub", parts.alias("parts"))


def _root_end_cuts(widths: list[int], parts: int, least: int, rate: int) -> list[tuple[int, int, int]]:
    """(lb, ub, parts) of one tree's windows, from its level widths."""
    height, cuts, sizes, p = len(widths), [0], [], parts
    while p > 1 and height > 2:
        narrow = next((k for k in range(height) if widths[height - 1 - k] > p), height)
        at = height - narrow - least
        if cuts[-1] < at < height:
            cuts.append(at)
            sizes.append(p)
        p //= rate
    return list(zip(cuts, [*cuts[1:], height], [*sizes, 1]))


def tree_windows(levels: DataFrame, parts: int = 8, least: int = 4, rate: int = 2) -> DataFrame:
    """(graph_id, window, lb, ub, parts): height cuts of trees, from the root end.

    For ``parts``, then ``parts / rate`` and so on, the levels at the root end that are no wider than that are skipped,
    and a cut comes ``least`` levels below. Works on the level histogram, a row for each level of a graph.
    """
    rate = rate if rate > 1 else 10

    def cuts(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _root_end_cuts(pdf.sort_values("level")["width"].tolist(), parts, least, rate)
        return pd.DataFrame([(int(pdf["graph_id"].iloc[0]), k, *w) for k, w in enumerate(found)], columns=["graph_id", "window", "lb", "ub", "parts"])

    return histogram(levels).groupBy("graph_id").applyInPandas(cuts, "graph_id long, window int, lb int, ub int, parts int")


def coarsened_tree(links: DataFrame, levels: DataFrame, costs: DataFrame | None = None, bins: int = 6, least: int = 4, rate: int = 2) -> DataFrame:
    """Load-balanced coarsening of trees: windows from the root end; what hangs together in a window is one subtree, hence one part.

    ``links`` has graph_id, node, parent; ``levels`` the height of each node above its deepest leaf.
    """
    placed = in_windows(levels, tree_windows(levels, bins, least, rate)).select("graph_id", "node", "window")
    up = links.filter(F.col("parent").isNotNull()).select("graph_id", F.col("node").alias("src"), F.col("parent").alias("dst"))
    comp, priced = window_components(up, placed, costs)
    return schedule_of(levels, comp, worst_fit(priced, bins))


def bundles(items: DataFrame, threshold: float) -> DataFrame:
    """(graph_id, pos, bundle): consecutive items, a new bundle at each multiple of ``threshold`` that their sum passes."""
    b = items.withColumn("block", F.floor(F.col("pos") / 65536))
    over = W.partitionBy("graph_id").orderBy("block")
    start = b.groupBy("graph_id", "block").agg(F.sum("weight").alias("held")).select("graph_id", "block", (F.sum("held").over(over) - F.col("held")).alias("start"))
    before = F.sum("weight").over(W.partitionBy("graph_id", "block").orderBy("pos")) - F.col("weight")
    return b.withColumn("inner", before).join(start, ["graph_id", "block"]).select("graph_id", "pos", F.floor((F.col("inner") + F.col("start")) / threshold).alias("bundle"))


def as_groups(schedule: DataFrame, groups: DataFrame) -> DataFrame:
    """A schedule of nodes as one of groups: (graph_id, level, part, node), each group once where it first runs."""
    own = schedule.join(groups, ["graph_id", "node"])
    return own.groupBy("graph_id", "group").agg(F.min(F.struct("level", "part", "node_level")).alias("at")).select("graph_id", "at.level", "at.part", "at.node_level", F.col("group").alias("node"))


def in_windows(levels: DataFrame, windows: DataFrame) -> DataFrame:
    """``levels`` with the window of each level; windows of a graph are looked up level by level."""
    by_level = windows.select("graph_id", "window", F.explode(F.sequence("lb", F.col("ub") - 1)).alias("level"))
    return levels.join(by_level, ["graph_id", "level"])


def window_components(edges: DataFrame, placed: DataFrame, costs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Components within windows: (graph_id, window, node, component), and their costs (graph_id, window, component, cost).

    ``placed`` has graph_id, node, window. Only edges with both ends in one window unite.
    """
    s = placed.select("graph_id", F.col("node").alias("src"), "window")
    t = placed.select("graph_id", F.col("node").alias("dst"), F.col("window").alias("w2"))
    inner = skew_join(skew_join(edges, s, ["graph_id", "src"]), t, ["graph_id", "dst"]).filter("window = w2").select("graph_id", "window", "src", "dst")
    comp = components(inner, placed.select("graph_id", "node", "window"), within="window")
    priced = comp.join(costs, ["graph_id", "node"], "left") if costs is not None else comp.withColumn("cost", F.lit(1).cast("double"))
    return comp, priced.groupBy("graph_id", "window", "component").agg(F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"))


def worst_fit(parts: DataFrame, bins: int, most: int = 512) -> DataFrame:
    """(graph_id, window, component, bin): parts by falling cost, each to the least loaded of ``bins`` bins.

    Ties go to the lower component and the lower bin. A window of at most ``most`` parts is packed
    exactly so. In a larger one, parts dearer than 1/(most/2) of the window (fewer than most/2)
    are packed singly and the others in most/2 bundles by hash, so one record lists at most ``most`` items.
    """
    key = ["graph_id", "window"]
    per = parts.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("total"))
    single = (F.col("n") <= most) | (F.col("cost") > F.col("total") / (most // 2))
    named = parts.join(per, key).withColumn("item", F.when(single, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(most // 2))))
    items = named.groupBy(*key, "item").agg(F.sum("cost").alias("cost"))
    listed = items.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((-F.col("cost")).alias("neg"), "item"))).alias("list"))
    empty = F.struct(F.array_repeat(F.lit(0.0), bins).alias("loads"), F.array().cast("array<int>").alias("to"))

    def put(acc: Column, x: Column) -> Column:
        at = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int")
        loads = F.transform(acc["loads"], lambda v, i: F.when(i == at - 1, v - x["neg"]).otherwise(v))
        return F.struct(loads.alias("loads"), F.concat(acc["to"], F.array(at - 1)).alias("to"))

    packed = listed.withColumn("to", F.aggregate("list", empty, put)["to"])
    where = packed.select(*key, F.explode(F.arrays_zip("list", "to")).alias("z")).select(*key, F.col("z.list.item").alias("item"), F.col("z.to").alias("bin"))
    return named.join(where, [*key, "item"]).select(*key, "component", "bin")


def partition_by_weight(items: DataFrame, parts: int) -> DataFrame:
    """(graph_id, pos, part): consecutive items into parts of about equal weight.

    An item belongs to the part in which its middle lies: the sums before it are taken per block
    of positions and over the blocks. Balanced as a greedy walk is, and parallel.
    """
    b = items.withColumn("block", F.floor(F.col("pos") / 65536))
    per = b.groupBy("graph_id", "block").agg(F.sum("weight").alias("held"))
    over = W.partitionBy("graph_id").orderBy("block")
    per = per.select("graph_id", "block", (F.sum("held").over(over) - F.col("held")).alias("start"), F.sum("held").over(W.partitionBy("graph_id")).alias("total"))
    before = F.sum("weight").over(W.partitionBy("graph_id", "block").orderBy("pos")) - F.col("weight") / 2
    middle = b.withColumn("inner", before).join(per, ["graph_id", "block"])
    share = (F.col("inner") + F.col("start")) * parts / F.col("total")
    return middle.select("graph_id", "pos", F.least(F.lit(parts - 1), F.coalesce(F.floor(share), F.lit(0))).cast("int").alias("part"))


def schedule_of(levels: DataFrame, comp: DataFrame, packed: DataFrame) -> DataFrame:
    """(graph_id, level, part, node_level, node); nodes of a part run by node_level, then number."""
    own = comp.join(packed, ["graph_id", "window", "component"])
    return own.join(levels, ["graph_id", "node"]).select("graph_id", F.col("window").cast("int").alias("level"), F.col("bin").cast("int").alias("part"), F.col("level").alias("node_level"), "node")


def coarsened(edges: DataFrame, levels: DataFrame, costs: DataFrame | None = None, bins: int = 6, first: int = -1, every: int = 10) -> DataFrame:
    """Load-balanced coarsening: height windows, their components, worst-fit packing of these into ``bins``.

    Loads start at zero in every window, and ties are broken by number, so the schedule depends on the graph alone.
    """
    placed = in_windows(levels, dag_windows(levels, bins, first, every)).select("graph_id", "node", "window")
    comp, priced = window_components(edges, placed, costs)
    return schedule_of(levels, comp, worst_fit(priced, bins))


def _chunks(costs: list[float], cores: int) -> tuple[list[int], list[float]]:
    """Consecutive components to cores: a core takes on until it has its share of what was left; the last takes the rest."""
    if len(costs) < cores:
        return list(range(len(costs))), costs + [0.0] * (cores - len(costs))
    core, loads, share, left = 0, [0.0] * cores, sum(costs) / cores, sum(costs)
    to = []
    for c in costs:
        if loads[core] >= share and core < cores - 1:
            left -= loads[core]
            core += 1
            share = left / (cores - core)
        loads[core] += c
        to.append(core)
    return to, loads


def _divergence(loads: list[float], cores: int) -> float:
    """Relative entropy of the loads to even ones; an idle core counts as unbalanced."""
    total = sum(loads)
    if not total or any(x == 0 for x in loads[:cores]):
        return math.inf
    return sum(x / total * math.log2(x / total * cores) for x in loads[:cores])


class _Window:
    """Components of the levels of a window and their costs, as levels are added."""

    def __init__(self, into: list[list[int]], cost: list[float], begin: int):
        self.into, self.cost, self.begin = into, cost, begin
        self.up: dict[int, int] = {}
        self.sums: dict[int, float] = {}

    def find(self, v: int) -> int:
        up = self.up
        while up[v] != v:
            up[v] = v = up[up[v]]
        return v

    def take(self, nodes: range) -> None:
        for v in nodes:
            self.up[v], self.sums[v] = v, self.cost[v]
            for u in self.into[v]:
                if u >= self.begin:
                    a, b = sorted((self.find(u), self.find(v)))
                    if a != b:
                        self.up[b] = a
                        self.sums[a] += self.sums.pop(b)

    def costs(self) -> list[float]:
        return [self.sums[k] for k in sorted(self.sums)]


def merge_windows(pdf: pd.DataFrame, cores: int) -> pd.DataFrame:
    """Windows and parts of one graph's levels, as far as they are given: a window takes on the next level while its divergence, summed over the tries, stays small.

    ``pdf`` has level, node, cost, src (null in a node's own row) and ``more``, whether later levels follow. A window that
    nothing has closed is then left open: its rows come back as they are, with no ``window``.
    """
    own = pdf[pdf["src"].isna()].sort_values(["level", "node"])
    at = dict(zip(own["node"], range(len(own))))
    level, cost, node = own["level"].tolist(), own["cost"].tolist(), own["node"].tolist()
    into: list[list[int]] = [[] for _ in node]
    links = pdf[pdf["src"].notna()]
    for s, t in zip(links["src"].astype("int64"), links["node"]):
        if s in at:  # else its window is closed
            into[at[t]].append(at[s])
    first = [0]
    for k in range(1, len(node)):
        if level[k] != level[k - 1]:
            first.append(k)
    first.append(len(node))
    window, part = [0] * len(node), [0] * len(node)
    lb, height, more = 0, len(first) - 1, bool(pdf["more"].iloc[0])
    while lb < height:
        grown = _Window(into, cost, first[lb])
        ub, drift, accepted, eff = lb, 0.0, lb + 1, cores
        while ub < height:
            width = first[ub + 1] - first[ub]
            if ub == lb and width < cores:
                eff = width
            elif width > eff:
                eff = cores
            grown.take(range(first[ub], first[ub + 1]))
            drift += _divergence(_chunks(grown.costs(), cores)[1], eff)
            if drift >= BALANCED:
                break
            ub += 1
            accepted = ub
        if ub == height and more:
            break
        final = _Window(into, cost, first[lb])
        final.take(range(first[lb], first[accepted]))
        core = dict(zip(sorted(final.sums), _chunks(final.costs(), cores)[0]))
        for v in range(first[lb], first[accepted]):
            window[v], part[v] = level[first[lb]], core[final.find(v)]
        lb = accepted
    closed = first[lb] if lb < height else len(node)
    done = pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "window": window[:closed], "part": part[:closed], "level": level[:closed], "node": node[:closed], "cost": cost[:closed], "src": None})
    if closed < len(node):
        left = pdf[pdf["level"] >= level[closed]]
        done = pd.concat([done, left[["graph_id", "level", "node", "cost", "src"]].assign(window=None, part=None)])
    return done.astype({"window": "Int64", "part": "Int64", "src": "Int64", "level": "int64", "node": "int64", "cost": "float64", "graph_id": "int64"})


def hybrid(edges: DataFrame, levels: DataFrame, costs: DataFrame, cores: int = 8, max_task_rows: int = 500_000) -> DataFrame:
    """Windows that grow while their components spread evenly over ``cores``: (graph_id, level, part, node_level, node).

    The rule walks the levels of a graph in order. Graphs go whole, many to a stage; one of more than ``max_task_rows``
    nodes and edges is walked in ranges of levels of about that size, the window still open at the end
    of a range going on into the next. The result does not depend on the bound; a task holds a range and that window.
    """
    own = levels.join(costs, ["graph_id", "node"], "left").select("graph_id", "node", "level", F.coalesce("cost", F.lit(1.0)).alias("cost"), F.lit(None).cast("long").alias("src"))
    of = levels.select("graph_id", F.col("node").alias("dst"), "level")
    into = skew_join(edges.select("graph_id", "src", "dst"), of, ["graph_id", "dst"]).select("graph_id", F.col("dst").alias("node"), "level", F.lit(0.0).alias("cost"), "src")
    rows = cut(own.unionByName(into))
    sizes = rows.groupBy("graph_id", "level").agg(F.count(F.lit(1)).alias("size"))
    w = W.partitionBy("graph_id")
    ranged = sizes.withColumn("range", F.floor((F.sum("size").over(w.orderBy("level")) - F.col("size")) / max_task_rows).cast("int"))
    ranged = cut(ranged.withColumn("last", F.max("range").over(w)).select("graph_id", "level", "range", "last"))  # a row for each level
    ranges = (ranged.agg(F.max("range")).first()[0] or 0) + 1
    placed = rows.join(ranged, ["graph_id", "level"])
    if ranges > 1:
        placed = cut(placed, ["range"])
    schema = "graph_id long, window long, part long, level long, node long, cost double, src long"
    names = ["graph_id", "level", "node", "cost", "src", "last"]
    out, open_rows = None, None
    lasts = ranged.groupBy("graph_id").agg(F.max("last").alias("last"))
    for k in range(ranges):
        now = placed.filter(F.col("range") == k).select(*names)
        if open_rows is not None:
            now = now.unionByName(open_rows.join(lasts, "graph_id").select(*names))
        walked = now.withColumn("more", F.col("last") > k).groupBy("graph_id").applyInPandas(lambda pdf: merge_windows(pdf, cores), schema)
        if ranges > 1:
            walked = cut(walked)
        closed = walked.filter("window is not null and src is null")
        out = closed if out is None else out.unionByName(closed)
        open_rows = walked.filter("window is null")
    out = out if ranges > 1 else cut(out)
    numbers = out.select("graph_id", "window").distinct().withColumn("number", F.row_number().over(w.orderBy("window")) - 1)
    return out.join(numbers, ["graph_id", "window"]).select("graph_id", F.col("number").cast("int").alias("level"), F.col("part").cast("int").alias("part"), F.col("level").cast("int").alias("node_level"), "node")


def ungrouped(schedule: DataFrame, groups: DataFrame) -> DataFrame:
    """A schedule of groups as one of their nodes."""
    g = groups.select("graph_id", F.col("group"), F.col("node").alias("member"))
    return schedule.withColumnRenamed("node", "group").join(g, ["graph_id", "group"]).select("graph_id", "level", "part", "node_level", F.col("member").alias("node"))


def quotient(schedule: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between the (level, part) pairs of a schedule."""
    s = schedule.select("graph_id", F.col("node").alias("src"), F.col("level").alias("src_level"), F.col("part").alias("src_part"))
    t = schedule.select("graph_id", F.col("node").alias("dst"), F.col("level").alias("dst_level"), F.col("part").alias("dst_part"))
    pairs = skew_join(skew_join(edges, s, ["graph_id", "src"]), t, ["graph_id", "dst"])
    return pairs.filter("src_level <> dst_level or src_part <> dst_part").select("graph_id", "src_level", "src_part", "dst_level", "dst_part").distinct()


def violations(schedule: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, kind, node, other): nodes not covered once, and edges that neither go to a later level nor stay in their part in order."""
    count = schedule.groupBy("graph_id", "node").agg(F.count(F.lit(1)).alias("times"))
    cover = nodes.select("graph_id", "node").join(count, ["graph_id", "node"], "full").filter("times is null or times <> 1").select("graph_id", F.lit("cover").alias("kind"), "node", F.col("times").alias("other"))
    s = schedule.select("graph_id", F.col("node").alias("src"), F.col("level").alias("sl"), F.col("part").alias("sp"), F.col("node_level").alias("sn"))
    t = schedule.select("graph_id", F.col("node").alias("dst"), F.col("level").alias("tl"), F.col("part").alias("tp"), F.col("node_level").alias("tn"))
    broken = skew_join(skew_join(edges, s, ["graph_id", "src"]), t, ["graph_id", "dst"]).filter(~((F.col("sl") < F.col("tl")) | ((F.col("sl") == F.col("tl")) & (F.col("sp") == F.col("tp")) & ((F.col("sn") < F.col("tn")) | ((F.col("sn") == F.col("tn")) & (F.col("src") < F.col("dst")))))))
    return cover.unionByName(broken.select("graph_id", F.lit("order").alias("kind"), F.col("src").alias("node"), F.col("dst").alias("other")))


def checked(schedule: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per graph its nodes, its edges, the nodes that ``schedule`` runs, and the number of ``violations``."""
    n = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"))
    m = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"))
    run = schedule.groupBy("graph_id").agg(F.countDistinct("node").alias("scheduled"))
    bad = violations(schedule, edges, nodes).groupBy("graph_id").agg(F.count(F.lit(1)).alias("violations"))
    joined = n.join(m, "graph_id", "left").join(run, "graph_id", "full").join(bad, "graph_id", "full")
    return joined.select("graph_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("nodes", "edges", "scheduled", "violations")])


def run_order(schedule: DataFrame) -> DataFrame:
    """(graph_id, node, place): the place, from 0, at which a schedule runs each node: by level, part, level in the part, number."""
    placed = running_sums(schedule.select("graph_id", "level", "part", "node_level", "node", F.lit(1).cast("long").alias("one")), ["graph_id"], ["level", "part", "node_level", "node"], "one")
    return placed.select("graph_id", "node", (F.col("running") - 1).alias("place"))


def kernel_costs(entries: DataFrame) -> DataFrame:
    """(graph_id, node, ...): cost of a node by kernel: its row or column entries, or those summed over its row or column."""
    m = entries.select("graph_id", "row", "col")
    r = m.groupBy("graph_id", F.col("row").alias("node")).agg(F.count(F.lit(1)).alias("dr"))
    c = m.groupBy("graph_id", F.col("col").alias("node")).agg(F.count(F.lit(1)).alias("dc"))
    d = cut(r.join(c, ["graph_id", "node"], "full").select("graph_id", "node", F.coalesce("dr", F.lit(0)).alias("dr"), F.coalesce("dc", F.lit(0)).alias("dc")))
    of_col = d.select("graph_id", F.col("node").alias("col"), "dr", "dc")
    over_row = skew_join(m, of_col, ["graph_id", "col"]).groupBy("graph_id", F.col("row").alias("node")).agg(F.sum("dc").alias("ic0_left"), F.sum("dr").alias("ilu0_up"))
    of_row = d.select("graph_id", F.col("node").alias("row"), "dc")
    over_col = skew_join(m, of_row, ["graph_id", "row"]).groupBy("graph_id", F.col("col").alias("node")).agg(F.sum("dc").alias("ic0_right"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return d.join(over_row, ["graph_id", "node"], "left").join(over_col, ["graph_id", "node"], "left").select("graph_id", "node", F.col("dr").alias("sptrsv_left"), F.col("dc").alias("sptrsv_right"), zero("ic0_left"), zero("ic0_right"), zero("ilu0_up"))


def group_costs(costs: DataFrame, groups: DataFrame) -> DataFrame:
    """Costs of groups: the sums over their members."""
    names = [c for c in costs.columns if c not in ("graph_id", "node")]
    return costs.join(groups, ["graph_id", "node"]).groupBy("graph_id", F.col("group").alias("node")).agg(*[F.sum(c).alias(c) for c in names])


def tiles(edges: DataFrame) -> DataFrame:
    """(graph_id, run, col, row): iterations by runs of consecutive rows, within a run by column, then row."""
    from levelweave.operators.grouping import islands

    rows = edges.select("graph_id", F.col("dst").alias("node")).distinct()
    before = rows.select("graph_id", (F.col("node") + 1).alias("node"), F.lit(True).alias("joins"))
    run = islands(rows.join(before, ["graph_id", "node"], "left")).select("graph_id", F.col("node").alias("dst"), F.col("group").alias("run"))
    return edges.join(run, ["graph_id", "dst"]).select("graph_id", "run", F.col("src").alias("col"), F.col("dst").alias("row"))

"""Queries of the matrix, graph, tree and schedule operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelweave.functions import metrics
from levelweave.model import edges, entries, is_topological, nodes
from levelweave.operators import algebra, cells, graphs, grouping, levels, schedule, solve, symbolic, trees, walks
from levelweave.operators.hierarchy import figures, hierarchy
from levelweave.plans.storage import cut
from levelweave.sources import generators, matrix_market
from levelweave.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

Q = Callable[[SparkSession, str], DataFrame]

_E = 'e AS (SELECT DISTINCT graph_id, col AS src, "row" AS dst FROM matrix WHERE "row" > col)'
_V = 'v AS (SELECT graph_id, "row" AS node FROM matrix UNION SELECT graph_id, col FROM matrix)'
_M = 'm AS (SELECT graph_id, "row", col, CASE WHEN isnan(max(val)) THEN NULL ELSE max(val) END AS val FROM matrix GROUP BY 1, 2, 3)'
_LEVEL = f"""WITH RECURSIVE {_E}, {_V},
 w AS (SELECT graph_id, node, 0 AS level FROM v UNION SELECT w.graph_id, e.dst, w.level + 1 FROM w JOIN e ON e.graph_id = w.graph_id AND e.src = w.node),
 l AS (SELECT graph_id, node, max(level) AS level FROM w GROUP BY 1, 2)"""


def query(sql: str | None = None) -> Callable[[Q], Q]:
    def add(f: Q) -> Q:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """One row per position; NaN is taken as null."""
    return entries(table(spark, d, "matrix")).withColumn("val", F.when(~F.isnan("val"), F.col("val")))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = table(spark, d, "matrix")
    return cut(edges(m)), cut(nodes(m))


# --- sources, generators, output


@query(f"""WITH {_M} SELECT graph_id, count(*) AS lines, CAST(sum(length(CAST("row" + 1 AS VARCHAR)) + length(CAST(col + 1 AS VARCHAR))) AS BIGINT) AS digits FROM m GROUP BY 1""")
def mtx_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = matrix_market.entry_lines(_entries(spark, d))
    parts = F.split("line", " ")
    return lines.groupBy("graph_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length(F.get(parts, F.lit(0))) + F.length(F.get(parts, F.lit(1)))).alias("digits"))


@query(f"""WITH {_V}, s AS (SELECT graph_id, node AS col, node + d AS "row", CASE d WHEN 0 THEN 2.0 WHEN 1 THEN -1.0 ELSE -0.5 END AS val FROM v, (SELECT unnest([-1, 0, 1]) AS d))
 SELECT graph_id, "row", col, CAST(val AS DOUBLE) AS val FROM s WHERE (graph_id, "row") IN (SELECT graph_id, node FROM v)""")
def tridiagonal(spark: SparkSession, d: str) -> DataFrame:
    return generators.tridiagonal(nodes(table(spark, d, "matrix")), -1.0, 2.0, -0.5)


@query("SELECT graph_id, lower(trim(fname)) AS name, CASE field WHEN 'real' THEN 'REAL' WHEN 'integer' THEN 'INT' WHEN 'complex' THEN 'COMPLEX' WHEN 'pattern' THEN 'PATTERN' END AS type, CASE symmetry WHEN 'symmetric' THEN -1 WHEN 'general' THEN 0 END AS stype FROM graphs")
def matrix_kinds(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("field") == "real", "REAL").when(F.col("field") == "integer", "INT").when(F.col("field") == "complex", "COMPLEX").when(F.col("field") == "pattern", "PATTERN")
    shape = F.when(F.col("symmetry") == "symmetric", -1).when(F.col("symmetry") == "general", 0)
    return table(spark, d, "graphs").select("graph_id", F.lower(F.trim("fname")).alias("name"), kind.alias("type"), shape.alias("stype"))


# --- algebra


@query(f'WITH {_M} SELECT graph_id, col AS "row", "row" AS col, val FROM m')
def matrix_transpose(spark: SparkSession, d: str) -> DataFrame:
    return algebra.transpose(_entries(spark, d))


@query(f'WITH {_M} SELECT * FROM m UNION ALL SELECT graph_id, col, "row", val FROM m WHERE "row" <> col')
def matrix_full(spark: SparkSession, d: str) -> DataFrame:
    return algebra.full(_entries(spark, d))


@query(f"""WITH {_M}, f AS (SELECT * FROM m UNION ALL SELECT graph_id, col, "row", val FROM m WHERE "row" <> col) SELECT graph_id, "row", col, val FROM f WHERE "row" >= col""")
def matrix_lower_half(spark: SparkSession, d: str) -> DataFrame:
    return algebra.lower_half(algebra.full(_entries(spark, d)))


@query(f"""WITH {_M}, s AS (SELECT graph_id, "row", col, 0.5 * val AS val FROM m UNION ALL SELECT graph_id, col, "row", 0.5 * val FROM m) SELECT graph_id, "row", col, round(sum(val), 6) AS val FROM s WHERE "row" >= col GROUP BY 1, 2, 3""")
def matrix_symmetric_part(spark: SparkSession, d: str) -> DataFrame:
    return algebra.symmetric_part(_entries(spark, d)).withColumn("val", F.round("val", 6))


@query(f"""WITH {_M}, s AS (SELECT graph_id, "row", col, 2.0 * val AS val FROM m UNION ALL SELECT graph_id, col, "row", -1.0 * val FROM m) SELECT graph_id, "row", col, round(sum(val), 6) AS val FROM s GROUP BY 1, 2, 3""")
def matrix_add(spark: SparkSession, d: str) -> DataFrame:
    m = _entries(spark, d)
    return algebra.add(m, algebra.transpose(m), 2.0, -1.0).withColumn("val", F.round("val", 6))


_DEG = """k AS (SELECT v.graph_id, v.node AS old, coalesce(n, 0) AS degree FROM v LEFT JOIN (SELECT graph_id, node, count(*) AS n FROM (SELECT graph_id, "row" AS node FROM m WHERE "row" <> col UNION ALL SELECT graph_id, col FROM m WHERE "row" <> col) GROUP BY 1, 2) c ON c.graph_id = v.graph_id AND c.node = v.node),
 p AS (SELECT graph_id, old, row_number() OVER (PARTITION BY graph_id ORDER BY degree DESC, old) - 1 AS new FROM k)"""


@query(f"WITH {_M}, {_V}, {_DEG} SELECT * FROM p")
def degree_order(spark: SparkSession, d: str) -> DataFrame:
    return algebra.degree_order(_entries(spark, d))


@query(f"WITH {_M}, {_V}, {_DEG} SELECT graph_id, new AS old, old AS new FROM p")
def inverse_permutation(spark: SparkSession, d: str) -> DataFrame:
    return algebra.inverse_permutation(algebra.degree_order(_entries(spark, d)))


@query(f"WITH {_M}, {_V}, {_DEG} SELECT graph_id, count(*) AS n, count(DISTINCT new) = count(*) AND min(new) = 0 AND max(new) = count(*) - 1 AS is_permutation FROM p GROUP BY 1")
def permutation_check(spark: SparkSession, d: str) -> DataFrame:
    return algebra.is_permutation(algebra.degree_order(_entries(spark, d)))


@query(f"""WITH {_M}, {_V}, {_DEG} SELECT m.graph_id, greatest(a.new, b.new) AS "row", least(a.new, b.new) AS col, val FROM m JOIN p a ON a.graph_id = m.graph_id AND a.old = m."row" JOIN p b ON b.graph_id = m.graph_id AND b.old = m.col""")
def matrix_permuted(spark: SparkSession, d: str) -> DataFrame:
    m = _entries(spark, d)
    return algebra.permute_symmetric(m, cut(algebra.degree_order(m)))


@query(f'WITH {_M} SELECT graph_id, "row" AS node, val FROM m WHERE "row" = col')
def diagonal_entries(spark: SparkSession, d: str) -> DataFrame:
    return algebra.diagonal(_entries(spark, d))


@query(f'WITH {_M}, {_V} SELECT graph_id, node FROM v WHERE (graph_id, node) NOT IN (SELECT graph_id, col FROM m WHERE "row" = col)')
def missing_diagonals(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "matrix")
    return algebra.missing_diagonals(entries(m), nodes(m))


@query(f"WITH {_M}, {_V} SELECT graph_id, count(*) AS empty_columns FROM v WHERE (graph_id, node) NOT IN (SELECT graph_id, col FROM m) GROUP BY 1")
def empty_columns(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "matrix")
    return algebra.empty_columns(entries(m), nodes(m))


@query(f"WITH {_M} SELECT graph_id, col, count(*) AS nnz FROM m GROUP BY 1, 2")
def nnz_per_column(spark: SparkSession, d: str) -> DataFrame:
    return algebra.per_column(_entries(spark, d))


@query(f'WITH {_M} SELECT graph_id, "row", round(sum(val), 4) AS b FROM m GROUP BY 1, 2')
def row_sums(spark: SparkSession, d: str) -> DataFrame:
    return algebra.row_sums(_entries(spark, d)).withColumn("b", F.round("b", 4))


@query(f"WITH {_M} SELECT graph_id, max(abs(val)) AS norm FROM m GROUP BY 1")
def matrix_norm(spark: SparkSession, d: str) -> DataFrame:
    return algebra.norm(_entries(spark, d))


@query(f'WITH {_M}, z AS (SELECT graph_id, abs(coalesce(val, 0)) AS x FROM m WHERE "row" <> col UNION ALL SELECT graph_id, 0.0 FROM m WHERE "row" = col) SELECT graph_id, max(x) AS residual FROM z GROUP BY 1')
def matrix_residual(spark: SparkSession, d: str) -> DataFrame:
    """Difference between a matrix and its transpose."""
    m = _entries(spark, d)
    return algebra.residual(m, algebra.transpose(m))


@query(f'WITH {_M} SELECT graph_id, min(CASE WHEN val IS NULL THEN 0 ELSE 1 END) = 1 AS equal FROM m GROUP BY 1')
def matrix_equal(spark: SparkSession, d: str) -> DataFrame:
    """Twice transposed, a matrix is itself, but for entries without a value."""
    m = _entries(spark, d)
    return algebra.is_equal(m, algebra.transpose(algebra.transpose(m)))


@query('SELECT DISTINCT graph_id, "row" // 4 AS "row", col // 4 AS col FROM matrix')
def matrix_coarsened(spark: SparkSession, d: str) -> DataFrame:
    return algebra.coarsen(table(spark, d, "matrix"), 4)


@query(f"""WITH {_M}, c AS (SELECT graph_id, col, count(*) AS nnz FROM m GROUP BY 1, 2),
 s AS (SELECT graph_id, (col // 4096) * 4096 AS col_lo, max(col) AS hi, CAST(sum(nnz) AS BIGINT) AS nnz FROM c GROUP BY 1, 2)
 SELECT s.graph_id, col_lo, hi - col_lo + 1 AS n, s.nnz, (SELECT string_agg(CAST(coalesce(x, 0) AS VARCHAR), ',' ORDER BY j) FROM (SELECT j, (SELECT CAST(sum(c.nnz) AS BIGINT) FROM c WHERE c.graph_id = s.graph_id AND c.col >= s.col_lo AND c.col < s.col_lo + j) AS x FROM (SELECT unnest(range(0, s.hi - s.col_lo + 2)) AS j))) AS p FROM s""")
def compressed_columns(spark: SparkSession, d: str) -> DataFrame:
    return algebra.compressed(_entries(spark, d)).withColumn("p", F.array_join(F.col("p").cast("array<string>"), ","))


@query(f"""WITH {_M}, f AS (SELECT * FROM m UNION ALL SELECT graph_id, col, "row", val FROM m WHERE "row" <> col) SELECT graph_id, "row", col, val FROM f WHERE "row" <= col""")
def matrix_upper_half(spark: SparkSession, d: str) -> DataFrame:
    return algebra.upper_half(algebra.full(_entries(spark, d)))


@query(f'WITH {_M} SELECT graph_id, "row" + 1 AS "row", col + 1 AS col, val FROM m')
def matrix_one_based(spark: SparkSession, d: str) -> DataFrame:
    return algebra.one_based(_entries(spark, d))


@query(f'WITH {_M} SELECT * FROM m WHERE val <> 0')
def matrix_non_zeros(spark: SparkSession, d: str) -> DataFrame:
    return algebra.non_zeros(_entries(spark, d))


@query(f'WITH {_M} SELECT graph_id, min(CASE WHEN "row" = col AND val IS NOT NULL THEN 1 ELSE 0 END) = 1 AS equal FROM m GROUP BY 1')
def matrix_symmetric(spark: SparkSession, d: str) -> DataFrame:
    """A lower triangle equals its transpose only if it is a diagonal whose values are all there."""
    m = _entries(spark, d)
    return algebra.is_equal(m, algebra.transpose(m))


@query(f'WITH {_M}, {_V} SELECT * FROM m UNION ALL SELECT graph_id, node, node, 1.0 FROM v WHERE (graph_id, node) NOT IN (SELECT graph_id, col FROM m WHERE "row" = col)')
def matrix_with_diagonals(spark: SparkSession, d: str) -> DataFrame:
    return algebra.with_diagonals(_entries(spark, d), nodes(table(spark, d, "matrix")), 1.0)


@query(f'WITH {_M} SELECT * FROM m WHERE val <> 0')
def supernode_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Entries packed into padded blocks of supernodes and unpacked again."""
    return grouping.unpadded(grouping.padded_blocks(_entries(spark, d), cut(grouping.supernodes(*_graph(spark, d)))))


# --- level sets


@query(_LEVEL + " SELECT graph_id, node, level FROM l")
def level_set(spark: SparkSession, d: str) -> DataFrame:
    return levels.level_sets(*_graph(spark, d))


@query(_LEVEL + " SELECT graph_id, level, count(*) AS width FROM l GROUP BY 1, 2")
def level_histogram(spark: SparkSession, d: str) -> DataFrame:
    return levels.histogram(levels.level_sets(*_graph(spark, d)))


@query(f"""WITH RECURSIVE {_E}, {_V}, w AS (SELECT graph_id, node, 0 AS depth FROM v UNION SELECT w.graph_id, e.src, w.depth + 1 FROM w JOIN e ON e.graph_id = w.graph_id AND e.dst = w.node) SELECT graph_id, node, max(depth) AS depth FROM w GROUP BY 1, 2""")
def depth_from_sinks(spark: SparkSession, d: str) -> DataFrame:
    return levels.depth_from_sinks(*_graph(spark, d))


@query(f"""WITH RECURSIVE {_E}, {_V}, n AS (SELECT graph_id, max(node) + 1 AS n FROM v GROUP BY 1),
 e2 AS (SELECT e.graph_id, src + q * n AS src, dst + q * n AS dst FROM e JOIN n ON n.graph_id = e.graph_id, (SELECT unnest([0, 1]) AS q) UNION ALL SELECT v.graph_id, node, node + n FROM v JOIN n ON n.graph_id = v.graph_id),
 w AS (SELECT v.graph_id, node + q * n AS node, 0 AS level FROM v JOIN n ON n.graph_id = v.graph_id, (SELECT unnest([0, 1]) AS q) UNION SELECT w.graph_id, e2.dst, w.level + 1 FROM w JOIN e2 ON e2.graph_id = w.graph_id AND e2.src = w.node) SELECT graph_id, node, max(level) AS level FROM w GROUP BY 1, 2""")
def level_set_of_copies(spark: SparkSession, d: str) -> DataFrame:
    return levels.level_sets_of_copies(*_graph(spark, d), copies=2)


_TREE = """t AS (SELECT DISTINCT graph_id, node, CASE WHEN parent = -1 THEN NULL ELSE parent END AS parent FROM tree),
 r AS (SELECT graph_id, node, parent, CAST(0 AS BIGINT) AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.graph_id, t.node, t.parent, r.depth + 1 FROM r JOIN t ON t.graph_id = r.graph_id AND t.parent = r.node)"""


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return cut(hierarchy(table(spark, d, "tree"), paths=False).filter("fault is null"))


@query(f"WITH RECURSIVE {_TREE}, a AS (SELECT graph_id, node, 0 AS level FROM r UNION SELECT a.graph_id, r.parent, a.level + 1 FROM a JOIN r ON r.graph_id = a.graph_id AND r.node = a.node WHERE r.parent IS NOT NULL) SELECT graph_id, node, max(level) AS level FROM a GROUP BY 1, 2")
def tree_levels(spark: SparkSession, d: str) -> DataFrame:
    """Level of a tree node: its height above the deepest leaf below it."""
    return figures(_tree(spark, d)).select("graph_id", "node", F.col("height").cast("int").alias("level"))


@query(f"WITH RECURSIVE {_TREE} SELECT graph_id, max(depth) AS height, count(*) AS nodes FROM r GROUP BY 1")
def tree_height(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).groupBy("graph_id").agg(F.max("depth").alias("height"), F.count(F.lit(1)).alias("nodes"))


@query(f"WITH RECURSIVE {_TREE} SELECT graph_id, parent, count(*) AS children, min(node) AS first, max(node) AS last FROM r WHERE parent IS NOT NULL GROUP BY 1, 2")
def tree_children(spark: SparkSession, d: str) -> DataFrame:
    return trees.children(_tree(spark, d))


@query(f"WITH RECURSIVE {_TREE}, a AS (SELECT graph_id, node, node AS anc FROM r UNION ALL SELECT a.graph_id, a.node, r.parent FROM a JOIN r ON r.graph_id = a.graph_id AND r.node = a.anc WHERE r.parent IS NOT NULL) SELECT graph_id, anc AS node, CAST(sum(node % 7 + 1) AS BIGINT) AS cost FROM a GROUP BY 1, 2")
def subtree_costs(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    return trees.subtree_costs(t, t.select("graph_id", "node", (F.col("node") % 7 + 1).alias("cost"))).withColumn("cost", F.col("cost").cast("long"))


@query(f"""WITH RECURSIVE {_TREE}, a AS (SELECT graph_id, node, node AS anc FROM r UNION ALL SELECT a.graph_id, a.node, r.parent FROM a JOIN r ON r.graph_id = a.graph_id AND r.node = a.anc WHERE r.parent IS NOT NULL),
 z AS (SELECT graph_id, anc AS node, count(*) AS size FROM a GROUP BY 1, 2),
 b AS (SELECT r.graph_id, r.node, coalesce(sum(size) OVER (PARTITION BY r.graph_id, parent ORDER BY r.node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r JOIN z ON z.graph_id = r.graph_id AND z.node = r.node),
 s AS (SELECT a.graph_id, a.node, sum(before) AS before FROM a JOIN b ON b.graph_id = a.graph_id AND b.node = a.anc GROUP BY 1, 2) SELECT s.graph_id, s.node, CAST(before + size - 1 AS BIGINT) AS post FROM s JOIN z ON z.graph_id = s.graph_id AND z.node = s.node""")
def tree_post_order(spark: SparkSession, d: str) -> DataFrame:
    return trees.post_order(_tree(spark, d))


@query("WITH RECURSIVE p AS (" + SQL["tree_post_order"].removeprefix("WITH RECURSIVE ").join(["WITH RECURSIVE ", ")"]) + f", {_TREE} SELECT r.graph_id, a.post AS node, b.post AS parent FROM r JOIN p a ON a.graph_id = r.graph_id AND a.node = r.node LEFT JOIN p b ON b.graph_id = r.graph_id AND b.node = r.parent")
def tree_relabelled(spark: SparkSession, d: str) -> DataFrame:
    """The tree with its nodes named by their place in the post order."""
    t = _tree(spark, d)
    return trees.relabelled(t, cut(trees.post_order(t)))


# --- symbolic factorisation


_CC = "SELECT graph_id, src AS a, dst AS b FROM e UNION SELECT graph_id, dst, src FROM e"
# L has an entry (i, j) if a way leads from j to i over nodes before j.
_FILL = f"""WITH RECURSIVE {_E}, {_V}, {_M}, u AS ({_CC}), w AS (SELECT graph_id, node AS j, node AS x FROM v UNION SELECT w.graph_id, w.j, u.b FROM w JOIN u ON u.graph_id = w.graph_id AND u.a = w.x WHERE u.b < w.j),
 f AS (SELECT DISTINCT w.graph_id, j, u.b AS i FROM w JOIN u ON u.graph_id = w.graph_id AND u.a = w.x WHERE u.b > w.j),
 k AS (SELECT v.graph_id, v.node, min(i) AS parent, count(i) + 1 AS "count" FROM v LEFT JOIN f ON f.graph_id = v.graph_id AND f.j = v.node GROUP BY 1, 2)"""


@query(_FILL + " SELECT graph_id, node, parent FROM k")
def elimination_tree(spark: SparkSession, d: str) -> DataFrame:
    return trees.elimination_tree(*_graph(spark, d))


@query(_FILL + ' SELECT graph_id, node, "count" FROM k')
def factor_column_counts(spark: SparkSession, d: str) -> DataFrame:
    e, v = _graph(spark, d)
    return symbolic.column_counts(e, symbolic.factor_tree(e, v))


@query(_FILL + ' SELECT graph_id, CAST(sum("count") AS BIGINT) AS nnz, CAST(sum("count" * "count") AS BIGINT) AS flops FROM k GROUP BY 1')
def factor_size(spark: SparkSession, d: str) -> DataFrame:
    return trees.flops(symbolic.symbolic_factor(*_graph(spark, d)))


@query(_FILL + """, c AS (SELECT graph_id, col, count(*) AS n FROM m GROUP BY 1, 2), r AS (SELECT f.graph_id, f.i AS node, sum(n) AS n FROM f JOIN c ON c.graph_id = f.graph_id AND c.col = f.j GROUP BY 1, 2)
 SELECT v.graph_id, v.node, CAST(coalesce(c.n, 0) + coalesce(r.n, 0) AS BIGINT) AS cost FROM v LEFT JOIN c ON c.graph_id = v.graph_id AND c.col = v.node LEFT JOIN r ON r.graph_id = v.graph_id AND r.node = v.node""")
def factor_row_costs(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the matrix in all columns that a row of the factor touches."""
    e, v = _graph(spark, d)
    n = algebra.per_column(_entries(spark, d)).select("graph_id", F.col("col").alias("node"), F.col("nnz").alias("weight"))
    return symbolic.reach_costs(e, symbolic.factor_tree(e, v), cut(n)).withColumn("cost", F.col("cost").cast("long"))


@query()
def symbolic_factor(spark: SparkSession, d: str) -> DataFrame:
    return symbolic.symbolic_factor(*_graph(spark, d))


# --- components


@query(f"WITH RECURSIVE {_E}, {_V}, u AS ({_CC}), w AS (SELECT graph_id, node, node AS c FROM v UNION SELECT w.graph_id, u.b, w.c FROM w JOIN u ON u.graph_id = w.graph_id AND u.a = w.node WHERE w.c < u.b) SELECT graph_id, node, min(c) AS component FROM w GROUP BY 1, 2")
def weak_components(spark: SparkSession, d: str) -> DataFrame:
    return cells.components(*_graph(spark, d))


def _windowed(spark: SparkSession, d: str, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    e, v = _graph(spark, d)
    placed = cut(levels.level_sets(e, v).withColumn("window", F.floor(F.col("level") / width)))
    return e, v, placed


_WINDOW = _LEVEL + f""", p AS (SELECT graph_id, node, level, level // 3 AS w FROM l),
 u AS (SELECT e.graph_id, e.src AS a, e.dst AS b FROM e JOIN p x ON x.graph_id = e.graph_id AND x.node = e.src JOIN p y ON y.graph_id = e.graph_id AND y.node = e.dst WHERE x.w = y.w),
 u2 AS (SELECT * FROM u UNION SELECT graph_id, b, a FROM u),
 c AS (SELECT graph_id, node, node AS c FROM v UNION SELECT c.graph_id, u2.b, c.c FROM c JOIN u2 ON u2.graph_id = c.graph_id AND u2.a = c.node),
 k AS (SELECT graph_id, node, min(c) AS component FROM c GROUP BY 1, 2)"""


@query(_WINDOW + " SELECT p.graph_id, CAST(w AS BIGINT) AS \"window\", component, CAST(count(*) AS DOUBLE) AS cost FROM p JOIN k ON k.graph_id = p.graph_id AND k.node = p.node GROUP BY 1, 2, 3")
def window_components(spark: SparkSession, d: str) -> DataFrame:
    e, _, placed = _windowed(spark, d, 3)
    return schedule.window_components(e, placed.select("graph_id", "node", "window"))[1]


# --- partitioning and grouping


@query(f"WITH {_M}, s AS (SELECT graph_id, count(*) AS nnz, count(DISTINCT col) AS n FROM m GROUP BY 1) SELECT *, CASE WHEN nnz < 10 * n THEN 0 WHEN nnz < 100 * n THEN 6 ELSE 9 END AS levels FROM s")
def level_coarsening(spark: SparkSession, d: str) -> DataFrame:
    return schedule.coarsening(_entries(spark, d))


@query(_LEVEL + """, h AS (SELECT graph_id, level, count(*) AS width FROM l GROUP BY 1, 2),
 s AS (SELECT graph_id, max(level) + 1 AS height, coalesce(max(CASE WHEN width > 1 THEN level + 1 END), 0) AS last FROM h GROUP BY 1),
 c AS (SELECT graph_id, height, unnest(list_concat([0], CASE WHEN height <= 4 THEN [] ELSE list_filter(list_concat([4], range(9, greatest(9, last), 5)), lambda x: x < height) END)) AS lb FROM s),
 q AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY lb) - 1 AS w, coalesce(lead(lb) OVER (PARTITION BY graph_id ORDER BY lb), height) AS ub FROM c)
 SELECT q.graph_id, CAST(q.w AS INTEGER) AS "window", CAST(lb AS INTEGER) AS lb, CAST(ub AS INTEGER) AS ub, CAST(CASE WHEN ub = height THEN 1 ELSE greatest(1, least(6, CASE WHEN ub = 4 THEN width // 2 ELSE width END)) END AS INTEGER) AS parts FROM q LEFT JOIN h ON h.graph_id = q.graph_id AND h.level = ub - 1""")
def height_windows(spark: SparkSession, d: str) -> DataFrame:
    return schedule.dag_windows(levels.level_sets(*_graph(spark, d)), 6, 4, 5)


def _islands(joins: str) -> str:
    return f""", j AS ({joins}), i AS (SELECT v.graph_id, v.node, sum(CASE WHEN j.node IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY v.graph_id ORDER BY v.node) AS k FROM v LEFT JOIN j ON j.graph_id = v.graph_id AND j.node = v.node),
 g AS (SELECT graph_id, node, min(node) OVER (PARTITION BY graph_id, k) AS "group" FROM i)"""


_ROWS = _islands("SELECT graph_id, dst AS node FROM e GROUP BY 1, 2 HAVING max(src) = dst - 1")
_COLS = _islands("SELECT graph_id, src + 1 AS node FROM e GROUP BY graph_id, src HAVING min(dst) = src + 1")
_SUPER = _islands("SELECT a.graph_id, a.src + 1 AS node FROM (SELECT graph_id, src, list_sort(list(dst)) AS d FROM e GROUP BY 1, 2) a LEFT JOIN (SELECT graph_id, src, list_sort(list(dst)) AS d FROM e GROUP BY 1, 2) b ON b.graph_id = a.graph_id AND b.src = a.src + 1 WHERE a.d = list_concat([a.src + 1], coalesce(b.d, []))")


@query(f"WITH {_E}, {_V}" + _ROWS + ' SELECT graph_id, node, "group" FROM g')
def groups_of_rows(spark: SparkSession, d: str) -> DataFrame:
    return grouping.consecutive_rows(*_graph(spark, d))


@query(f"WITH {_E}, {_V}" + _COLS + ' SELECT graph_id, node, "group" FROM g')
def groups_of_columns(spark: SparkSession, d: str) -> DataFrame:
    return grouping.consecutive_columns(*_graph(spark, d))


@query(f'WITH {_V} SELECT graph_id, node, node // 16 * 16 AS "group" FROM v')
def groups_of_blocks(spark: SparkSession, d: str) -> DataFrame:
    return grouping.blocks(_graph(spark, d)[1], 16)


@query(f"WITH {_E}, {_V}" + _SUPER + ' SELECT graph_id, node, "group" FROM g')
def supernodes(spark: SparkSession, d: str) -> DataFrame:
    return grouping.supernodes(*_graph(spark, d))


@query(f"WITH {_E}, {_V}" + _SUPER + ', z AS (SELECT graph_id, "group", count(*) AS n FROM g GROUP BY 1, 2) SELECT graph_id, count(*) AS supernodes, max(n) AS largest, round(avg(n), 6) AS average FROM z GROUP BY 1')
def supernode_sizes(spark: SparkSession, d: str) -> DataFrame:
    sizes = grouping.group_sizes(grouping.supernodes(*_graph(spark, d)))
    return sizes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("supernodes"), F.max("size").alias("largest"), F.round(F.avg("size"), 6).alias("average"))


_CHAIN_LINKS = "k AS (SELECT o.graph_id, o.src AS node, o.dst AS parent FROM (SELECT graph_id, src, max(dst) AS dst FROM e GROUP BY 1, 2 HAVING count(*) = 1) o JOIN (SELECT graph_id, dst FROM e GROUP BY 1, 2 HAVING count(*) = 1) i ON i.graph_id = o.graph_id AND i.dst = o.dst)"
_TREE_LINKS = "k AS (SELECT graph_id, src AS node, max(dst) AS parent FROM e GROUP BY 1, 2 HAVING count(*) = 1)"
_TOPS = ', w AS (SELECT graph_id, node, node AS "group" FROM v WHERE (graph_id, node) NOT IN (SELECT graph_id, node FROM k) UNION ALL SELECT k.graph_id, k.node, w."group" FROM w JOIN k ON k.graph_id = w.graph_id AND k.parent = w.node)'


@query(f"WITH RECURSIVE {_E}, {_V}, {_CHAIN_LINKS}{_TOPS} SELECT * FROM w")
def groups_of_chains(spark: SparkSession, d: str) -> DataFrame:
    return grouping.chains(*_graph(spark, d))


@query(f"WITH RECURSIVE {_E}, {_V}, {_TREE_LINKS}{_TOPS} SELECT * FROM w")
def groups_of_trees(spark: SparkSession, d: str) -> DataFrame:
    return grouping.trees(*_graph(spark, d))


_QUOTIENT = 'SELECT DISTINCT e.graph_id, a."group" AS src, b."group" AS dst FROM e JOIN w a ON a.graph_id = e.graph_id AND a.node = e.src JOIN w b ON b.graph_id = e.graph_id AND b.node = e.dst WHERE a."group" <> b."group"'


@query(f"WITH RECURSIVE {_E}, {_V}, {_TREE_LINKS}{_TOPS} {_QUOTIENT}")
def group_graph(spark: SparkSession, d: str) -> DataFrame:
    e, v = _graph(spark, d)
    return grouping.group_edges(e, cut(grouping.trees(e, v)))


@query(f"WITH RECURSIVE {_E}, {_V}, {_TREE_LINKS}{_TOPS}, q AS ({_QUOTIENT}) SELECT * FROM q WHERE src >= dst")
def group_graph_disorder(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the quotient graph that don't ascend: there are none."""
    e, v = _graph(spark, d)
    return is_topological(grouping.group_edges(e, cut(grouping.trees(e, v))))


@query(f"""WITH RECURSIVE {_E}, {_V}{_SUPER}, q AS (SELECT DISTINCT e.graph_id, a."group" AS src, b."group" AS dst FROM e JOIN g a ON a.graph_id = e.graph_id AND a.node = e.src JOIN g b ON b.graph_id = e.graph_id AND b.node = e.dst WHERE a."group" <> b."group"),
 w AS (SELECT DISTINCT graph_id, "group" AS node, 0 AS level FROM g UNION SELECT w.graph_id, q.dst, w.level + 1 FROM w JOIN q ON q.graph_id = w.graph_id AND q.src = w.node) SELECT graph_id, node AS "group", max(level) AS level FROM w GROUP BY 1, 2""")
def level_set_of_supernodes(spark: SparkSession, d: str) -> DataFrame:
    e, v = _graph(spark, d)
    return levels.level_sets_of_groups(e, cut(grouping.supernodes(e, v)))


# --- graphs


@query(f"WITH {_E} SELECT * FROM e")
def dag_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(table(spark, d, "matrix"))


@query(f'WITH {_E}, f AS (SELECT * FROM e UNION SELECT graph_id, dst, src FROM e WHERE (src + dst) % 2 = 0) SELECT a.graph_id, a.src, a.dst FROM f a JOIN f b ON b.graph_id = a.graph_id AND b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst')
def two_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with an edge each way, after the edges between even distances were mirrored."""
    e, _ = _graph(spark, d)
    back = e.filter((F.col("src") + F.col("dst")) % 2 == 0).select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graphs.two_cycles(e.unionByName(back))


@query(f"WITH {_E} SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e a JOIN e b ON b.graph_id = a.graph_id AND b.src = a.dst WHERE a.graph_id = e.graph_id AND a.src = e.src AND b.dst = e.dst)")
def two_hop_reduction(spark: SparkSession, d: str) -> DataFrame:
    return graphs.two_hop_reduction(_graph(spark, d)[0])


@query(f'WITH {_E}, {_V}{_SUPER}, z AS (SELECT graph_id, node, max(node) OVER (PARTITION BY graph_id, "group") AS last FROM g) SELECT e.* FROM e JOIN z ON z.graph_id = e.graph_id AND z.node = e.src WHERE src = last OR dst = src + 1')
def cliques_to_chains(spark: SparkSession, d: str) -> DataFrame:
    return graphs.cliques_to_chains(*_graph(spark, d))


@query(f"WITH {_E}, {_V}, n AS (SELECT graph_id, max(node) + 1 AS n FROM v GROUP BY 1) SELECT e.graph_id, src + q * n AS src, dst + q * n AS dst FROM e JOIN n ON n.graph_id = e.graph_id, (SELECT unnest([0, 1, 2]) AS q) UNION ALL SELECT v.graph_id, node + q * n, node + (q + 1) * n FROM v JOIN n ON n.graph_id = v.graph_id, (SELECT unnest([0, 1]) AS q)")
def merged_copies(spark: SparkSession, d: str) -> DataFrame:
    return graphs.merged_copies(*_graph(spark, d), copies=3)


# --- schedules


_DEGREES = """r AS (SELECT graph_id, "row" AS node, count(*) AS dr FROM m GROUP BY 1, 2), c AS (SELECT graph_id, col AS node, count(*) AS dc FROM m GROUP BY 1, 2),
 d AS (SELECT v.graph_id, v.node, coalesce(dr, 0) AS dr, coalesce(dc, 0) AS dc FROM v LEFT JOIN r ON r.graph_id = v.graph_id AND r.node = v.node LEFT JOIN c ON c.graph_id = v.graph_id AND c.node = v.node)"""


@query(f"""WITH {_M}, {_V}, {_DEGREES}, a AS (SELECT m.graph_id, m."row" AS node, CAST(sum(dc) AS BIGINT) AS l, CAST(sum(dr) AS BIGINT) AS u FROM m JOIN d ON d.graph_id = m.graph_id AND d.node = m.col GROUP BY 1, 2), b AS (SELECT m.graph_id, m.col AS node, CAST(sum(dc) AS BIGINT) AS l FROM m JOIN d ON d.graph_id = m.graph_id AND d.node = m."row" GROUP BY 1, 2)
 SELECT d.graph_id, d.node, dr AS sptrsv_left, dc AS sptrsv_right, coalesce(a.l, 0) AS ic0_left, coalesce(b.l, 0) AS ic0_right, coalesce(a.u, 0) AS ilu0_up FROM d LEFT JOIN a ON a.graph_id = d.graph_id AND a.node = d.node LEFT JOIN b ON b.graph_id = d.graph_id AND b.node = d.node""")
def kernel_costs(spark: SparkSession, d: str) -> DataFrame:
    return schedule.kernel_costs(cut(_entries(spark, d)))


def _costs(spark: SparkSession, d: str) -> DataFrame:
    return schedule.kernel_costs(cut(_entries(spark, d))).select("graph_id", "node", F.col("sptrsv_left").cast("double").alias("cost"))


def _coarsened(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e, v = _graph(spark, d)
    lev = cut(levels.level_sets(e, v))
    return e, v, cut(schedule.coarsened(e, lev, _costs(spark, d), bins=6, first=4, every=5))


@query()
def coarsened_schedule(spark: SparkSession, d: str) -> DataFrame:
    return _coarsened(spark, d)[2]


_VALID = f"WITH {_E}, {_V}, n AS (SELECT graph_id, count(*) AS nodes FROM v GROUP BY 1), m AS (SELECT graph_id, count(*) AS edges FROM e GROUP BY 1) SELECT n.graph_id, nodes, coalesce(edges, 0) AS edges, nodes AS scheduled, 0 AS violations FROM n LEFT JOIN m ON m.graph_id = n.graph_id"


@query(_VALID)
def coarsened_violations(spark: SparkSession, d: str) -> DataFrame:
    e, v, s = _coarsened(spark, d)
    return schedule.checked(s, e, v)


def _hybrid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reduced, grouped by trees, merged on the quotient graph and expanded again."""
    e, v = _graph(spark, d)
    reduced = cut(graphs.two_hop_reduction(e))
    g = cut(grouping.trees(reduced, v))
    q = cut(grouping.group_edges(reduced, g))
    members = g.select("graph_id", F.col("group").alias("node")).distinct()
    cost = schedule.group_costs(_costs(spark, d), g)
    coarse = schedule.hybrid(q, cut(levels.level_sets(q, members)), cost, cores=8)
    return e, v, cut(schedule.ungrouped(coarse, g))


@query()
def hybrid_schedule(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d)[2]


@query(_VALID)
def hybrid_violations(spark: SparkSession, d: str) -> DataFrame:
    e, v, s = _hybrid(spark, d)
    return schedule.checked(s, e, v)


def _fixed_windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Windows of three levels whose components are the parts, unpacked."""
    e, _, placed = _windowed(spark, d, 3)
    comp, _ = schedule.window_components(e, placed.select("graph_id", "node", "window"))
    s = comp.join(placed.select("graph_id", "node", F.col("level").alias("node_level")), ["graph_id", "node"])
    return e, cut(s.select("graph_id", F.col("window").alias("level"), F.col("component").alias("part"), "node_level", "node"))


_FIXED = _WINDOW + f""", {_M}, d AS (SELECT graph_id, "row" AS node, count(*) AS cost FROM m GROUP BY 1, 2),
 s AS (SELECT p.graph_id, p.w AS level, k.component AS part, count(*) AS nodes, CAST(sum(coalesce(cost, 0)) AS BIGINT) AS cost FROM p JOIN k ON k.graph_id = p.graph_id AND k.node = p.node LEFT JOIN d ON d.graph_id = p.graph_id AND d.node = p.node GROUP BY 1, 2, 3)"""


@query(_FIXED + """, z AS (SELECT graph_id, level, count(*) AS parts, sum(nodes) AS nodes, sum(cost) AS cost, max(cost) AS most, min(cost) AS least FROM s GROUP BY 1, 2)
 SELECT graph_id, count(*) AS levels, CAST(sum(parts) AS BIGINT) AS parts, round(sum(parts) / count(*), 6) AS average_parallelism, round(sum(parts * nodes) / sum(nodes), 6) AS weighted_parallelism, round(sum(parts * cost) / sum(cost), 6) AS cost_parallelism, CAST(sum(cost) AS BIGINT) AS cost, CAST(sum(most) AS BIGINT) AS critical_path, round(1 - sum(cost) / 8 / sum(most), 6) AS potential_gain, round(sum(cost * (most - least)) / sum(cost), 6) AS imbalance, max(most - least) AS greatest_gap, round(stddev_samp(most - least), 6) AS deviation FROM z GROUP BY 1""")
def schedule_metrics(spark: SparkSession, d: str) -> DataFrame:
    _, s = _fixed_windows(spark, d)
    cost = schedule.kernel_costs(_entries(spark, d)).select("graph_id", "node", F.col("sptrsv_left").alias("cost"))
    return metrics.schedule_metrics(metrics.part_costs(s, cost), 8)


@query(_FIXED + """, z AS (SELECT graph_id, level, max(nodes) AS most, CAST(sum(nodes) AS BIGINT) AS nodes FROM s GROUP BY 1, 2)
 SELECT graph_id, max(CASE WHEN level = 0 THEN most END) AS most_0, max(CASE WHEN level = 0 THEN nodes END) AS nodes_0, max(CASE WHEN level = 1 THEN most END) AS most_1, max(CASE WHEN level = 1 THEN nodes END) AS nodes_1, max(CASE WHEN level = 2 THEN most END) AS most_2, max(CASE WHEN level = 2 THEN nodes END) AS nodes_2, round(sum(most) / sum(nodes), 6) AS serial_share FROM z GROUP BY 1""")
def first_levels(spark: SparkSession, d: str) -> DataFrame:
    _, s = _fixed_windows(spark, d)
    return metrics.first_levels(metrics.part_costs(s, s.select("graph_id", "node", F.lit(1).alias("cost"))))


@query(_WINDOW + """, s AS (SELECT p.graph_id, w, component, p.node FROM p JOIN k ON k.graph_id = p.graph_id AND k.node = p.node)
 SELECT a.graph_id, round(count(b.node) / count(*), 6) AS consecutive FROM s a LEFT JOIN s b ON b.graph_id = a.graph_id AND b.w = a.w AND b.component = a.component AND b.node = a.node - 1 GROUP BY 1""")
def consecutive_share(spark: SparkSession, d: str) -> DataFrame:
    return metrics.adjacency_share(_fixed_windows(spark, d)[1])


@query(_WINDOW + """, s AS (SELECT p.graph_id, w, component, p.node FROM p JOIN k ON k.graph_id = p.graph_id AND k.node = p.node)
 SELECT DISTINCT e.graph_id, CAST(a.w AS BIGINT) AS src_level, a.component AS src_part, CAST(b.w AS BIGINT) AS dst_level, b.component AS dst_part FROM e JOIN s a ON a.graph_id = e.graph_id AND a.node = e.src JOIN s b ON b.graph_id = e.graph_id AND b.node = e.dst WHERE a.w <> b.w OR a.component <> b.component""")
def schedule_graph(spark: SparkSession, d: str) -> DataFrame:
    e, s = _fixed_windows(spark, d)
    return schedule.quotient(s, e)


@query(f"""WITH {_E}, x AS (SELECT DISTINCT graph_id, dst AS node FROM e), y AS (SELECT *, node - row_number() OVER (PARTITION BY graph_id ORDER BY node) AS k FROM x), z AS (SELECT graph_id, node, min(node) OVER (PARTITION BY graph_id, k) AS run FROM y) SELECT e.graph_id, run, src AS col, dst AS "row" FROM e JOIN z ON z.graph_id = e.graph_id AND z.node = e.dst""")
def two_d_tiles(spark: SparkSession, d: str) -> DataFrame:
    return schedule.tiles(_graph(spark, d)[0])


@query(f"""WITH {_M}, x AS (SELECT graph_id, col AS pos, count(*) AS weight FROM m GROUP BY 1, 2), y AS (SELECT *, sum(weight) OVER (PARTITION BY graph_id ORDER BY pos) - weight / 2 AS middle, sum(weight) OVER (PARTITION BY graph_id) AS total FROM x) SELECT graph_id, pos, CAST(least(7, floor(middle * 8 / total)) AS INTEGER) AS part FROM y""")
def weighted_partition(spark: SparkSession, d: str) -> DataFrame:
    m = algebra.per_column(_entries(spark, d)).select("graph_id", F.col("col").alias("pos"), F.col("nnz").alias("weight"))
    return schedule.partition_by_weight(m, 8)


# --- consumers and figures


@query(f"""WITH RECURSIVE {_E}, {_V}, i AS (SELECT graph_id, dst AS node, count(*) AS n FROM e GROUP BY 1, 2),
 s AS (SELECT v.graph_id, v.node, CAST(v.node % 7 AS DOUBLE) / (1.3 + coalesce(n, 0)) AS x, CAST(1.3 + coalesce(n, 0) AS DOUBLE) AS d FROM v LEFT JOIN i ON i.graph_id = v.graph_id AND i.node = v.node),
 w AS (SELECT graph_id, node, x, 0 AS k FROM s UNION ALL SELECT e.graph_id, e.dst, sum(w.x) / any_value(s.d), any_value(w.k) + 1 FROM w JOIN e ON e.graph_id = w.graph_id AND e.src = w.node JOIN s ON s.graph_id = e.graph_id AND s.node = e.dst GROUP BY e.graph_id, e.dst)
 SELECT graph_id, node, round(sum(x), 7) AS x FROM w GROUP BY 1, 2""")
def triangular_solve(spark: SparkSession, d: str) -> DataFrame:
    """Forward substitution with unit off-diagonals -1 and diagonal 1.3 + in-degree."""
    lower, b = _system(*_graph(spark, d))
    return solve.solve_lower(lower, b).select("graph_id", "node", F.round("value", 7).alias("x"))


@query(SQL["triangular_solve"])
def scheduled_solve(spark: SparkSession, d: str) -> DataFrame:
    """The same system, run along the levels and parts of a load-balanced schedule."""
    e, v, s = _coarsened(spark, d)
    return solve.solve_scheduled(*_system(e, v), s).select("graph_id", "node", F.round("value", 7).alias("x"))


@query(SQL["triangular_solve"])
def grouped_solve(spark: SparkSession, d: str) -> DataFrame:
    """The same system, run along the schedule of its supernodes."""
    e, v, g, s = _block_plan(spark, d)
    return solve.solve_scheduled(*_system(e, v), schedule.ungrouped(s, g)).select("graph_id", "node", F.round("value", 7).alias("x"))


def _system(e: DataFrame, v: DataFrame) -> tuple[DataFrame, DataFrame]:
    ins = e.groupBy("graph_id", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    diag = v.join(ins, ["graph_id", "node"], "left").select("graph_id", F.col("node").alias("row"), F.col("node").alias("col"), (1.3 + F.coalesce("n", F.lit(0))).alias("val"))
    lower = e.select("graph_id", F.col("dst").alias("row"), F.col("src").alias("col"), F.lit(-1.0).alias("val")).unionByName(diag)
    return lower, v.select("graph_id", "node", (F.col("node") % 7).alias("b"))


@query(f'WITH {_M}, s AS (SELECT graph_id, count(DISTINCT col) AS n, count(*) AS nnz, count(*) FILTER ("row" = col + 1) AS reuse FROM m GROUP BY 1) SELECT graph_id, n, nnz, 2 * (nnz - n) + n AS flops, 3 * (nnz - n) + 2 * n AS accesses, reuse, round(nnz / n, 6) AS nnz_per_row FROM s')
def matrix_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.matrix_stats(_entries(spark, d))


@query(f"""WITH {_M}, k AS (SELECT graph_id, col, count(*) FILTER ("row" > col) AS k FROM m GROUP BY 1, 2) SELECT graph_id, CAST(count(*) + sum(k) + 2 * (sum(k * (k + 1)) // 2) AS BIGINT) AS flops, CAST(2 * count(*) + 2 * sum(k) + 3 * (sum(k * (k + 1)) // 2) AS BIGINT) AS accesses FROM k GROUP BY 1""")
def factor_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.factor_stats(_entries(spark, d))


def _factored(spark: SparkSession, d: str) -> DataFrame:
    """Factor of the Laplacian-like matrix with off-diagonals -1 and diagonal 1 + degree."""
    e, v = _graph(spark, d)
    ends = e.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).groupBy("graph_id", "node").agg(F.count(F.lit(1)).alias("n"))
    diag = v.join(ends, ["graph_id", "node"], "left").select("graph_id", F.col("node").alias("row"), F.col("node").alias("col"), (1.0 + F.coalesce("n", F.lit(0))).alias("val"))
    lower = e.select("graph_id", F.col("dst").alias("row"), F.col("src").alias("col"), F.lit(-1.0).alias("val")).unionByName(diag)
    return solve.incomplete_cholesky(lower, v)


@query()
def incomplete_cholesky(spark: SparkSession, d: str) -> DataFrame:
    return _factored(spark, d)


@query(f"""WITH {_E}, {_V}, x AS (SELECT graph_id, src AS node FROM e UNION ALL SELECT graph_id, dst FROM e), n AS (SELECT graph_id, node, count(*) AS n FROM x GROUP BY 1, 2)
 SELECT graph_id, dst AS "row", src AS col, CAST(-1 AS DOUBLE) AS val FROM e UNION ALL SELECT v.graph_id, v.node, v.node, CAST(1 + coalesce(n, 0) AS DOUBLE) FROM v LEFT JOIN n ON n.graph_id = v.graph_id AND n.node = v.node""")
def cholesky_product(spark: SparkSession, d: str) -> DataFrame:
    """The factor times its transpose is the matrix again, on its pattern."""
    return solve.factor_product(cut(_factored(spark, d))).withColumn("val", F.round("val", 6))


@query()
def depth_first_order(spark: SparkSession, d: str) -> DataFrame:
    return walks.depth_first_order(*_graph(spark, d))


@query()
def groups_of_capped_trees(spark: SparkSession, d: str) -> DataFrame:
    return walks.capped_trees(*_graph(spark, d), most=32)


@query()
def groups_breadth_first(spark: SparkSession, d: str) -> DataFrame:
    return walks.capped_trees(*_graph(spark, d), most=32, breadth_first=True)


@query()
def greedy_runs(spark: SparkSession, d: str) -> DataFrame:
    return walks.greedy_runs(*_graph(spark, d), window=16)


@query()
def breadth_first_parts(spark: SparkSession, d: str) -> DataFrame:
    return walks.breadth_first_parts(*_graph(spark, d), weight=64.0)


_FUSED = f"""{_E}, {_V}, {_M}, n AS (SELECT graph_id, max(node) + 1 AS n FROM v GROUP BY 1),
 f AS (SELECT graph_id, src, dst FROM e UNION ALL SELECT e.graph_id, src + n, dst + n FROM e JOIN n ON n.graph_id = e.graph_id UNION ALL SELECT m.graph_id, col, "row" + n FROM m JOIN n ON n.graph_id = m.graph_id)"""


def _fused(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A solve, then a solve of the same matrix whose right-hand side is the product of the matrix and the first result."""
    e, v = _graph(spark, d)
    between = _entries(spark, d).select("graph_id", F.col("col").alias("src"), F.col("row").alias("dst"))
    n = v.groupBy("graph_id").agg((F.max("node") + 1).alias("n"))
    return graphs.merged_with(e, between, e, v), v.unionByName(v.join(n, "graph_id").select("graph_id", (F.col("node") + F.col("n")).alias("node")))


@query(f"WITH {_FUSED} SELECT * FROM f")
def fused_graph(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d)[0]


@query(f"WITH RECURSIVE {_FUSED}, a AS (SELECT graph_id, node FROM v UNION ALL SELECT v.graph_id, node + n FROM v JOIN n ON n.graph_id = v.graph_id), w AS (SELECT graph_id, node, 0 AS level FROM a UNION SELECT w.graph_id, f.dst, w.level + 1 FROM w JOIN f ON f.graph_id = w.graph_id AND f.src = w.node) SELECT graph_id, node, max(level) AS level FROM w GROUP BY 1, 2")
def fused_level_set(spark: SparkSession, d: str) -> DataFrame:
    return levels.level_sets(*_fused(spark, d))


@query(f"""WITH {_E}, {_V}, {_M}, n AS (SELECT graph_id, max(node) + 1 AS n FROM v GROUP BY 1)
 SELECT e.graph_id, src + q * n AS src, dst + q * n AS dst FROM e JOIN n ON n.graph_id = e.graph_id, (SELECT unnest([0, 1, 2]) AS q) UNION ALL SELECT m.graph_id, col + q * n, "row" + (q + 1) * n FROM m JOIN n ON n.graph_id = m.graph_id, (SELECT unnest([0, 1]) AS q)""")
def fused_chain(spark: SparkSession, d: str) -> DataFrame:
    """Three kernels in a row, each taking the product of the matrix and the result before."""
    two, v = _fused(spark, d)
    n = nodes(table(spark, d, "matrix")).groupBy("graph_id").agg((F.max("node") + 1).alias("n"))
    between = _entries(spark, d).join(n, "graph_id").select("graph_id", (F.col("col") + F.col("n")).alias("src"), F.col("row").alias("dst"))
    return graphs.merged_with(two, between, edges(table(spark, d, "matrix")), v)


def _tree_plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = _tree(spark, d)
    height = cut(figures(t).select("graph_id", "node", F.col("height").cast("int").alias("level")))
    up = t.filter("parent is not null").select("graph_id", F.col("node").alias("src"), F.col("parent").alias("dst"))
    return up, t.select("graph_id", "node"), cut(schedule.coarsened_tree(t, height, bins=6))


@query()
def tree_schedule(spark: SparkSession, d: str) -> DataFrame:
    return _tree_plan(spark, d)[2]


@query(f"WITH RECURSIVE {_TREE} SELECT graph_id, count(*) AS nodes, count(parent) AS edges, count(*) AS scheduled, 0 AS violations FROM r GROUP BY 1")
def tree_schedule_violations(spark: SparkSession, d: str) -> DataFrame:
    up, v, s = _tree_plan(spark, d)
    return schedule.checked(s, up, v)


def _block_plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    e, v = _graph(spark, d)
    g = cut(grouping.supernodes(e, v))
    q = cut(grouping.group_edges(e, g))
    members = g.select("graph_id", F.col("group").alias("node")).distinct()
    cost = schedule.group_costs(_costs(spark, d), g)
    return e, v, g, cut(schedule.coarsened(q, cut(levels.level_sets(q, members)), cost, bins=6, first=4, every=5))


@query()
def block_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Load-balanced coarsening of supernodes."""
    return _block_plan(spark, d)[3]


@query(_VALID)
def block_schedule_violations(spark: SparkSession, d: str) -> DataFrame:
    e, v, g, s = _block_plan(spark, d)
    return schedule.checked(schedule.ungrouped(s, g), e, v)


def _tree_plan_of_matrix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Load-balanced coarsening of a matrix through its elimination tree, columns priced by their entries in the factor."""
    e, v = _graph(spark, d)
    t = symbolic.factor_tree(e, v)
    height = cut(figures(t).select("graph_id", "node", F.col("height").cast("int").alias("level")))
    cost = cut(symbolic.column_counts(e, t).select("graph_id", "node", F.col("count").cast("double").alias("cost")))
    return e, v, cut(schedule.coarsened_tree(t, height, cost, bins=6))


@query()
def factor_schedule(spark: SparkSession, d: str) -> DataFrame:
    return _tree_plan_of_matrix(spark, d)[2]


@query(_VALID)
def factor_schedule_violations(spark: SparkSession, d: str) -> DataFrame:
    e, v, s = _tree_plan_of_matrix(spark, d)
    return schedule.checked(s, e, v)


def _reduced_plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cliques made chains, two-hop edges removed, groups of capped breadth-first trees, merged while balanced, expanded."""
    e, v = _graph(spark, d)
    reduced = cut(graphs.two_hop_reduction(cut(graphs.cliques_to_chains(e, v))))
    g = cut(walks.capped_trees(reduced, v, most=32, breadth_first=True))
    q = cut(grouping.group_edges(reduced, g))
    members = g.select("graph_id", F.col("group").alias("node")).distinct()
    coarse = schedule.hybrid(q, cut(levels.level_sets(q, members)), schedule.group_costs(_costs(spark, d), g), cores=8)
    return e, v, cut(schedule.ungrouped(coarse, g))


@query(_VALID)
def reduced_schedule_violations(spark: SparkSession, d: str) -> DataFrame:
    e, v, s = _reduced_plan(spark, d)
    return schedule.checked(s, e, v)


@query("SELECT record_id, ingest_ts, CASE WHEN t_serial > t_level THEN t_group_level / (t_serial - t_level) END AS runs FROM metrics")
def profitable_runs(spark: SparkSession, d: str) -> DataFrame:
    """After how many runs the parallel solve has saved what the grouping took."""
    return table(spark, d, "metrics").select("record_id", "ingest_ts", metrics.profitable(F.col("t_group_level"), F.col("t_serial"), F.col("t_level")).alias("runs"))


@query("""WITH r AS (SELECT fname, t_serial AS t FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ingest_ts DESC) AS rn FROM metrics) WHERE rn = 1 AND t_serial IS NOT NULL AND NOT isnan(t_serial)), o AS (SELECT *, row_number() OVER (PARTITION BY fname ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY fname) AS n FROM r) SELECT fname, t AS middle, n AS runs FROM o WHERE k = n // 2""")
def middle_times(spark: SparkSession, d: str) -> DataFrame:
    from levelweave.functions.quantiles import latest

    runs = latest(table(spark, d, "metrics").select("record_id", "fname", "t_serial", "ingest_ts"), "record_id", "ingest_ts")
    return metrics.middle(runs, ["fname"], "t_serial")

"""Queries of the general training-data operators (problems 1 to 4) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelweave.functions.quantiles import latest, percentiles, value_counts
from levelweave.operators.columns import column_results, matrix_results
from levelweave.operators.hierarchy import cycles, descendants, figures, hierarchy
from levelweave.sources.triplets import parse_triplets, rejected_lines, valid_triplets
from levelweave.tables import table

PERMILLE = [10, 250, 500, 750, 900, 990]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = hierarchy(table(spark, d, "tree"), paths=False)
    return nodes.filter(F.col("fault").isNotNull()).select("graph_id", "node", "fault")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    nodes = hierarchy(table(spark, d, "tree"))
    return nodes.filter(F.col("fault").isNull()).select("graph_id", "node", "root", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return figures(hierarchy(table(spark, d, "tree"), paths=False)).select("graph_id", "node", "descendants", "height")


def p1_descendant_rows(spark: SparkSession, d: str) -> DataFrame:
    """The descendants themselves, a row for every node below another."""
    pairs = descendants(hierarchy(table(spark, d, "tree")).filter(F.col("fault").isNull()))
    return pairs.withColumn("distance", F.col("distance").cast("long"))


def p1_cycles(spark: SparkSession, d: str) -> DataFrame:
    """The links that lie on a cycle, with the cycle's least node and length."""
    return cycles(hierarchy(table(spark, d, "tree"), paths=False))


def p1_components(spark: SparkSession, d: str) -> DataFrame:
    """The connected components of the links: least node, size, and how their nodes end."""
    nodes = hierarchy(table(spark, d, "tree"), paths=False)
    return nodes.groupBy("graph_id", "component").agg(F.count(F.lit(1)).alias("nodes"), F.count("root").alias("rooted"), F.max("depth").alias("deepest"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse_triplets(table(spark, d, "triplet_raw"), table(spark, d, "graphs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected_lines(_parsed(spark, d)).select("line_id", "reason")


def p2_valid(spark: SparkSession, d: str) -> DataFrame:
    return valid_triplets(_parsed(spark, d))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "metrics").select("record_id", "fname", "t_serial", "t_level", "run_ts", "ingest_ts")
    return value_counts(latest(records, "record_id", "ingest_ts"), ["fname"], ["t_serial", "t_level"], F.to_date("run_ts"))


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    state = _daily(spark, d)
    return percentiles(state, ["fname", "metric"], PERMILLE)


def p3_months(spark: SparkSession, d: str) -> DataFrame:
    """Daily states combined into months."""
    state = _daily(spark, d).withColumn("month", F.date_format("part", "yyyy-MM"))
    return percentiles(state, ["fname", "month", "metric"], [500, 900])


def p3_bounded(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of states in logarithmic bins, whose size the range of the values bounds, and whether each is within one per cent."""
    records = table(spark, d, "metrics").select("record_id", "fname", "t_serial", "t_level", "run_ts", "ingest_ts")
    runs = latest(records, "record_id", "ingest_ts")
    keys = ["fname", "metric"]
    near, exact = (percentiles(value_counts(runs, ["fname"], ["t_serial", "t_level"], F.to_date("run_ts"), e), keys, PERMILLE) for e in (0.01, 0.0))
    both = near.alias("a").join(exact.alias("b"), F.col("a.fname").eqNullSafe(F.col("b.fname")) & (F.col("a.metric") == F.col("b.metric")) & (F.col("a.permille") == F.col("b.permille")))
    within = F.abs(F.col("a.percentile") - F.col("b.percentile")) <= F.abs(F.col("b.percentile")) * 0.0100001
    return both.select("a.fname", "a.metric", "a.permille", within.alias("within"), "a.n")


def p4_columns(spark: SparkSession, d: str) -> DataFrame:
    return column_results(table(spark, d, "matrix"), table(spark, d, "csc")).withColumn("sum_val", F.round("sum_val", 4))


def p4_matrices(spark: SparkSession, d: str) -> DataFrame:
    columns = column_results(table(spark, d, "matrix"), table(spark, d, "csc"))
    return matrix_results(columns, table(spark, d, "csc"), table(spark, d, "graphs")).withColumn("sum_val", F.round("sum_val", 4))


QUERIES = {q.__name__: q for q in (p1_found, p1_paths, p1_descendants, p1_descendant_rows, p1_cycles, p1_components, p2_found, p2_valid, p3_percentiles, p3_months, p3_bounded, p4_columns, p4_matrices)}

_TREE = "t AS (SELECT DISTINCT graph_id, node, CASE WHEN parent = -1 THEN NULL ELSE parent END AS parent FROM tree)"
_DOWN = f"""WITH RECURSIVE {_TREE},
 w AS (SELECT graph_id, node, node AS root, CAST(0 AS BIGINT) AS depth, CAST(node AS VARCHAR) AS path FROM t WHERE parent IS NULL
       UNION ALL SELECT t.graph_id, t.node, w.root, w.depth + 1, w.path || '/' || t.node FROM w JOIN t ON t.graph_id = w.graph_id AND t.parent = w.node)"""
_LINE = r"""WITH g AS (SELECT graph_id, max(n) AS n, max(CASE WHEN field = 'pattern' THEN 1 ELSE 0 END) AS pat FROM graphs GROUP BY 1),
 a AS (SELECT line_id, l.graph_id, line_no, line, n, coalesce(pat, 0) AS pat FROM triplet_raw l LEFT JOIN g ON g.graph_id = l.graph_id WHERE line IS NULL OR NOT starts_with(line, '%')),
 q AS (SELECT *, regexp_full_match(line, '[ \t]*("([^"]|"")*"[ \t]*|[^",]*)(,[ \t]*("([^"]|"")*"[ \t]*|[^",]*))*', 's') AS quoted FROM a),
 f AS (SELECT *, CASE WHEN quoted THEN list_transform(regexp_extract_all(',' || line, ',[ \t]*("([^"]|"")*"[ \t]*|[^",]*)', 1, 's'), lambda x: trim(CASE WHEN starts_with(x, '"') THEN replace(substring(trim(x, ' ' || chr(9)), 2, length(trim(x, ' ' || chr(9))) - 2), '""', '"') ELSE x END, ' ' || chr(9))) END AS f FROM q),
 c AS (SELECT *, quoted AND len(f) = 3 - pat AS counted FROM f),
 v AS (SELECT *, regexp_full_match(f[1], '[0-9]+') AND regexp_full_match(f[2], '[0-9]+') AND TRY_CAST(f[1] AS HUGEINT) BETWEEN 1 AND n AND TRY_CAST(f[2] AS HUGEINT) BETWEEN 1 AND n
   AND (len(f) = 2 OR regexp_full_match(f[3], '[+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?') AND coalesce(isfinite(TRY_CAST(f[3] AS DOUBLE)), false)) AS good FROM c)"""


def _percentile_sql(keys: str, permille: list[int]) -> str:
    inner = keys.replace("month", "strftime(run_ts, '%Y-%m') AS month")
    return f"""WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ingest_ts DESC) AS rn FROM metrics) WHERE rn = 1),
 l AS (SELECT {inner}, 't_serial' AS metric, t_serial AS value FROM r UNION ALL SELECT {inner}, 't_level', t_level FROM r),
 o AS (SELECT *, row_number() OVER (PARTITION BY {keys}, metric ORDER BY value) AS rn, count(*) OVER (PARTITION BY {keys}, metric) AS n FROM l WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value))
 SELECT {keys}, metric, CAST(permille AS INTEGER) AS permille, min(value) AS percentile, n FROM o, (SELECT unnest({permille}) AS permille) WHERE rn >= greatest(1, (permille * n + 999) // 1000) GROUP BY {keys}, metric, permille, n"""


_COLUMNS = """d AS (SELECT graph_id, "row", col, max(val) AS v FROM matrix GROUP BY 1, 2, 3),
 m AS (SELECT graph_id, col, count(*) AS entries, count(*) FILTER (v IS NULL OR isnan(v) OR isinf(v)) AS bad_values, sum(v) FILTER (NOT isnan(v) AND NOT isinf(v)) AS sum_val FROM d GROUP BY 1, 2),
 s AS (SELECT graph_id, col_lo, p, unnest(range(0, len(p) - 1)) AS j FROM csc),
 k AS (SELECT graph_id, col_lo + j AS col, CAST(p[j + 2] - p[j + 1] AS BIGINT) AS csc_entries FROM s),
 c AS (SELECT coalesce(m.graph_id, k.graph_id) AS graph_id, coalesce(m.col, k.col) AS col, coalesce(entries, 0) AS entries, coalesce(bad_values, 0) AS bad_values, sum_val, csc_entries, coalesce(entries, 0) = coalesce(csc_entries, 0) AS agree FROM m FULL JOIN k ON m.graph_id = k.graph_id AND m.col = k.col)"""

SQL = {
    "p1_found": f"""WITH RECURSIVE {_TREE},
 a AS (SELECT graph_id, node, parent AS anc FROM t WHERE parent IS NOT NULL UNION SELECT a.graph_id, a.node, t.parent FROM a JOIN t ON t.graph_id = a.graph_id AND t.node = a.anc WHERE t.parent IS NOT NULL),
 f AS (SELECT a.graph_id, a.node, max(CASE WHEN a.anc = a.node THEN 1 ELSE 0 END) AS own, max(CASE WHEN t.node IS NULL THEN 1 ELSE 0 END) AS lost, max(CASE WHEN t.node IS NOT NULL AND t.parent IS NULL THEN 1 ELSE 0 END) AS rooted
       FROM a LEFT JOIN t ON t.graph_id = a.graph_id AND t.node = a.anc GROUP BY 1, 2)
 SELECT graph_id, node, CASE WHEN own = 1 THEN 'cycle' WHEN lost = 1 THEN 'orphan' ELSE 'under_cycle' END AS fault FROM f WHERE rooted = 0""",
    "p1_paths": _DOWN + " SELECT graph_id, node, root, depth, path FROM w",
    "p1_descendants": f"""WITH RECURSIVE {_TREE},
 r AS (SELECT graph_id, node FROM t WHERE parent IS NULL UNION ALL SELECT t.graph_id, t.node FROM r JOIN t ON t.graph_id = r.graph_id AND t.parent = r.node),
 a AS (SELECT r.graph_id, r.node, r.node AS anc, CAST(0 AS BIGINT) AS dist FROM r UNION ALL SELECT a.graph_id, a.node, t.parent, dist + 1 FROM a JOIN t ON t.graph_id = a.graph_id AND t.node = a.anc WHERE t.parent IS NOT NULL)
 SELECT graph_id, anc AS node, count(*) - 1 AS descendants, max(dist) AS height FROM a GROUP BY 1, 2""",
    "p1_descendant_rows": f"""WITH RECURSIVE {_TREE},
 r AS (SELECT graph_id, node FROM t WHERE parent IS NULL UNION ALL SELECT t.graph_id, t.node FROM r JOIN t ON t.graph_id = r.graph_id AND t.parent = r.node),
 a AS (SELECT r.graph_id, r.node, r.node AS anc, CAST(0 AS BIGINT) AS dist FROM r UNION ALL SELECT a.graph_id, a.node, t.parent, dist + 1 FROM a JOIN t ON t.graph_id = a.graph_id AND t.node = a.anc WHERE t.parent IS NOT NULL)
 SELECT graph_id, anc AS ancestor, node AS descendant, dist AS distance FROM a WHERE dist > 0""",
    "p1_cycles": f"""WITH RECURSIVE {_TREE},
 a AS (SELECT graph_id, node, parent AS anc FROM t WHERE parent IS NOT NULL UNION SELECT a.graph_id, a.node, t.parent FROM a JOIN t ON t.graph_id = a.graph_id AND t.node = a.anc WHERE t.parent IS NOT NULL),
 c AS (SELECT a.graph_id, a.node, t.parent FROM a JOIN t ON t.graph_id = a.graph_id AND t.node = a.node WHERE a.node = a.anc),
 m AS (SELECT a.graph_id, a.node, min(a.anc) AS "cycle", count(*) AS length FROM a JOIN c ON c.graph_id = a.graph_id AND c.node = a.node GROUP BY 1, 2)
 SELECT graph_id, "cycle", node, parent, length FROM c JOIN m USING (graph_id, node)""",
    "p1_components": f"""WITH RECURSIVE {_TREE},
 a AS (SELECT graph_id, node, node AS anc FROM t UNION SELECT a.graph_id, a.node, p.node FROM a JOIN t ON t.graph_id = a.graph_id AND t.node = a.anc JOIN t p ON p.graph_id = t.graph_id AND p.node = t.parent),
 s AS (SELECT DISTINCT a.graph_id, a.node FROM a JOIN t ON t.graph_id = a.graph_id AND t.node = a.anc WHERE t.parent = a.node),
 tops AS (SELECT t.graph_id, t.node, t.parent IS NULL AS root FROM t LEFT JOIN t p ON p.graph_id = t.graph_id AND p.node = t.parent WHERE p.node IS NULL UNION ALL SELECT graph_id, node, false FROM s),
 k AS (SELECT a.graph_id, a.node, min(a.anc) AS key, bool_or(root) AS rooted FROM a JOIN tops ON tops.graph_id = a.graph_id AND tops.node = a.anc GROUP BY 1, 2),
 n AS (SELECT graph_id, node, count(*) - 1 AS depth FROM a GROUP BY 1, 2)
 SELECT k.graph_id, min(k.node) AS component, count(*) AS nodes, count(*) FILTER (rooted) AS rooted, max(CASE WHEN rooted THEN depth END) AS deepest FROM k JOIN n USING (graph_id, node) GROUP BY k.graph_id, key""",
    "p2_found": _LINE + " SELECT line_id, CASE WHEN NOT coalesce(quoted, true) THEN 'quoting' WHEN NOT coalesce(counted, false) THEN 'columns' ELSE 'value' END AS reason FROM v WHERE NOT coalesce(good AND counted, false)",
    "p2_valid": _LINE + ' SELECT line_id, graph_id, line_no, CAST(f[1] AS BIGINT) AS "row", CAST(f[2] AS BIGINT) AS col, CASE WHEN len(f) = 2 THEN 1.0 ELSE CAST(f[3] AS DOUBLE) END AS val FROM v WHERE good AND counted',
    "p3_percentiles": _percentile_sql("fname", PERMILLE),
    "p3_months": _percentile_sql("fname, month", [500, 900]),
    "p3_bounded": f"SELECT fname, metric, permille, true AS within, n FROM ({_percentile_sql('fname', PERMILLE)})",
    "p4_columns": f"WITH {_COLUMNS} SELECT graph_id, col, entries, bad_values, round(sum_val, 4) AS sum_val, csc_entries, agree FROM c",
    "p4_matrices": f"""WITH {_COLUMNS},
 per AS (SELECT graph_id, CAST(sum(entries) AS BIGINT) AS entries, count(*) FILTER (entries > 0) AS filled_columns, max(entries) AS longest_column, round(sum(sum_val), 4) AS sum_val, count(*) FILTER (NOT agree) AS columns_differing FROM c GROUP BY 1),
 z AS (SELECT graph_id, CAST(sum(coalesce(nnz, p[len(p)])) AS BIGINT) AS nnz FROM csc GROUP BY 1)
 SELECT per.*, z.nnz, g.fname FROM per LEFT JOIN z USING (graph_id) LEFT JOIN (SELECT graph_id, max(fname) AS fname FROM graphs GROUP BY 1) g USING (graph_id)""",
}

"""The tables every operator works on, derived from matrix entries.

========  =======================================  ==========================================
table     columns                                  meaning
========  =======================================  ==========================================
entries   graph_id, row, col, val                  one row per position of a lower triangle
edges     graph_id, src, dst                       entry (dst, src), dst > src; distinct
nodes     graph_id, node                           rows and columns that occur
levels    graph_id, node, level                    longest way from a source
groups    graph_id, node, group                    named by a member: first of a run, last of a tree
schedule  graph_id, level, part, pos, node         parts of one level are independent
========  =======================================  ==========================================

Node numbers are a topological order (an edge goes from a lower to a higher number), as in any
lower triangle; so no edge table made here has a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entries(matrix: DataFrame) -> DataFrame:
    """Every position once; of several values the greatest. Rows without a row or column number are left out."""
    return matrix.filter(F.col("row").isNotNull() & F.col("col").isNotNull()).groupBy("graph_id", "row", "col").agg(F.max("val").alias("val"))


def edges(matrix: DataFrame) -> DataFrame:
    """Row ``row`` of a lower triangle depends on its off-diagonal columns."""
    return matrix.filter(F.col("row") > F.col("col")).select("graph_id", F.col("col").alias("src"), F.col("row").alias("dst")).distinct()


def nodes(matrix: DataFrame) -> DataFrame:
    both = F.explode(F.array("row", "col")).alias("node")
    return matrix.select("graph_id", both).filter(F.col("node").isNotNull()).distinct()


def is_topological(edges_: DataFrame) -> DataFrame:
    """Edges that break the order of node numbers; none in a valid table."""
    return edges_.filter(F.col("src") >= F.col("dst"))

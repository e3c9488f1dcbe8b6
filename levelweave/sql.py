"""The library for SQL users, and what a scheduler of one's own must offer."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf


class Scheduler(Protocol):
    """Anything that makes a schedule; check what it makes with ``schedule.violations``."""

    def schedule(self, edges: DataFrame, levels: DataFrame, costs: DataFrame) -> DataFrame:
        """(graph_id, level, part, node_level, node)."""
        ...


@udtf(returnType="graph_id long, node long, level int")
class LevelSets:
    """``SELECT * FROM level_sets(TABLE(SELECT graph_id, src, dst FROM edges) PARTITION BY graph_id ORDER BY dst)``.

    Nodes that some edge names; of a graph that is held by one task. For larger graphs use ``levels.level_sets``.
    """

    def __init__(self) -> None:
        self.graph, self.level = None, {}

    def eval(self, row: Row) -> None:
        self.graph = row["graph_id"]
        above = self.level.setdefault(row["src"], 0) + 1
        if above > self.level.setdefault(row["dst"], 0):
            self.level[row["dst"]] = above

    def terminate(self) -> Iterator[tuple[int, int, int]]:
        for node, level in self.level.items():
            yield self.graph, node, level


def register(spark: SparkSession) -> None:
    """Makes ``level_sets`` known to SQL."""
    spark.udtf.register("level_sets", LevelSets)

"""Cutting lineage through tables in the folder that every executor shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_used: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where that is unset a local session (tests) gets a folder of its own; a cluster must set it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="levelweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has written here; results read after that are lost."""
    _delete(spark, f"{shared_root(spark)}/levelweave/{spark.sparkContext.applicationId}")


def _clear_at_exit(spark: SparkSession, folder: str) -> None:
    try:
        _delete(spark, folder)
    except Exception:  # noqa: BLE001 - the JVM may be gone already; the folder then stays
        pass


class Cut:
    """A written table: ``df`` reads it, ``drop()`` deletes it once nothing depends on it. The application's end deletes the rest."""

    def __init__(self, df: DataFrame, by: list[str] | None = None):
        self.spark = df.sparkSession
        folder = f"{shared_root(self.spark)}/levelweave/{self.spark.sparkContext.applicationId}"
        if folder not in _used:
            _used.add(folder)
            atexit.register(_clear_at_exit, self.spark, folder)
        self.path = f"{folder}/{uuid.uuid4().hex}"
        (df.write.partitionBy(*by) if by else df.write).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def cut(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder, in folders ``by`` if named, and read again: survives lost executors, has no lineage."""
    return Cut(df, by).df

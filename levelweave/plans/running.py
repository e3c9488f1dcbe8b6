"""Running sums over sorted keys of any size, without a key passing one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from levelweave.plans.storage import cut


def running_task(keys: int, value: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Running sums of ``value`` within each run of equal keys (the first columns) of a sorted partition, as a last column."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, carried = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column(value).to_numpy(zero_copy_only=False)
            new = np.zeros(len(n), dtype=bool)
            for i in range(keys):
                codes = b.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            first = tuple(b.column(i)[0].as_py() for i in range(keys))
            starts = np.flatnonzero(new)
            total = np.cumsum(n)
            heads = np.concatenate([[0], starts])
            base = np.repeat(np.concatenate([[0], total[starts - 1]]).astype(total.dtype), np.diff(np.append(heads, len(n))))
            running = total - base
            if first == before:
                running[: starts[0] if len(starts) else len(n)] += carried
            before, carried = tuple(b.column(i)[-1].as_py() for i in range(keys)), running[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(running)], names=[*b.schema.names, "running"])

    return task


def sorted_sums(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` range-partitioned and sorted by keys and order, with ``pid`` and ``running``, the sums within partitions."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = df.select(*keys, *[c for c in df.columns if c not in keys])
    ordered = slim.repartitionByRange(tasks, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("pid", F.spark_partition_id())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields)
    kind = ordered.schema[value].dataType.simpleString()
    return cut(ordered.mapInArrow(running_task(len(keys), value), f"{fields}, running {kind}"))


def running_sums(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with ``running``: the sum of ``value`` (long or double, no nulls) over the rows of its key up to each row, in ``order``.

    Sums are taken within range partitions; only keys that lie in several of them, fewer than there
    are partitions, get the sums of the earlier ones added, by a broadcast of one row a key and partition.
    """
    sums = sorted_sums(df, keys, order, value)
    piece = sums.groupBy(*keys, "pid").agg(F.sum(value).alias("held"))
    w = W.partitionBy(*keys)
    parts = piece.withColumn("parts", F.count(F.lit(1)).over(w)).filter("parts > 1").withColumn("offset", F.sum("held").over(w.orderBy("pid")) - F.col("held"))
    right = F.broadcast(parts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("pid").alias("_pid"), "offset"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "pid"]])
    out = sums.join(right, same, "left").withColumn("running", F.col("running") + F.coalesce("offset", F.lit(0)))
    return out.select(*df.columns, "running")

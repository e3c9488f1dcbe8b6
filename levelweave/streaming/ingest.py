"""Streams of coordinate lines and run records through the same operators as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from levelweave.functions.quantiles import value_counts
from levelweave.sources.triplets import parse_triplets


def ingest_triplets(lines: DataFrame, graphs: DataFrame, valid: str, rejected: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch of ``lines`` parsed; valid triplets and rejected lines go to two Parquet folders, by batch.

    A batch that is run again after a failure overwrites its own folder, so every line lands once.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        parsed = parse_triplets(df, graphs)
        parsed.filter("reason is null").write.mode("overwrite").parquet(f"{valid}/batch={batch_id}")
        parsed.filter("reason is not null").write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")
        df.unpersist()

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def daily_counts(records: DataFrame, late: str = "7 days") -> DataFrame:
    """Streaming percentile state: counts of (fname, day, metric, value), records redelivered within ``late`` counted once.

    ``records`` is a stream of run records; rows later than the watermark are not counted here,
    but their own day's state from a table run combines with this one. Days are those of UTC; the state
    of a day is dropped once the watermark has passed it.
    """
    fresh = records.withWatermark("run_ts", late).dropDuplicatesWithinWatermark(["record_id"])
    daily = fresh.withColumn("day", F.window("run_ts", "1 day"))
    return value_counts(daily, ["fname"], ["t_serial", "t_level"], F.col("day")).withColumn("part", F.to_date("part.start"))

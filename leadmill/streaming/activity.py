"""The activity log as a stream: counts by window and an idempotent append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity_counts(log: DataFrame, time: str = "ts", action: str = "event_type", late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Actions by hour; works on a stream (state is dropped behind the watermark) and on a table."""
    return log.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), F.col(action).alias("action")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "action", "n")


def append_batches(log: DataFrame, path: str, checkpoint: str):
    """Start a query that writes each micro-batch to a folder of its own, so that a repeated batch replaces itself."""
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Structured Streaming counterparts: event-time windows with late data, and incremental corpus stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """(start, keys, n, total) per event-time window; the same plan runs on a batch and on a stream.

    On a stream, rows later than the watermark are dropped and windows are emitted once it has passed.
    """
    source = events.withWatermark("ts", late) if events.isStreaming else events
    out = source.groupBy(F.window("ts", width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def new_files(spark: SparkSession, schema, folder: str) -> DataFrame:
    """A stream of a folder's Parquet files: with ``availableNow`` and a checkpoint, each run takes only what is new."""
    return spark.readStream.schema(schema).parquet(folder)


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; the checkpoint makes the next run continue after it."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()

"""Writers: panels, catalogs by status, shards, manifests, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_panel(features: DataFrame, labels: DataFrame, coverage: DataFrame, folder: str) -> None:
    """Features with labels, closes, and coverage, each by year."""
    year = lambda d: d.withColumn("year", F.year("date"))
    year(features.join(labels, ["date", "ticker"], "left")).write.mode("overwrite").partitionBy("year").parquet(f"{folder}/features")
    year(features.select("date", "ticker", "close")).write.mode("overwrite").partitionBy("year").parquet(f"{folder}/close")
    coverage.write.mode("overwrite").parquet(f"{folder}/coverage")


def write_catalog(catalog: DataFrame, folder: str) -> None:
    """By status, so a stage reads only its own partition."""
    catalog.write.mode("overwrite").partitionBy("status").parquet(folder)


def write_shards(sequences: DataFrame, folder: str) -> None:
    sequences.repartition("shard_id").sortWithinPartitions("shard_id", "seq_no").write.mode("overwrite").partitionBy("shard_id").parquet(folder)


def append_json(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").json(folder)


def write_row(row: DataFrame, folder: str) -> None:
    """A manifest or decision: one JSON row."""
    row.coalesce(1).write.mode("overwrite").json(folder)

"""Session factory with the settings every plan in this package assumes."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "tessera", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass the session the platform made.

    Time zone is UTC so timestamps agree with other engines, AQE stays on so partitions are
    coalesced or split from measured sizes, ANSI stays at Spark's default (on).
    """
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

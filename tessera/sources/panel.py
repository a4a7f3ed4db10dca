"""A daily-bar style panel from order lines: weeks are dates, brands are tickers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import dense_grid
from .tables import table


#: Added before rounding, so a value half way between two steps goes up in every engine.
NUDGE = 1e-8


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker, segment, open, high, low, close, adj_close, volume): one row per brand and week with sales.

    Prices are averaged as decimals, so the result doesn't depend on the order of rows.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    unit = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.date_trunc("week", "l_shipdate").cast("date").alias("date"),
        F.col("p_brand").alias("ticker"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        "l_quantity",
        F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"),
    )
    mean = F.sum(F.col("price").cast("decimal(18,6)")).cast("double") / F.count(F.lit(1))
    bars = unit.groupBy("date", "ticker").agg(
        F.round(F.min_by("price", "at") + NUDGE, 4).alias("open"), F.round(F.max("price") + NUDGE, 4).alias("high"), F.round(F.min("price") + NUDGE, 4).alias("low"),
        F.round(mean + NUDGE, 4).alias("close"), F.sum("l_quantity").alias("volume"),
    )
    segment = F.regexp_extract("ticker", r"(\d+)", 1).cast("int") % 5
    return bars.withColumns({"adj_close": F.col("close"), "segment": segment})


def weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense week-by-brand grid of ``weekly_bars``."""
    return dense_grid(weekly_bars(spark, sf_dir), extra=("segment",))

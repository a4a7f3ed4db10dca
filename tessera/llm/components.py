"""Connected components of an edge table by alternating large-star and small-star steps.

Edges stay in tables of the shared folder; each step is a minimum per node, combined before its shuffle,
and a join on the node that adaptive execution may split. Rounds grow with the logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(low, both["a"] == low["u"]).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    met = down.join(low, down["a"] == low["u"])
    return met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node of the component of every node that has an edge; roots map to themselves."""
    now = materialise(edges.select("a", "b").where("a <> b").distinct(), "star")
    seen = _fingerprint(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        now = materialise(_small_star(_large_star(now)), "star")
        mark = _fingerprint(now)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()

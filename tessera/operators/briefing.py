"""From a segment profile to a briefing: queries, passages under quotas, prompts, examples, and the funnel.

Text generation is injected: a table of outputs joins in where a model would run.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .evidence import claim_status, json_lines
from .retrieval import bm25, quota, top

# Profiles in our own words: segment, what it earns by, what moves it, what to watch.
PROFILES = (
    ("memory", "bit shipments and price per bit", ["average selling price", "inventory days", "capital spending"], ["supply discipline", "contract price talks"]),
    ("foundry", "wafers by node", ["utilisation", "gross margin by node", "prepayments"], ["node ramp", "customer concentration"]),
    ("software", "recurring subscriptions", ["net retention", "remaining obligations", "billings"], ["pricing change", "seat growth"]),
    ("payments", "share of volume processed", ["take rate", "payment volume", "loss rate"], ["routing rules", "cross-border recovery"]),
    ("default", "goods and services sold", ["revenue", "operating margin", "cash flow"], ["guidance", "demand"]),
)
GENERIC = ("results of operations compared with the year before", "risks that could hurt the business", "outlook and capital allocation")


class Retriever(Protocol):
    """Something that finds passages: a name, and ``fetch`` from cases (case_id, ticker, as_of) to passages."""

    name: str
    training_permitted: bool

    def fetch(self, cases: DataFrame) -> DataFrame: ...


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROFILES), "segment string, driver string, metrics array<string>, watch array<string>")


def segment_queries(profile: DataFrame) -> DataFrame:
    """(segment, query_no, query): a question per metric, per thing to watch, and the generic ones."""
    q = F.concat(F.transform("metrics", lambda m: F.concat(m, F.lit(" results and trend"))), "watch", F.array(*map(F.lit, GENERIC)))
    return profile.select("segment", F.posexplode(q).alias("query_no", "query"))


def with_segment(cases: DataFrame, dim: DataFrame) -> DataFrame:
    """Cases with their segment, ``default`` where the ticker has none."""
    return cases.join(dim.select("ticker", "segment"), "ticker", "left").withColumn("segment", F.coalesce("segment", F.lit("default")))


def first_wins(hits: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of the hits of several queries one row per key: the earliest query's."""
    w = Window.partitionBy(*by).orderBy(order)
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


class CorpusRetriever:
    """Passages of an indexed corpus for each case: its segment's queries, first-wins, section quotas, newest last."""

    name, training_permitted = "corpus", True

    def __init__(self, chunks: DataFrame, dim: DataFrame, per_query: int = 3, most: int = 10, quotas: dict[str, int] | None = None):
        self.chunks, self.dim, self.per_query, self.most = chunks, dim, per_query, most
        self.quotas = quotas or {"risk_factors": 2, "business": 1, "quantitative_qualitative": 1}

    def fetch(self, cases: DataFrame) -> DataFrame:
        """Every case searches the chunks of its ticker dated up to its own date; scores come from those alone."""
        spark = cases.sparkSession
        asked = with_segment(cases, self.dim).join(F.broadcast(segment_queries(profiles(spark))), "segment")
        terms = asked.select("case_id", "query_no", F.explode(F.filter(F.split(F.lower("query"), "[^a-z0-9]+"), lambda t: F.length(t) > 2)).alias("term")).distinct()
        seen = self.chunks.join(cases.select("case_id", "ticker", "as_of"), "ticker").where("doc_date <= as_of")
        words = seen.select("case_id", "chunk_id", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("term")).groupBy("case_id", "chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))
        hit = words.join(terms, ["case_id", "term"]).groupBy("case_id", "query_no", "chunk_id").agg(F.sum(F.log1p("tf")).alias("score"))
        ranked = top(hit.withColumn("query_id", F.struct("case_id", "query_no")), self.per_query, "chunk_id")
        one = first_wins(ranked, ["case_id", "chunk_id"], "query_no")
        one = one.join(seen.select("case_id", "chunk_id", "section", "doc_date", "ordinal", "text"), ["case_id", "chunk_id"])
        order = Window.partitionBy("case_id").orderBy(F.desc("score"), "chunk_id")
        one = one.withColumn("query_id", F.col("case_id")).withColumn("rank", F.row_number().over(order))
        kept = quota(one, F.coalesce("section", F.lit("plain")), self.quotas, self.most)
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("rank"))).where(F.col("rank") <= self.most)
        return kept.select("case_id", "chunk_id", "section", "doc_date", "ordinal", "score", "text")


def gather(retrievers: list[Retriever], cases: DataFrame) -> tuple[DataFrame | None, list[str]]:
    """(passages of all retrievers, warnings): a retriever that fails at planning is left out and named."""
    out, warnings = None, []
    for r in retrievers:
        try:
            got = r.fetch(cases).withColumn("retriever", F.lit(r.name))
            out = got if out is None else out.unionByName(got, allowMissingColumns=True)
        except Exception as error:
            warnings.append(f"{r.name}: {error}")
    return out, warnings


def render_sources(passages: DataFrame, key: str = "case_id", most: int = 4000) -> DataFrame:
    """(key, prompt): passages labelled S1, S2, ... in order; a case has few passages, capped by its quota."""
    w = Window.partitionBy(key).orderBy("doc_date", "ordinal", "chunk_id")
    lab = passages.withColumn("n", F.row_number().over(w))
    block = F.concat(F.lit("[S"), F.col("n").cast("string"), F.lit("]\n"), F.substring("text", 1, most))
    one = lab.select(key, F.struct("n", block.alias("t")).alias("b")).groupBy(key).agg(F.array_sort(F.collect_list("b")).alias("bs"))
    return one.select(key, F.array_join(F.transform("bs", lambda b: b["t"]), "\n\n").alias("prompt"))


def extract(outputs: DataFrame, demos: DataFrame, key: str = "case_id") -> DataFrame:
    """Claims with a first status from generated outputs (key, output)."""
    return claim_status(json_lines(outputs, key), demos)


def sft_status(candidates: DataFrame) -> Column:
    """Why a generated example (evidence, completion, ticker) is taken or not: no_evidence, invalid, ticker_drift, accepted."""
    c = F.from_json("completion", "ticker string, direction string, conviction double")
    valid = c["direction"].isin("long", "short", "flat") & c["conviction"].between(0, 1)
    return (
        F.when(F.coalesce(F.trim("evidence"), F.lit("")) == "", "no_evidence").when(~F.coalesce(valid, F.lit(False)), "invalid")
        .when(F.upper(c["ticker"]) != F.upper("ticker"), "ticker_drift").otherwise("accepted")
    )


def funnel(signals: DataFrame, n: int, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, list[str]]:
    """The ``n`` best-ranked signals through the steps; a step that fails is skipped with a warning."""
    out, warnings = signals.orderBy("rank").limit(n), []
    for name, step in steps:
        try:
            out = step(out)
        except Exception as error:
            warnings.append(f"{name}: {error}")
    return out, warnings


__all__ = ["CorpusRetriever", "Retriever", "bm25", "extract", "first_wins", "funnel", "gather", "profiles", "render_sources", "segment_queries", "sft_status", "with_segment"]

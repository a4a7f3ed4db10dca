"""A corpus pipeline of five stages: toxicity, exact dedup, near-duplicate join, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; what it returns is written as
Parquet in the shared folder and read again as the next one's docs. All stages but the last return the
columns of documents. Extra columns travel along; null texts count as empty and stay. Before each stage the
executors give back the heap that the stage before has left unused.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, ngram_join, packing, secrets, toxicity
from tessera.llm.common import materialise, rest, unused


def rested(stage: Callable) -> Callable:
    """The stage, begun with executors that hold no more heap than what lives in it."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rest(spark)
        return stage(spark, docs, sf_dir)

    return run


@rested
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go; the model learns from the labelled rows outside the held-out fold."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = unused(docs, "score")
    return toxicity.score(docs, model, name).where(F.col(name) < 0.5).drop(name)


@rested
def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the longest stays."""
    return exact_dedup.survivors(docs)


@rested
def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a shingle similarity of 0.8 or more, the one with the smallest id stays."""
    return ngram_join.survivors(docs)


@rested
def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mask; no document goes."""
    return secrets.redact(docs)


@rested
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact),
    ("ngram_jaccard_join", drop_near),
    ("secret_scan", hide_secrets),
    ("best_fit_packing", pack),
]

#: The classifier and the tokenizer can't be expressed in SQL; tests/llm/test_pipeline.py checks run() against a plain Python version of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents below ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs

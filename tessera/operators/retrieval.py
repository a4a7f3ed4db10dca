"""Metadata-filtered hybrid retrieval: BM25 postings, dense vectors, reciprocal-rank fusion, caps, evaluation.

Filters apply to inputs, so later documents are invisible to term statistics too; text is joined back
only for what survives the limit.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stem import stemmed

K1, B = 1.2, 0.75
RRF = 60


def candidates(chunks: DataFrame, *, equals: dict[str, list] | None = None, date: str = "doc_date", as_of: dt.date | None = None, since: dt.date | None = None) -> DataFrame:
    """Chained filters that reach the scan; a null date fails once a bound is set."""
    out = chunks
    for column, values in (equals or {}).items():
        out = out.where(F.col(column).isin(list(values)))
    if as_of is not None:
        out = out.where(F.col(date) <= F.lit(as_of))
    if since is not None:
        out = out.where(F.col(date) >= F.lit(since))
    return out


def tokens(text: Column) -> Column:
    """Lower-case ASCII terms."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf, dl): one row per document and term."""
    t = docs.select(key, tokens(F.col(text)).alias("t")).select(key, F.size("t").alias("dl"), F.explode("t").alias("term"))
    return t.groupBy(key, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", k1: float = K1, b: float = B, stems: bool = False) -> DataFrame:
    """(query_id, key, score) for queries (query_id, terms array); statistics over ``docs`` as given.

    With ``stems`` terms of both sides are reduced by Porter's algorithm.

    Only postings of query terms are aggregated; document lengths come with the explode, counts in one pass.
    """
    form = stemmed if stems else (lambda c: c)
    asked = queries.select("query_id", F.explode(form(F.col("terms"))).alias("term")).distinct()
    t = docs.select(key, form(tokens(F.col(text))).alias("t")).select(key, F.size("t").alias("dl"), "t")
    stats = t.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    hits = t.select(key, "dl", F.explode("t").alias("term")).join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    hits = hits.groupBy(key, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # stats is one row, df one per query term
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return weighted.select("term", key, part.alias("part")).join(F.broadcast(asked), "term").groupBy("query_id", key).agg(F.sum("part").alias("score"))


def top(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The ``k`` best per query with their rank; ties by key. Spark limits groups before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def l2_normalised(v: Column) -> Column:
    """The unit vector; a zero vector stays."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """(query_id, key, score, rank): exact inner products of every query with every vector, top ``k``.

    ``queries`` is a stated set, met by all vectors; the group limit keeps k per task before the shuffle.
    """
    q = queries.select("query_id", F.col("embedding").alias("q"))
    scored = vectors.join(q, vectors[key] != q["query_id"]).select("query_id", key, dot(F.col("embedding"), F.col("q")).alias("score"))
    return top(scored, k, key)


def fuse(lexical: DataFrame, vector: DataFrame, key: str = "doc_id", c: int = RRF) -> DataFrame:
    """Full outer join of two ranked lists with the sum of 1 / (c + rank)."""
    a = lexical.select("query_id", key, F.col("rank").alias("rank_bm25"), F.col("score").alias("s_bm25"))
    b = vector.select("query_id", key, F.col("rank").alias("rank_dense"), F.col("score").alias("s_dense"))
    part = lambda r: F.coalesce(1 / (c + F.col(r)), F.lit(0.0))
    return a.join(b, ["query_id", key], "full_outer").withColumn("rrf", part("rank_bm25") + part("rank_dense"))


def ranked(fused: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fusion order: best sum, then lexical rank, dense rank, key."""
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.asc_nulls_last("rank_bm25"), F.asc_nulls_last("rank_dense"), key)
    return fused.withColumn("rank", F.row_number().over(w))


def capped(hits: DataFrame, group: str, cap: int, k: int) -> DataFrame:
    """At most ``cap`` hits per query and group, then the ``k`` best per query, by ``rank``."""
    inside = Window.partitionBy("query_id", group).orderBy("rank")
    kept = hits.withColumn("_in", F.row_number().over(inside)).where(F.col("_in") <= cap).drop("_in")
    w = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def quota(hits: DataFrame, bucket: Column, quotas: dict[str, int], default: int) -> DataFrame:
    """At most the bucket's quota of hits per query, by ``rank``."""
    limit = F.lit(default)
    for name, n in quotas.items():
        limit = F.when(F.col("_b") == name, F.lit(n)).otherwise(limit)
    w = Window.partitionBy("query_id", "_b").orderBy("rank")
    return hits.withColumn("_b", bucket).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_b", "_r")


def is_gold(text: Column, anchor: str) -> Column:
    """A passage that answers: the anchor pattern and a digit."""
    return text.rlike(f"(?i){anchor}") & text.rlike("[0-9]")


def recall_and_rr(hits: DataFrame, gold: DataFrame, key: str, ks: tuple[int, ...] = (5, 20)) -> DataFrame:
    """Per query: recall at each k and reciprocal rank of the first gold hit; queries without gold are left out."""
    asked = gold.select("query_id").distinct()
    met = hits.join(gold.select("query_id", key), ["query_id", key], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    out = asked.join(met, "query_id", "left")
    return out.select("query_id", *((F.coalesce(F.col("first") <= k, F.lit(False)).cast("int")).alias(f"recall_{k}") for k in ks), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def thinned(df: DataFrame, key: str, most: int) -> DataFrame:
    """Every (n // most + 1)-th row by key where there are more than ``most``: a sampling operator."""
    n = df.count()
    if n <= most:
        return df
    step = n // most + 1
    w = Window.partitionBy(F.spark_partition_id()).orderBy(key)
    # Global number by range: rows are range-partitioned, numbered inside, and offset by what lies before.
    parts = df.repartitionByRange(key).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.row_number().over(w))
    before = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).withColumn("_o", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(F.broadcast(before), "_p").where((F.col("_i") - 1 + F.col("_o")) % step == 0).drop("_p", "_i", "_c", "_o")


def phrase_hits(docs: DataFrame, phrase: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n): places where the terms stand one after another, as a hyphenated query term is matched.

    One pass over the lower-cased text with the separators of ``tokens``. Over an array of terms the count would split the
    text anew at every place, as Spark moves the filter on it below the array. What follows the first term is looked
    ahead at, so that places may overlap.
    """
    if not phrase:
        raise ValueError("a phrase has at least one term")
    first, *rest = phrase
    plain = all(re.fullmatch("[a-z0-9]+", t) for t in phrase)  # no other term is ever one of ``tokens``
    pattern = f"(?<![a-z0-9]){first}(?={''.join(f'[^a-z0-9]++{t}' for t in rest)}(?![a-z0-9]))" if plain else "(?!)"
    low = F.lower(text)
    return docs.where(low.rlike(pattern)).select(key, F.regexp_count(low, F.lit(pattern)).cast("bigint").alias("n"))

"""Exact top-k search by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are quantised to integers. A shard of at most SHARD vectors keeps, per dimension, its vectors' numbers in
order of their value. A query reads the lists of its nonzero dimensions from the end that its sign favours,
scores every vector seen for the first time by random access, and stops once the bound, the sum of the
current list values times the query, is below the kth score. Every step reads on in the lists whose last entries
still add most to the bound. Ties go to the smaller vec_id, so a bound equal to the kth score goes on.

Queries go to the tasks in blocks of QUERIES, a broadcast of bounded size; a task streams its vectors through, and the
kth score that a query has reached in one shard is the bar for the next. What is shuffled is k rows per query and task.

Defined results: null vectors, null or non-finite components and null ids take no part; vectors of another
length than most meet only their own length; repeated rows are scored one by one; an empty table, or one
without queries, gives no rows; a score that a long can't hold
counts as the nearest long; only vec_id and embedding are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCALE = 1024
SHARD = 1 << 16
QUERIES = 4096
STEP = 32
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def finite(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(F.coalesce(fine, F.lit(True)))
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("v"))


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): 64-bit integers, or Python's where scores could exceed these."""
    whole = np.floor(x * float(SCALE))  # a power of two: the product is exact unless it overflows
    if x.size == 0 or (np.abs(x).max() < 2.0**20 and x.shape[-1] < 1 << 20):
        return whole.astype(np.int64)
    from fractions import Fraction

    return np.array([(Fraction(float(c)) * SCALE).__floor__() for c in x.ravel()], object).reshape(x.shape)


def _within(scores: np.ndarray) -> np.ndarray:
    """Scores as longs; one that a long can't hold is the nearest."""
    return scores if scores.dtype == np.int64 else np.array([min(MOST, max(LEAST, int(s))) for s in scores], np.int64)


class Shard:
    """Vectors with their sorted lists: lists[d] has vector numbers by falling value of dimension d, ranked[d] these values."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.lists = np.ascontiguousarray(np.argsort(-values, axis=0, kind="stable").T)
        self.ranked = np.take_along_axis(values.T, self.lists, axis=1)


def threshold_search(shard: Shard, query: np.ndarray, own: int, k: int, bar: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores, vectors scored) of the k best vectors of a shard for one query, ``own`` left out.

    Vectors that score below ``bar`` may be left out.
    """
    ids, values, n = shard.ids, shard.values, len(shard.ids)
    dims = np.flatnonzero(query)
    weight, up = query[dims], query[dims] > 0
    seen = ids == own
    left = n - int(seen.sum())
    best_id, best_score, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    depth = np.zeros(len(dims), np.int64)

    def entries(j, depths):
        return shard.lists[dims[j]][depths if up[j] else n - 1 - depths]

    def value(depths):
        """What each list adds to a score at a depth."""
        return weight * shard.ranked[dims, np.where(up, depths, n - 1 - depths)]

    middle = value(np.full(len(dims), n // 2)) if n and len(dims) else weight
    step = STEP
    while left:
        if len(dims):
            if depth.any():  # read on where the last entries are furthest above the list's middle
                last = value(np.maximum(depth - 1, 0)) - middle
                order = [j for j in np.argsort(-last, kind="stable") if depth[j] < n][: max(1, len(dims) // 4)]
            else:
                order = range(len(dims))
            block = []
            for j in order:
                upto = min(n, int(depth[j]) + step)
                block.append(entries(j, np.arange(depth[j], upto)))
                depth[j] = upto
            block = np.concatenate(block)
            step *= 2
        else:
            block = np.arange(n)
        before = seen.copy()
        seen[block] = True
        fresh = np.flatnonzero(seen & ~before)
        if len(fresh):
            left -= len(fresh)
            scored += len(fresh)
            score = _within(values[fresh] @ query)
            if bar is not None:
                fresh, score = fresh[score >= bar], score[score >= bar]
            best_id = np.concatenate([best_id, ids[fresh]])
            best_score = np.concatenate([best_score, score])
            top = np.lexsort((best_id, -best_score))[:k]
            best_id, best_score = best_id[top], best_score[top]
        floor = best_score[-1] if len(best_id) == k else bar
        if len(dims) and floor is not None and sum(map(int, value(depth - 1))) < floor:
            break
    return best_id, best_score, scored


class Search:
    """The k best vectors of every query of a block, shard after shard."""

    def __init__(self, names: np.ndarray, queries: list[np.ndarray], k: int):
        self.names, self.k = names, k
        self.queries = queries
        none = np.zeros(0, np.int64)
        self.best = [(none, none)] * len(names)
        self.scored = self.met = 0

    def add(self, ids: np.ndarray, raw: np.ndarray) -> None:
        """Search one shard: vectors of one length, as doubles."""
        shard = Shard(ids, quantised(raw))
        for i, (name, q) in enumerate(zip(self.names, self.queries, strict=True)):
            if len(q) != raw.shape[1]:
                continue
            if q.dtype != shard.values.dtype:
                shard, q = Shard(ids, shard.values.astype(object)), q.astype(object)
            had_id, had_score = self.best[i]
            got_id, got_score, scored = threshold_search(shard, q, name, self.k, had_score[-1] if len(had_id) == self.k else None)
            self.scored, self.met = self.scored + scored, self.met + len(ids)
            every_id, every_score = np.concatenate([had_id, got_id]), np.concatenate([had_score, got_score])
            top = np.lexsort((every_id, -every_score))[: self.k]
            self.best[i] = every_id[top], every_score[top]


def _by_length(ids: np.ndarray, vectors: list) -> list[tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([len(v) for v in vectors], np.int64)
    return [(ids[sizes == n], np.array([v for v in vectors if len(v) == n], np.float64).reshape(-1, n)) for n in np.unique(sizes)]


def _search(ref, k: int):
    def run(batches):
        names, raw = ref.value
        found = Search(names, [quantised(np.array(v, np.float64).reshape(1, -1))[0] for v in raw], k)
        held: dict[int, list] = {}

        def close(size):
            found.add(*(np.concatenate(x) for x in zip(*held.pop(size), strict=True)))

        for batch in batches:
            for ids, vectors in _by_length(batch.column(0).to_numpy(), batch.column(1).to_pylist()):
                size = vectors.shape[1]
                held.setdefault(size, []).append((ids, vectors))
                if sum(len(x) for x, _ in held[size]) >= SHARD:
                    close(size)
        for size in list(held):
            close(size)
        counts = [len(x) for x, _ in found.best]
        if sum(counts):
            columns = np.repeat(names, counts), *(np.concatenate(x) for x in zip(*found.best, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with the other vectors.

    One pass over the vectors for each block of QUERIES queries.
    """
    spark = vectors.sparkSession
    base, asked = finite(vectors), finite(queries)
    blocks = max(1, -(-asked.count() // QUERIES))
    found = None
    for b in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()  # about QUERIES rows
        ref = spark.sparkContext.broadcast((some.column(0).to_numpy(), some.column(1).to_pylist()))
        one = base.mapInArrow(_search(ref, k), "query_id bigint, vec_id bigint, score bigint")
        found = one if found is None else found.unionAll(one)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame, k: int = 10) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 100."""
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k)

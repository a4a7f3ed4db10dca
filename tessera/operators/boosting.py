"""Boosted regression trees over binned features, by the rules and settings of ``pyspark.ml``'s GBTRegressor.

There a tree takes a job or two a level, thousands of small ones for a fold. Here a fold of up to ``ROWS`` rows is
fitted by one task, all folds side by side; a larger one by several tasks at once (a barrier stage) that add up their
histograms, so that none holds all rows. Samples are drawn by a hash of the row, whichever task has it.
"""

from __future__ import annotations

import base64
import math
import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a fold in one task, about 100 MB while they are read.
ROWS = 1 << 19


class Settings(NamedTuple):
    trees: int
    depth: int
    step: float
    least: int
    rate: float
    features: float
    bins: int
    seed: int


def settings(est) -> Settings:
    """Those of a GBTRegressor for squared error; the features tried at a node are a share or all."""
    share = est.getFeatureSubsetStrategy()
    return Settings(est.getMaxIter(), est.getMaxDepth(), est.getStepSize(), est.getMinInstancesPerNode(), est.getSubsamplingRate(), 1.0 if share == "all" else float(share), est.getMaxBins(), est.getSeed())


def chance(h: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number of [0, 1) for each hash and tree (splitmix64)."""
    mask = (1 << 64) - 1
    x = h + np.uint64((seed * 0x632BE59BD9B4E019 + (tree + 1) * 0x9E3779B97F4A7C15) & mask)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def binned(values: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    """(features, rows): how many cuts lie below each value."""
    if any(np.isnan(v).any() for v in values):
        raise ValueError("a feature is null or NaN")
    return np.stack([np.searchsorted(c, v).astype(np.uint16) for v, c in zip(values, cuts, strict=True)])


def moved(at: np.ndarray, bins: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The next node of each row, nodes numbered as in a heap; a leaf keeps its rows."""
    f = feature[at]
    return np.where(f >= 0, 2 * at + 1 + (bins[f, np.arange(len(at))] > cut[at]), at)


def grow(bins: np.ndarray, y: np.ndarray, h: np.ndarray, s: Settings, total=lambda a: a) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature or -1, cut, value) by tree and node. ``total`` adds an array up over the tasks of the fold.

    The first tree fits the labels, later ones twice what is left (the slope of the squared error), with weight ``step``.
    """
    k, n = bins.shape
    size, some = 2 ** (s.depth + 1) - 1, math.ceil(s.features * k)
    feature, cut, value = np.full((s.trees, size), -1, np.int16), np.zeros((s.trees, size), np.int16), np.zeros((s.trees, size))
    score = np.zeros(n)
    for t in range(s.trees):
        goal = y if t == 0 else 2 * (y - score)
        sampled = chance(h, s.seed, t) < s.rate
        rnd = np.random.default_rng((s.seed & 0xFFFFFFFF, t))  # the same in all tasks
        at = np.zeros(n, np.int64)
        for level in range(s.depth):
            first, m = 2**level - 1, 2**level
            use = np.flatnonzero(sampled & (at >= first))
            place, g = (at[use] - first) * s.bins, goal[use]
            sums = np.empty((2, k, m * s.bins))
            for j in range(k):
                cell = place + bins[j, use]
                sums[0, j], sums[1, j] = np.bincount(cell, minlength=m * s.bins), np.bincount(cell, g, m * s.bins)
            left = total(sums).reshape(2, k, m, s.bins).cumsum(3)
            whole = left[..., -1:]
            right = whole - left
            if level == 0 and whole[0, 0, 0, 0]:
                value[t, 0] = whole[1, 0, 0, 0] / whole[0, 0, 0, 0]
            tried = rnd.random((k, m)).argsort(0).argsort(0) < some
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - whole[1] ** 2 / whole[0]
            ok = (left[0] >= max(s.least, 1)) & (right[0] >= max(s.least, 1)) & tried[:, :, None]
            gain = np.where(ok, gain, 0.0).transpose(1, 0, 2).reshape(m, -1)
            best = gain.argmax(1)
            split = np.flatnonzero(gain[np.arange(m), best] > 0)
            if not split.size:
                break
            f, c, nodes = best[split] // s.bins, best[split] % s.bins, first + split
            feature[t, nodes], cut[t, nodes] = f, c
            for side, add in ((left, 1), (right, 2)):
                value[t, 2 * nodes + add] = side[1, f, split, c] / side[0, f, split, c]
            at = moved(at, bins, feature[t], cut[t])
        score += (s.step if t else 1.0) * value[t, at]
    return feature, cut, value


def predict(bins: np.ndarray, model: tuple, s: Settings) -> np.ndarray:
    score = np.zeros(bins.shape[1])
    for t, (feature, cut, value) in enumerate(zip(*model, strict=True)):
        at = np.zeros(bins.shape[1], np.int64)
        for _ in range(s.depth):
            at = moved(at, bins, feature, cut)
        score += (s.step if t else 1.0) * value[at]
    return score


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def _together(a: np.ndarray) -> np.ndarray:
    """The sum over the tasks of the stage."""
    said = BarrierTaskContext.get().allGather(base64.b64encode(a.tobytes()).decode())
    return sum(np.frombuffer(base64.b64decode(x)).reshape(a.shape) for x in said)


def fit(train: DataFrame, names: list[str], label: str, est, by: str = "fold_id", row: tuple[str, ...] = ("date", "ticker"), rows: int = ROWS) -> dict:
    """{fold: (cuts, model)}; ``row`` tells the rows of a fold apart. What reaches the driver is the models."""
    s = settings(est)
    at = [i / s.bins for i in range(1, s.bins)]
    found = train.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(F.col(c).cast("double"), at).alias(f"q{i}") for i, c in enumerate(names)))
    folds = {r[by]: (r["n"], [np.unique(np.array(r[f"q{i}"], float)) for i in range(len(names))]) for r in found.collect()}  # a row for each fold
    keys = sorted(folds)
    cuts = [folds[key][1] for key in keys]
    number = F.array_position(F.array(*map(F.lit, keys)), F.col(by)).cast("int") - 1
    data = train.select(number.alias("_fold"), F.xxhash64(*row).alias("_h"), F.col(label).cast("double").alias("_y"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)))

    def task(several: bool, mine: int | None = None):
        total = _together if several else (lambda a: a)

        def run(batches):
            parts: dict[int, list] = {} if mine is None else {mine: [(np.zeros((len(names), 0), np.uint16), np.zeros(0), np.zeros(0, np.uint64))]}
            for b in batches:
                for fold in np.unique(b.column(0).to_numpy()):
                    one = b.filter(pa.compute.equal(b.column(0), pa.scalar(int(fold), b.column(0).type)))
                    y = _numbers(one.column(2))
                    if np.isnan(y).any():
                        raise ValueError("a label is null or NaN")
                    parts.setdefault(int(fold), []).append((binned([_numbers(c) for c in one.columns[3:]], cuts[fold]), y, one.column(1).to_numpy().view(np.uint64)))
            for fold in list(parts):
                bins, y, h = zip(*parts.pop(fold), strict=True)
                model = grow(np.concatenate(bins, 1), np.concatenate(y), np.concatenate(h), s, total)
                if not several or BarrierTaskContext.get().partitionId() == 0:
                    yield pa.record_batch([pa.array([fold], pa.int32()), pa.array([pickle.dumps(model)], pa.binary())], ["fold", "model"])

        return run

    models = {}
    small = [i for i, key in enumerate(keys) if folds[key][0] <= rows]
    if small:
        part = data.where(F.col("_fold").isin(small)).repartitionById(len(keys), F.col("_fold"))
        models |= {r["fold"]: r["model"] for r in part.mapInArrow(task(False), "fold int, model binary").collect()}
    for i in sorted(set(range(len(keys))) - set(small)):
        # All tasks of a barrier stage run at once, so there are no more of them than cores.
        n = min(math.ceil(folds[keys[i]][0] / rows), train.sparkSession.sparkContext.defaultParallelism)
        part = data.where(F.col("_fold") == i).repartitionById(n, F.pmod("_h", F.lit(n)).cast("int"))
        models |= {r["fold"]: r["model"] for r in part.mapInArrow(task(True, i), "fold int, model binary", barrier=True).collect()}
    return {key: (cuts[i], pickle.loads(models[i])) for i, key in enumerate(keys)}


def scores(test: DataFrame, fitted: dict, names: list[str], est, by: str = "fold_id", keep: tuple[str, ...] = ("date", "ticker")) -> DataFrame:
    """(by, keep, score) of each row by its fold's model; null in a fold without one."""
    s = settings(est)
    models = test.sparkSession.sparkContext.broadcast(fitted)
    out = test.select(by, *keep)
    schema = T.StructType([*out.schema.fields, T.StructField("score", T.DoubleType())])
    data = test.select(by, *keep, *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)))

    def run(batches):
        for b in batches:
            for fold in pa.compute.unique(b.column(0)):
                one = b.filter(pa.compute.equal(b.column(0), fold))
                if fold.as_py() in models.value:
                    cuts, model = models.value[fold.as_py()]
                    score = pa.array(predict(binned([_numbers(c) for c in one.columns[1 + len(keep) :]], cuts), model, s))
                else:
                    score = pa.nulls(one.num_rows, pa.float64())
                yield pa.record_batch([*one.columns[: 1 + len(keep)], score], schema.names)

    return data.mapInArrow(run, schema)

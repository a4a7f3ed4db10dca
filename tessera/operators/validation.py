"""Walk-forward validation: purged folds, rank information coefficients, spreads, permutation tests, ridge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import boosting
from .panel import pct_rank


def walk_forward(dates: DataFrame, splits: int = 5, horizon: int = 2, embargo: int | None = None, min_train: int = 150) -> DataFrame:
    """(fold_id, date, role): test blocks are equal slices after ``min_train`` dates, the last takes the remainder.

    Dates up to ``horizon`` before a test block are purged, up to ``embargo`` after it embargoed; all others,
    also later ones, train. Everything is closed form over the date's number.
    """
    embargo = horizon if embargo is None else embargo
    if embargo < horizon:
        raise ValueError("embargo must be at least the horizon")
    days = dates.select("date").distinct()
    n = days.count()
    if n < min_train + 2 * splits:
        raise ValueError(f"{n} dates are too few for {splits} folds after {min_train}")
    size = (n - min_train) // splits
    # The calendar is a dimension: one row per date.
    numbered = days.withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    folds = dates.sparkSession.range(splits).select(F.col("id").cast("int").alias("fold_id"))
    start = F.lit(min_train) + F.col("fold_id") * size
    end = F.when(F.col("fold_id") == splits - 1, F.lit(n)).otherwise(start + size)
    i = F.col("i")
    role = (
        F.when((i >= start) & (i < end), "test").when((i >= start - horizon) & (i < start), "purged").when((i >= end) & (i < end + embargo), "embargoed").otherwise("train")
    )
    return numbered.crossJoin(F.broadcast(folds)).select("fold_id", "date", role.alias("role"))


def leaks(folds: DataFrame, horizon: int) -> DataFrame:
    """Training dates whose label window [date, date + horizon rows] meets their fold's test dates; must be empty."""
    days = folds.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")))
    f = folds.join(days, "date")
    test = f.where("role = 'test'").groupBy("fold_id").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    return f.where("role = 'train'").join(F.broadcast(test), "fold_id").where(f"i <= hi and i + {horizon} >= lo").select("fold_id", "date")


def correlation(x: str, y: str) -> Column:
    """Pearson correlation; null where either side is constant (the built-in divides by zero there)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def rank_ic(rows: DataFrame, score: str, label: str, min_names: int = 10) -> DataFrame:
    """(date, ic): Spearman correlation of score and label over each date's complete pairs."""
    pairs = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    ranked = pairs.select("date", pct_rank(score).alias("rs"), pct_rank(label).alias("rl"))
    by = ranked.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rs").alias("ds"), F.countDistinct("rl").alias("dl"), correlation("rs", "rl").alias("ic"))
    return by.where((F.col("n") >= min_names) & (F.col("ds") >= 2) & (F.col("dl") >= 2)).select("date", "ic")


def ic_summary(ic: DataFrame, *keys: str) -> DataFrame:
    sd, n = F.stddev_samp("ic"), F.count("ic")
    return ic.groupBy(*keys).agg(
        n.alias("n_dates"), F.avg("ic").alias("mean_ic"), sd.alias("sd_ic"), F.try_divide(F.avg("ic"), sd / F.sqrt(n)).alias("t_stat"),
        F.try_divide(F.avg("ic"), sd).alias("ir"), F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"),
    )


def quantile_bucket(score: str, tie: str, q: int = 5) -> Column:
    """Equal-count bucket 0..q-1 of a row's first-come rank over its date, as a quantile cut makes them (ntile differs)."""
    r = F.row_number().over(Window.partitionBy("date").orderBy(score, tie))
    n = F.count(F.lit(1)).over(Window.partitionBy("date"))
    return F.greatest(F.ceil((r - 1) * q / (n - 1)), F.lit(1)) - 1


def quantile_spread(rows: DataFrame, score: str, label: str, q: int = 5, cost_bps: float = 10.0, min_names: int = 10) -> DataFrame:
    """One row: dates, mean gross and net top-minus-bottom return, and t of the gross spread."""
    pairs = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    n = F.count(F.lit(1)).over(Window.partitionBy("date"))
    pairs = pairs.withColumn("_n", n).where(F.col("_n") >= max(min_names, 2 * q)).withColumn("_b", quantile_bucket(score, "ticker", q))
    top, low = F.avg(F.when(F.col("_b") == q - 1, F.col(label))), F.avg(F.when(F.col("_b") == 0, F.col(label)))
    days = pairs.groupBy("date").agg((top - low).alias("spread"))
    m, s, k = F.avg("spread"), F.stddev_samp("spread"), F.count("spread")
    return days.agg(k.alias("n_dates"), m.alias("gross"), (m - cost_bps / 1e4).alias("net"), F.try_divide(m, s / F.sqrt(k)).alias("t_stat"))


def shuffle_test(rows: DataFrame, score: str, label: str, trials: int = 20, seed: int = 42) -> DataFrame:
    """One row: mean, sd and largest absolute mean IC when labels are permuted within dates, by a hash."""
    pairs = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select("date", "ticker", score, label)
    many = pairs.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    w = Window.partitionBy("trial", "date")
    left = many.select("trial", "date", score, F.row_number().over(w.orderBy("ticker")).alias("k"))
    right = many.select("trial", "date", F.col(label), F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "trial", "ticker"), "ticker")).alias("k"))
    both = left.join(right, ["trial", "date", "k"]).select(F.struct("trial", "date").alias("date"), score, label)
    ic = rank_ic(both, score, label).groupBy(F.col("date.trial").alias("trial")).agg(F.avg("ic").alias("ic"))
    return ic.agg(F.count("ic").alias("n_trials"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("sd_ic"), F.max(F.abs("ic")).alias("max_abs_ic"))


# ---- baselines


def baselines(seed: int = 42) -> dict[str, Column]:
    """Predictors over columns momentum_12_1, relative_strength_20d, reversal_5d; all but the random one are ranks."""
    return {
        "momentum": pct_rank("momentum_12_1"),
        "relative_strength": pct_rank("relative_strength_20d"),
        "reversal": pct_rank("reversal_5d"),
        "random": (F.pmod(F.xxhash64(F.lit(seed), "date", "ticker"), F.lit(1 << 30)) / float(1 << 30)),
    }


# ---- ridge by normal equations: one aggregation, coefficients solved in SQL for two centred features


def ridge_two(rows: DataFrame, x1: str, x2: str, y: str, alpha: float = 10.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Ridge coefficients with an unpenalised intercept, from sums alone (two features, closed form)."""
    s = rows.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"), *(F.avg(c).alias(f"m_{k}") for c, k in ((x1, "1"), (x2, "2"), (y, "y"))),
        *(F.sum(F.col(a) * F.col(b)).alias(f"s{k}") for a, b, k in ((x1, x1, "11"), (x2, x2, "22"), (x1, x2, "12"), (x1, y, "1y"), (x2, y, "2y"))),
    )
    c = {k: F.col(f"s{k}") - F.col("n") * F.col(f"m_{k[0]}") * F.col(f"m_{k[1]}") for k in ("11", "22", "12", "1y", "2y")}
    a, b, d = c["11"] + alpha, c["22"] + alpha, c["12"]
    det = a * b - d * d
    s = s.withColumns({"b1": F.try_divide(b * c["1y"] - d * c["2y"], det), "b2": F.try_divide(a * c["2y"] - d * c["1y"], det)})
    return s.withColumn("b0", F.col("m_y") - F.col("b1") * F.col("m_1") - F.col("b2") * F.col("m_2")).select(*by, "n", "b0", "b1", "b2")


def ridge(rows: DataFrame, features: list[str], y: str, alpha: float = 10.0, by: str = "fold_id") -> DataFrame:
    """(by, feature, coefficient), the intercept as feature "intercept": ridge over any features, the intercept unpenalised.

    One aggregation gives the sums of products of each group; groups are folds, so what is solved on the driver is
    a matrix of the number of features for each. Rows with a null take no part.
    """
    import numpy as np

    k, cols = len(features), [F.col(c).cast("double") for c in (*features, y)]
    full = rows.where(" and ".join(f"`{c}` is not null" for c in (*features, y)))
    sums = full.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array(*map(F.sum, cols)).alias("s"), F.array(*(F.sum(cols[i] * cols[j]) for i in range(k + 1) for j in range(i, k + 1))).alias("p"))
    out = []
    for r in sums.collect():  # one row per fold
        mean, prod = np.array(r["s"]) / r["n"], np.zeros((k + 1, k + 1))
        prod[np.triu_indices(k + 1)] = r["p"]
        prod = prod + np.triu(prod, 1).T - r["n"] * np.outer(mean, mean)
        beta = np.linalg.solve(prod[:k, :k] + alpha * np.eye(k), prod[:k, k])
        out += [(r[by], f, float(b)) for f, b in zip(features, beta, strict=True)] + [(r[by], "intercept", float(mean[k] - mean[:k] @ beta))]
    kind = rows.schema[by].dataType.simpleString()
    return rows.sparkSession.createDataFrame(out, f"{by} {kind}, feature string, coefficient double")


def ridge_scores(rows: DataFrame, coefficients: DataFrame, features: list[str], by: str = "fold_id") -> DataFrame:
    """``rows`` with a column ``score``; the coefficients are a row per fold once pivoted."""
    wide = coefficients.groupBy(by).pivot("feature", [*features, "intercept"]).agg(F.first("coefficient"))
    wide = wide.select(by, F.array(*(F.col(f"`{f}`") for f in (*features, "intercept"))).alias("_beta"))
    score = sum((F.col(f) * F.get("_beta", F.lit(i)) for i, f in enumerate(features)), F.get("_beta", F.lit(len(features))))
    return rows.join(F.broadcast(wide), by).withColumn("score", score).drop("_beta")


#: Boosting rounds of the production model.
TREES = 300


def gbdt(seed: int = 42, trees: int = TREES):
    """Boosted regression trees with the engine's defaults: the settings that ``boosting`` fits by."""
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(featuresCol="features", labelCol="label", maxDepth=4, maxIter=trees, stepSize=0.03, minInstancesPerNode=100, subsamplingRate=0.8, featureSubsetStrategy="0.7", seed=seed)


def walk_forward_predict(rows: DataFrame, folds: DataFrame, names: list[str], label: str, trees: int = TREES) -> DataFrame:
    """(fold_id, date, ticker, score) of models refitted per fold, all folds at once."""
    pick = lambda role: rows.join(F.broadcast(folds.where(F.col("role") == role).select("fold_id", "date")), "date")
    fitted = boosting.fit(pick("train"), names, label, gbdt(trees=trees))
    return boosting.scores(pick("test"), fitted, names, gbdt(trees=trees))


def gate(summary: DataFrame, min_ic: float = 0.03, min_t: float = 2.0, min_folds: int = 4) -> DataFrame:
    """Booleans of the acceptance gate over one row: mean_ic, t_stat, positive_folds, net, momentum_ic, random_ic."""
    checks = {
        "ic_ok": F.col("mean_ic") >= min_ic, "t_ok": F.col("t_stat") >= min_t, "folds_ok": F.col("positive_folds") >= min_folds,
        "net_ok": F.col("net") > 0, "beats_momentum": F.col("mean_ic") > F.col("momentum_ic"), "beats_random": F.col("mean_ic") > F.col("random_ic"),
    }
    out = summary.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in checks.items()})
    passed = F.lit(True)
    for k in checks:
        passed = passed & F.col(k)
    return out.withColumn("passed", passed)

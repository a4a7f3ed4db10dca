"""Trade journal, arm statistics, calibration, acceptance gate, contamination split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def opened(recommendations: DataFrame) -> DataFrame:
    """Recommendations that may open a trade: every direction but flat."""
    return recommendations.where("direction <> 'flat'")


def closed(trades: DataFrame, closes: DataFrame) -> DataFrame:
    """Trades with exits: raw return (negated for shorts) and return relative to the benchmark, null without one."""
    t = trades.join(closes, "trade_id", "left")
    raw = F.try_divide("exit_price", "entry_price") - 1
    raw = F.when(F.col("direction") == "short", F.lit(0.0) - raw).otherwise(raw)
    return t.withColumn("raw_return", raw).withColumn("relative_return", F.col("raw_return") - F.col("benchmark_return"))


def open_trades(trades: DataFrame, arm: str | None = None) -> DataFrame:
    out = trades.where("exit_date is null")
    return out if arm is None else out.where(F.col("arm") == arm)


def closed_trades(trades: DataFrame, arm: str | None = None) -> DataFrame:
    out = trades.where("exit_date is not null")
    return out if arm is None else out.where(F.col("arm") == arm)


def performance_by_arm(trades: DataFrame, arm: str = "arm", value: str = "relative_return") -> DataFrame:
    """n, mean, hit rate, deviation (0 for one trade), t (null where the deviation is 0); arms without returns are left out."""
    x = F.col(value)
    sd = F.coalesce(F.stddev_samp(x), F.lit(0.0))
    n = F.count(x)
    return trades.where(x.isNotNull()).groupBy(arm).agg(
        n.alias("n"), F.avg(x).alias("mean"), F.avg((x > 0).cast("double")).alias("hit_rate"), sd.alias("sd"),
        F.try_divide(F.avg(x), F.when(sd > 0, sd / F.sqrt(n))).alias("t_stat"),
    )


def wilson(successes: Column, n: Column, z: float = 1.96) -> Column:
    """Struct (low, high): Wilson interval, clamped; (0, 1) for no trials."""
    nn = F.when(n > 0, n.cast("double"))
    p = successes / nn
    mid = (p + z * z / (2 * nn)) / (1 + z * z / nn)
    half = z * F.sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn)) / (1 + z * z / nn)
    return F.struct(F.coalesce(F.greatest(mid - half, F.lit(0.0)), F.lit(0.0)).alias("low"), F.coalesce(F.least(mid + half, F.lit(1.0)), F.lit(1.0)).alias("high"))


def calibration_bins(df: DataFrame, confidence: str, outcome: str, bins: int = 5) -> DataFrame:
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(outcome).cast("double")).alias("accuracy"))


def calibration_error(df: DataFrame, confidence: str, outcome: str, bins: int = 5) -> DataFrame:
    """One row: expected calibration error over equal bins, the last closed."""
    b = calibration_bins(df, confidence, outcome, bins)
    return b.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def arm_gate(arms: DataFrame, accuracy: float = 0.55, low: float = 0.5, ece: float = 0.15, least: int = 150, margin: float = 0.03, skill: float = 0.02, fmt: float = 0.95, lap: float = 0.15) -> DataFrame:
    """Per arm (accuracy, ci_low, ece, n, format_rate, baseline, lap_excess): criteria, warning and decision.

    An arm within ``skill`` of a coin is uninformative, and doesn't pass whatever its margin.
    """
    c = {
        "accurate": F.col("accuracy") >= accuracy, "significant": F.col("ci_low") > low, "calibrated": F.col("ece") <= ece, "enough": F.col("n") >= least,
        "formatted": F.col("format_rate") >= fmt, "beats_baseline": F.col("accuracy") - F.col("baseline") >= margin, "informative": F.abs(F.col("accuracy") - 0.5) > skill,
    }
    out = arms.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in c.items()})
    passed = F.lit(True)
    for k in c:
        passed = passed & F.col(k)
    return out.withColumns({"passed": passed, "lap_warning": F.coalesce(F.col("lap_excess") > lap, F.lit(False))})


def lap_answer(response: Column) -> Column:
    """UP or DOWN from free text; null if neither stands there."""
    return F.nullif(F.upper(F.regexp_extract(response, r"(?i)\b(UP|DOWN)\b", 1)), F.lit(""))


def lap_score(cases: DataFrame) -> DataFrame:
    """One row over cases (realized_up, response): parsed, accuracy of parsed, excess over chance; nulls if none parsed."""
    a = lap_answer(F.col("response"))
    right = (a == "UP") == F.col("realized_up")
    acc = F.avg(F.when(a.isNotNull(), right.cast("double")))
    return cases.agg(F.count(F.lit(1)).alias("n"), F.count(a).alias("n_parsed"), acc.alias("accuracy"), (acc - 0.5).alias("excess"))


def contaminated(cases: DataFrame, *keys: str) -> DataFrame:
    """Keys whose parsed answer is right: the model may know the outcome."""
    a = lap_answer(F.col("response"))
    return cases.where(a.isNotNull() & ((a == "UP") == F.col("realized_up"))).select(*keys).distinct()


def split_by(setups: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(clean, contaminated): a partition of the setups."""
    return setups.join(keys, on, "left_anti"), setups.join(keys, on, "left_semi")


def reward_risk(entry: Column, target: Column, invalidation: Column) -> Column:
    return F.coalesce(F.try_divide(F.abs(target - entry), F.abs(entry - invalidation)), F.lit(float("inf")))


def invalid_recommendations(recs: DataFrame) -> DataFrame:
    """Recommendations that break the contract: kinds bull, base, bear once each; probabilities within [0.95, 1.05] in sum;
    conviction in [0, 1]; the chosen scenario of a direction other than flat has levels, all positive and apart."""
    kinds = F.array_sort(F.transform("scenarios", lambda s: s["kind"]))
    total = F.aggregate("scenarios", F.lit(0.0), lambda a, s: a + s["probability"])
    chosen = F.filter("scenarios", lambda s: s["kind"] == F.col("chosen"))
    lv = F.get(chosen, F.lit(0))["levels"]
    level_ok = lv.isNotNull() & (lv["entry"] > 0) & (lv["target"] > 0) & (lv["invalidation"] > 0) & (lv["target"] != lv["entry"]) & (lv["invalidation"] != lv["entry"])
    ok = (kinds == F.array(F.lit("base"), F.lit("bear"), F.lit("bull"))) & total.between(0.95, 1.05) & F.col("conviction").between(0, 1) & (F.size(chosen) == 1)
    return recs.where(~F.coalesce(ok & ((F.col("direction") == "flat") | level_ok), F.lit(False)))


def entry_price(scenarios: Column, chosen: Column) -> Column:
    return F.get(F.filter(scenarios, lambda s: s["kind"] == chosen), F.lit(0))["levels"]["entry"]


def provenance_key(*fields: str) -> Column:
    """16 hex digits of the SHA-256 of the fields as JSON, in the given order."""
    return F.substring(F.sha2(F.to_json(F.struct(*fields)), 256), 1, 16)

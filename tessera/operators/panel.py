"""Cross-sectional panels on a dense date-by-ticker grid: features, labels, normalisation, coverage.

Everything is long: one row per (date, ticker). Lags count grid rows, so a missing cell stays as a row with
nulls; masking nulls values and never drops rows. All frames are windows partitioned by ticker or date.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BARS = ("open", "high", "low", "close", "adj_close", "volume")


def dense_grid(bars: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """All (date, ticker) cells of the calendar and the ticker list; absent cells hold nulls.

    Both sides of the product are dimensions (distinct dates, distinct tickers), not data rows.
    """
    tickers = bars.select("ticker", *extra).distinct()
    return bars.select("date").distinct().crossJoin(tickers).join(bars.drop(*extra), ["date", "ticker"], "left")


def split_adjusted(panel: DataFrame) -> DataFrame:
    """Open, high and low scaled by adj_close / close, close replaced by adj_close; a zero close gives null."""
    factor = F.try_divide(F.col("adj_close"), F.when(F.col("close") != 0, F.col("close")))
    return panel.withColumns({c: F.col(c) * factor for c in ("open", "high", "low")} | {"close": F.col("adj_close")})


def trailing(k: int):
    return Window.partitionBy("ticker").orderBy("date").rowsBetween(1 - k, 0)


def by_ticker():
    return Window.partitionBy("ticker").orderBy("date")


def by_date():
    return Window.partitionBy("date")


def rolled(agg: Callable[[Column], Column], c: Column, k: int, least: int) -> Column:
    """``agg`` over the last ``k`` rows where at least ``least`` of them are not null."""
    w = trailing(k)
    return F.when(F.count(c).over(w) >= least, agg(c).over(w))


def dollar_volume(k: int = 60, least: int = 30) -> Column:
    """Mean of close times volume over ``k`` rows."""
    return rolled(F.avg, F.col("close") * F.col("volume"), k, least)


def liquidity_mask(panel: DataFrame, min_price: float = 5.0, min_dollar_volume: float = 1e7) -> DataFrame:
    """Null the values of illiquid cells, keep the rows; adds ``dollar_volume`` and ``liquid``."""
    p = panel.withColumn("dollar_volume", dollar_volume())
    ok = F.coalesce((F.col("close") >= min_price) & (F.col("dollar_volume") >= min_dollar_volume), F.lit(False))
    p = p.withColumn("liquid", ok)
    return p.withColumns({c: F.when(F.col("liquid"), F.col(c)) for c in BARS if c in p.columns})


def change(k: int) -> Column:
    """close over its value ``k`` rows before, less one; null where either is null or the past is zero."""
    return F.try_divide(F.col("close"), F.lag("close", k).over(by_ticker())) - 1


@dataclass(frozen=True)
class Feature:
    """A named feature: columns it needs first, in stages, and its expression over them."""

    name: str
    expr: Callable[[], Column]
    stages: tuple[tuple[str, Callable[[], Column]], ...] = ()


REGISTRY: dict[str, Feature] = {}


def register(name: str, *stages: tuple[str, Callable[[], Column]]):
    """Register a feature builder; a name can be taken once."""

    def add(fn: Callable[[], Column]):
        if name in REGISTRY:
            raise ValueError(f"feature {name!r} already registered")
        REGISTRY[name] = Feature(name, fn, stages)
        return fn

    return add


def get(name: str) -> Feature:
    if name not in REGISTRY:
        raise KeyError(f"unknown feature {name!r}; available: {sorted(REGISTRY)}")
    return REGISTRY[name]


_RET = ("_ret", lambda: change(1))
_R20 = ("_r20", lambda: change(20))
_R60 = ("_r60", lambda: change(60))
_SECTOR = ("_sector", lambda: F.avg("_ret").over(by_date()))
# The pair is complete where both are known, so a covariance counts pairs only.
_BETA = ("_beta", lambda: _beta())


def _beta() -> Column:
    w = trailing(60)
    pair = F.col("_ret") * 0 + F.col("_sector")
    n = F.count(pair).over(w)
    return F.when(n >= 40, F.try_divide(F.covar_samp("_ret", "_sector").over(w), F.var_samp(F.when(F.col("_ret").isNotNull(), F.col("_sector"))).over(w)))


@register("momentum_12_1")
def _() -> Column:
    return F.try_divide(F.lag("close", 21).over(by_ticker()), F.lag("close", 252).over(by_ticker())) - 1


@register("momentum_20d")
def _() -> Column:
    return change(20)


@register("momentum_60d")
def _() -> Column:
    return change(60)


@register("relative_strength_20d", _R20)
def _() -> Column:
    return F.col("_r20") - F.avg("_r20").over(by_date())


@register("relative_strength_60d", _R60)
def _() -> Column:
    return F.col("_r60") - F.avg("_r60").over(by_date())


@register("volatility_20d", _RET)
def _() -> Column:
    return rolled(F.stddev_samp, F.col("_ret"), 20, 10) * math.sqrt(252)


@register("volatility_regime", _RET)
def _() -> Column:
    return F.try_divide(rolled(F.stddev_samp, F.col("_ret"), 20, 10), rolled(F.stddev_samp, F.col("_ret"), 120, 60))


@register("volume_trend")
def _() -> Column:
    return F.try_divide(rolled(F.avg, F.col("volume"), 20, 10), rolled(F.avg, F.col("volume"), 60, 30))


@register("dollar_volume_trend")
def _() -> Column:
    traded = F.col("close") * F.col("volume")
    return F.try_divide(rolled(F.avg, traded, 20, 10), rolled(F.avg, traded, 60, 30))


@register("distance_from_high_252d")
def _() -> Column:
    return F.try_divide(F.col("close"), rolled(F.max, F.col("close"), 252, 60)) - 1


@register("distance_from_high_60d")
def _() -> Column:
    return F.try_divide(F.col("close"), rolled(F.max, F.col("close"), 60, 20)) - 1


def group_demean(c: str, group: str = "segment") -> Column:
    """Less the mean of its group that date; groups of one ticker stay raw. Needs ``_group_size``, see ``with_group_size``."""
    mean = F.avg(c).over(Window.partitionBy("date", group))
    return F.when(F.col("_group_size") >= 2, F.col(c) - mean).otherwise(F.col(c))


def with_group_size(panel: DataFrame, group: str = "segment") -> DataFrame:
    """Number of tickers of the panel in each group, as ``_group_size``."""
    sizes = panel.groupBy(group).agg(F.countDistinct("ticker").alias("_group_size"))
    return panel.join(sizes, group, "left")


@register("subsegment_rel_20d", _R20)
def _() -> Column:
    return group_demean("_r20")


@register("subsegment_rel_60d", _R60)
def _() -> Column:
    return group_demean("_r60")


@register("beta_60d", _RET, _SECTOR)
def _() -> Column:
    return _beta()


@register("residual_momentum_60d", _RET, _SECTOR, _BETA, ("_resid", lambda: F.col("_ret") - F.col("_beta") * F.col("_sector")))
def _() -> Column:
    return rolled(F.sum, F.col("_resid"), 60, 40)


@register("trend_quality_60d", ("_ln", lambda: F.when(F.col("close") > 0, F.ln("close"))), ("_t", lambda: F.row_number().over(by_ticker()).cast("double")))
def _() -> Column:
    w = trailing(60)
    full = (F.count("_ln").over(w) == 60) & (F.var_pop("_ln").over(w) > 0)
    return F.when(full, F.signum(F.regr_slope("_ln", "_t").over(w)) * F.regr_r2("_ln", "_t").over(w))


@register("risk_adjusted_momentum_60d", _RET, _R60)
def _() -> Column:
    return F.try_divide(F.col("_r60"), rolled(F.stddev_samp, F.col("_ret"), 60, 40) * math.sqrt(252))


@register("reversal_5d")
def _() -> Column:
    return -change(5)


@register("close_location_20d", ("_place", lambda: F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low"))))
def _() -> Column:
    return rolled(F.avg, F.col("_place"), 20, 10)


@register("intraday_range_20d", ("_range", lambda: F.try_divide(F.col("high") - F.col("low"), F.col("close"))))
def _() -> Column:
    return rolled(F.avg, F.col("_range"), 20, 10)


@register("overnight_gap_20d", ("_gap", lambda: F.try_divide(F.col("open"), F.lag("close", 1).over(by_ticker())) - 1))
def _() -> Column:
    return rolled(F.avg, F.col("_gap"), 20, 10)


@register("amihud_illiquidity_60d", _RET, ("_impact", lambda: F.try_divide(F.abs("_ret"), F.col("close") * F.col("volume")) * 1e9))
def _() -> Column:
    return rolled(F.avg, F.col("_impact"), 60, 30)


#: Named feature sets.
V1 = ("momentum_12_1", "momentum_20d", "momentum_60d", "relative_strength_20d", "relative_strength_60d", "volatility_20d", "volatility_regime", "volume_trend", "dollar_volume_trend", "distance_from_high_252d", "distance_from_high_60d")
ORTHOGONAL = ("subsegment_rel_20d", "subsegment_rel_60d", "residual_momentum_60d", "beta_60d", "trend_quality_60d", "risk_adjusted_momentum_60d", "reversal_5d", "close_location_20d", "intraday_range_20d", "overnight_gap_20d", "amihud_illiquidity_60d")


def compute(panel: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``panel`` with the named features; intermediate columns are shared and dropped at the end."""
    chosen = [get(n) for n in names]
    p = panel
    if any(n.startswith("subsegment") for n in names):
        p = with_group_size(p)
    done: set[str] = set()
    for depth in range(max((len(f.stages) for f in chosen), default=0)):
        fresh = {f.stages[depth][0]: f.stages[depth][1]() for f in chosen if len(f.stages) > depth and f.stages[depth][0] not in done}
        done |= fresh.keys()
        p = p.withColumns(fresh)
    p = p.withColumns({f.name: f.expr() for f in chosen})
    return p.drop(*done, "_group_size")


# ---- normalisation across one date


def pct_rank(c: str | Column) -> Column:
    """Rank over the date's non-null values, average of ties, over their count; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    ranked = Window.partitionBy("date", c.isNull()).orderBy(c)
    ties = Window.partitionBy("date", c)
    return F.when(c.isNotNull(), (F.rank().over(ranked) + (F.count(F.lit(1)).over(ties) - 1) / 2) / F.count(c).over(by_date()))


def zscore(c: str, clip: float = 3.0) -> Column:
    """Standard score over the date (population deviation), clipped; zero deviation gives null."""
    z = F.try_divide(F.col(c) - F.avg(c).over(by_date()), F.stddev_pop(c).over(by_date()))
    return F.when(z.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))


def normalise(panel: DataFrame, names: tuple[str, ...], method: str = "rank") -> DataFrame:
    """Replace features by their rank, z-score, or leave them (``none``)."""
    how = {"rank": pct_rank, "zscore": zscore, "none": lambda c: F.col(c)}
    if method not in how:
        raise ValueError(f"unknown normalisation {method!r}")
    return panel.withColumns({n: how[method](n) for n in names})


# ---- labels


def forward_return(horizon: int = 10) -> Column:
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    return F.try_divide(F.lead("close", horizon).over(by_ticker()), F.col("close")) - 1


def loo_benchmark(fwd: str = "fwd") -> Column:
    """Mean forward return of the date's other names; null where the own one is null or there is no other."""
    others = F.count(fwd).over(by_date()) - 1
    return F.try_divide(F.sum(fwd).over(by_date()) - F.col(fwd), F.when(others > 0, others))


def relative_labels(panel: DataFrame, horizon: int = 10, min_names: int = 10) -> DataFrame:
    """Adds fwd, benchmark and fwd_rel_return; dates with fewer than ``min_names`` forward returns get null labels."""
    p = panel.withColumn("fwd", forward_return(horizon)).withColumn("benchmark", loo_benchmark())
    enough = F.count("fwd").over(by_date()) >= min_names
    return p.withColumn("fwd_rel_return", F.when(enough, F.col("fwd") - F.col("benchmark")))


def model_rows(panel: DataFrame, names: tuple[str, ...], label: str = "fwd_rel_return") -> DataFrame:
    """Rows with a label and at least one feature; a missing feature becomes the middle of the ranks."""
    return panel.where(F.col(label).isNotNull() & F.coalesce(*names).isNotNull()).fillna(0.5, subset=list(names))


def rebalance_dates(panel: DataFrame, weekday: int = 6) -> DataFrame:
    """Rows on one weekday (Spark numbering, Friday is 6); a week without that date vanishes."""
    return panel.where(F.dayofweek("date") == weekday)


# ---- coverage


def coverage_report(panel: DataFrame, delisted: DataFrame | None = None) -> DataFrame:
    """Per date: configured, listed so far, alive among delisted, available, missing and the ratio available to expected."""
    configured = panel.select("ticker").distinct().count()
    first = panel.where("close is not null").groupBy("ticker").agg(F.min("date").alias("date"))
    listed = first.groupBy("date").agg(F.count(F.lit(1)).alias("new"))
    days = panel.groupBy("date").agg(F.count("close").alias("n_available")).join(listed, "date", "left")
    # One row per date: the running count is over the calendar, which doesn't grow with the tickers.
    so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("n_listed", F.coalesce(F.sum("new").over(so_far), F.lit(0))).drop("new")
    if delisted is not None:
        gone = days.select("date").join(delisted, F.col("exit_date") >= F.col("date")).groupBy("date").agg(F.count(F.lit(1)).alias("n_delisted"))
        days = days.join(gone, "date", "left").withColumn("n_delisted", F.coalesce("n_delisted", F.lit(0)))
    else:
        days = days.withColumn("n_delisted", F.lit(0).cast("bigint"))
    expected = F.col("n_listed") + F.col("n_delisted")
    return days.select(
        "date",
        F.lit(configured).cast("bigint").alias("n_configured"),
        expected.alias("n_expected"),
        "n_available",
        F.greatest(expected - F.col("n_available"), F.lit(0)).alias("n_missing"),
        (F.col("n_available") / F.greatest(expected, F.lit(1))).alias("coverage"),
    )


def coverage_by_year(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy(F.year("date").alias("year")).agg(F.avg("coverage").alias("mean_coverage"), F.min("coverage").alias("min_coverage"), F.count(F.lit(1)).alias("n_dates"))


def coverage_summary(coverage: DataFrame) -> DataFrame:
    """One row: mean, minimum, the year with the lowest mean, and whether the mean is low (below 0.8)."""
    years = coverage_by_year(coverage).agg(F.min_by("year", F.struct("mean_coverage", "year")).alias("worst_year"))
    total = coverage.agg(F.avg("coverage").alias("mean_coverage"), F.min("coverage").alias("min_coverage"))
    return total.join(years).withColumn("low_coverage", F.col("mean_coverage") < 0.8)

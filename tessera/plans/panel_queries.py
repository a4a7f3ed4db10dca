"""Queries over the weekly panel, with independent SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators import validation as V
from ..sources.panel import weekly_panel
from ..sources.tables import saved, table
from .catalog import query

GRID = """
    with unit as (
        select cast(date_trunc('week', l_shipdate) as date) date, p_brand ticker, l_extendedprice / l_quantity price, l_quantity, l_shipdate, l_orderkey, l_linenumber
        from lineitem join part on l_partkey = p_partkey),
    bars as (
        select date, ticker, round(first(price order by l_shipdate, l_orderkey, l_linenumber) + 1e-8, 4) open, round(max(price) + 1e-8, 4) high, round(min(price) + 1e-8, 4) low,
               round(cast(sum(cast(price as decimal(18,6))) as double) / count(*) + 1e-8, 4) as close, sum(l_quantity) volume
        from unit group by 1, 2),
    panel as (
        select d.date, t.ticker, t.segment, open, high, low, close, close adj_close, volume
        from (select distinct date from bars) d
        cross join (select distinct ticker, cast(regexp_extract(ticker, '([0-9]+)', 1) as integer) % 5 segment from bars) t
        left join bars on bars.date = d.date and bars.ticker = t.ticker)"""
W = "over (partition by ticker order by date)"


def _roll(agg: str, c: str, k: int, least: int) -> str:
    w = f"over (partition by ticker order by date rows between {k - 1} preceding and current row)"
    return f"case when count({c}) {w} >= {least} then {agg}({c}) {w} end"


def _chg(k: int) -> str:
    return f"(close / nullif(lag(close, {k}) {W}, 0) - 1)"


def _feature_query(name: str, columns: dict[str, str], stages: list[dict[str, str]] = ()) -> None:
    ctes, last = GRID, "panel"
    for i, stage in enumerate(stages):
        ctes += f",\n    s{i} as (select *, " + ", ".join(f"{e} as {c}" for c, e in stage.items()) + f" from {last})"
        last = f"s{i}"
    sql = ctes + "\n    select date, ticker, " + ", ".join(f"round({e}, 6) as {c}" for c, e in columns.items()) + f" from {last}"

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = P.compute(weekly_panel(spark, sf_dir), tuple(columns))
        return p.select("date", "ticker", *(F.round(c, 6).alias(c) for c in columns))


ROOT = f"{math.sqrt(252)!r}"
RET = {"ret": _chg(1)}
R = {"r20": _chg(20), "r60": _chg(60)}
_feature_query("feat_momentum", {"momentum_12_1": f"lag(close, 21) {W} / nullif(lag(close, 252) {W}, 0) - 1", "momentum_20d": _chg(20), "momentum_60d": _chg(60), "reversal_5d": f"-{_chg(5)}"})
_feature_query("feat_relative_strength", {"relative_strength_20d": "r20 - avg(r20) over (partition by date)", "relative_strength_60d": "r60 - avg(r60) over (partition by date)"}, [R])
_feature_query(
    "feat_volatility",
    {
        "volatility_20d": f"({_roll('stddev_samp', 'ret', 20, 10)}) * {ROOT}",
        "volatility_regime": f"({_roll('stddev_samp', 'ret', 20, 10)}) / nullif({_roll('stddev_samp', 'ret', 120, 60)}, 0)",
        "risk_adjusted_momentum_60d": f"{_chg(60)} / nullif(({_roll('stddev_samp', 'ret', 60, 40)}) * {ROOT}, 0)",
    },
    [RET],
)
_feature_query(
    "feat_volume",
    {
        "volume_trend": f"({_roll('avg', 'volume', 20, 10)}) / nullif({_roll('avg', 'volume', 60, 30)}, 0)",
        "dollar_volume_trend": f"({_roll('avg', 'traded', 20, 10)}) / nullif({_roll('avg', 'traded', 60, 30)}, 0)",
    },
    [{"traded": "close * volume"}],
)
_feature_query("feat_drawdown", {"distance_from_high_252d": f"close / ({_roll('max', 'close', 252, 60)}) - 1", "distance_from_high_60d": f"close / ({_roll('max', 'close', 60, 20)}) - 1"})
_SEG = "(select count(distinct ticker) from panel q where q.segment = s0.segment)"
_feature_query(
    "feat_subsegment",
    {f"subsegment_rel_{k}d": f"case when {_SEG} >= 2 then r{k} - avg(r{k}) over (partition by date, segment) else r{k} end" for k in (20, 60)},
    [R],
)
W60 = "over (partition by ticker order by date rows between 59 preceding and current row)"
BETA = f"case when count(case when ret is not null and sector is not null then 1 end) {W60} >= 40 then covar_samp(ret, sector) {W60} / nullif(var_samp(case when ret is not null then sector end) {W60}, 0) end"
_feature_query(
    "feat_beta_resid",
    {"beta_60d": "beta", "residual_momentum_60d": _roll("sum", "resid", 60, 40)},
    [RET, {"sector": "avg(ret) over (partition by date)"}, {"beta": BETA}, {"resid": "ret - beta * sector"}],
)
_feature_query(
    "feat_trend_quality",
    {"trend_quality_60d": f"case when count(ln) {W60} = 60 and var_pop(ln) {W60} > 0 then sign(regr_slope(ln, t) {W60}) * regr_r2(ln, t) {W60} end"},
    [{"ln": "case when close > 0 then ln(close) end", "t": f"cast(row_number() {W} as double)"}],
)
_feature_query(
    "feat_intraday",
    {f"{n}_20d": _roll("avg", c, 20, 10) for n, c in (("close_location", "place"), ("intraday_range", "rng"), ("overnight_gap", "gap"))},
    [{"place": "(close - low) / nullif(high - low, 0)", "rng": "(high - low) / nullif(close, 0)", "gap": f"open / nullif(lag(close, 1) {W}, 0) - 1"}],
)
_feature_query("feat_amihud", {"amihud_illiquidity_60d": _roll("avg", "impact", 60, 30)}, [RET, {"impact": "abs(ret) / nullif(close * volume, 0) * 1e9"}])


@query("panel_grid", GRID + " select date, ticker, segment, open, high, low, close, adj_close, volume from panel")
def panel_grid(spark, sf_dir):
    return weekly_panel(spark, sf_dir).select("date", "ticker", "segment", *P.BARS)


@query("ohlc_split_adjust", GRID + ", a as (select *, case when ticker like '%1' then close / 2 else close end adj from panel) select date, ticker, round(open * (adj / nullif(close, 0)), 5) open, round(high * (adj / nullif(close, 0)), 5) high, round(low * (adj / nullif(close, 0)), 5) low, round(adj, 5) as close from a")
def ohlc_split_adjust(spark, sf_dir):
    p = weekly_panel(spark, sf_dir).withColumn("adj_close", F.when(F.col("ticker").endswith("1"), F.col("close") / 2).otherwise(F.col("close")))
    return P.split_adjusted(p).select("date", "ticker", *(F.round(c, 5).alias(c) for c in ("open", "high", "low", "close")))


MASK = f", dv as (select *, {_roll('avg', 'traded', 60, 30)} dollar_volume from (select *, close * volume traded from panel)), masked as (select date, ticker, segment, coalesce(close >= 1000 and dollar_volume >= 100000, false) liquid, dollar_volume, close from dv)"


@query("liquidity_mask", GRID + MASK + " select date, ticker, liquid, round(dollar_volume + 1e-6, 2) dollar_volume, case when liquid then close end as close from masked")
def liquidity_mask(spark, sf_dir):
    return P.liquidity_mask(weekly_panel(spark, sf_dir), 1000, 100_000).select("date", "ticker", "liquid", F.round(F.col("dollar_volume") + 1e-6, 2).alias("dollar_volume"), "close")


COVER = GRID + """
    , first as (select ticker, min(date) date from panel where close is not null group by 1),
    cdays as (select date, count(close) n_available from panel group by 1),
    cover as (
        select date, (select count(distinct ticker) from panel) n_configured,
               (select count(*) from first f where f.date <= cdays.date) n_expected, n_available
        from cdays)"""


@query("coverage_report", COVER + " select date, n_configured, n_expected, n_available, greatest(n_expected - n_available, 0) n_missing, round(n_available / greatest(n_expected, 1), 6) coverage from cover")
def coverage_report(spark, sf_dir):
    return P.coverage_report(weekly_panel(spark, sf_dir)).select("date", "n_configured", "n_expected", "n_available", "n_missing", F.round("coverage", 6).alias("coverage"))


@query("coverage_with_delisted", COVER + ", gone as (select s_suppkey, cast(date '1996-01-01' + cast(s_suppkey as integer) as date) exit_date from supplier) select date, n_expected + (select count(*) from gone where exit_date >= cover.date) n_expected, n_available from cover")
def coverage_with_delisted(spark, sf_dir):
    gone = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.expr("date_add(date'1996-01-01', cast(s_suppkey as int))").alias("exit_date"))
    return P.coverage_report(weekly_panel(spark, sf_dir), gone).select("date", "n_expected", "n_available")


@query("coverage_by_year", COVER + ", c as (select date, n_available / greatest(n_expected, 1) coverage from cover) select cast(year(date) as integer) as year, round(avg(coverage), 6) mean_coverage, round(min(coverage), 6) min_coverage, count(*) n_dates from c group by 1")
def coverage_by_year(spark, sf_dir):
    return P.coverage_by_year(P.coverage_report(weekly_panel(spark, sf_dir))).select("year", F.round("mean_coverage", 6).alias("mean_coverage"), F.round("min_coverage", 6).alias("min_coverage"), "n_dates")


@query("coverage_summary", COVER + ", c as (select date, n_available / greatest(n_expected, 1) coverage from cover), y as (select cast(year(date) as integer) y, avg(coverage) m from c group by 1) select round(avg(coverage), 6) mean_coverage, round(min(coverage), 6) min_coverage, (select y from y order by m, y limit 1) worst_year, avg(coverage) < 0.8 low_coverage from c")
def coverage_summary(spark, sf_dir):
    return P.coverage_summary(P.coverage_report(weekly_panel(spark, sf_dir))).select(F.round("mean_coverage", 6).alias("mean_coverage"), F.round("min_coverage", 6).alias("min_coverage"), "worst_year", "low_coverage")


@query("first_observation", GRID + " select ticker, min(date) first_date from panel where close is not null group by 1")
def first_observation(spark, sf_dir):
    return weekly_panel(spark, sf_dir).where("close is not null").groupBy("ticker").agg(F.min("date").alias("first_date"))


R20 = GRID + f", f as (select *, round({_chg(20)}, 9) r20 from panel)"


def _r20(spark, sf_dir):
    return weekly_panel(spark, sf_dir).withColumn("r20", F.round(P.change(20), 9))


RANK = "case when {c} is not null then (rank() over (partition by date, {c} is null order by {c}) + (count(*) over (partition by date, {c}) - 1) / 2) / count({c}) over (partition by date) end"


@query("xs_rank", R20 + f" select date, ticker, round({RANK.format(c='r20')}, 6) rank_pct from f")
def xs_rank(spark, sf_dir):
    return _r20(spark, sf_dir).select("date", "ticker", F.round(P.pct_rank("r20"), 6).alias("rank_pct"))


@query("xs_zscore", R20 + ", z as (select date, ticker, (r20 - avg(r20) over (partition by date)) / nullif(stddev_pop(r20) over (partition by date), 0) z from f) select date, ticker, round(case when z > 3 then 3.0 when z < -3 then -3.0 else z end, 6) z from z")
def xs_zscore(spark, sf_dir):
    return _r20(spark, sf_dir).select("date", "ticker", F.round(P.zscore("r20"), 6).alias("z"))


@query("group_demean", R20 + " select date, ticker, round(r20 - avg(r20) over (partition by date, segment), 6) demeaned from f")
def group_demean(spark, sf_dir):
    return P.with_group_size(_r20(spark, sf_dir)).select("date", "ticker", F.round(P.group_demean("r20"), 6).alias("demeaned"))


LABEL = f", fw as (select *, lead(close, 10) {W} / nullif(close, 0) - 1 fwd from panel), lab as (select *, (sum(fwd) over (partition by date) - fwd) / nullif(count(fwd) over (partition by date) - 1, 0) benchmark, count(fwd) over (partition by date) nf from fw), labelled as (select *, case when nf >= 10 then round(fwd - benchmark, 9) end y from lab)"


@query("fwd_return", GRID + f" select date, ticker, round(lead(close, 10) {W} / nullif(close, 0) - 1, 6) fwd from panel")
def fwd_return(spark, sf_dir):
    return weekly_panel(spark, sf_dir).select("date", "ticker", F.round(P.forward_return(10), 6).alias("fwd"))


@query("relative_label", GRID + LABEL + " select date, ticker, round(benchmark, 6) benchmark, round(y, 6) fwd_rel_return from labelled")
def relative_label(spark, sf_dir):
    return P.relative_labels(weekly_panel(spark, sf_dir)).select("date", "ticker", F.round("benchmark", 6).alias("benchmark"), F.round(F.round("fwd_rel_return", 9), 6).alias("fwd_rel_return"))


@query("rebalance_sampling", "select event_id, ts from events where dayofweek(ts) = 5")
def rebalance_sampling(spark, sf_dir):
    return P.rebalance_dates(table(spark, sf_dir, "events").withColumn("date", F.col("ts").cast("date"))).select("event_id", "ts")


# ---- validation over two features, a label and the week dates

MODEL = GRID + LABEL + f", feats as (select date, ticker, segment, y, round({_chg(20)}, 9) m20, round(-{_chg(5)}, 9) rev, round(lag(close, 21) {W} / nullif(lag(close, 252) {W}, 0) - 1, 9) m12, close from labelled), ranked as (select date, ticker, y, m20, m12, rev, {RANK.format(c='m20')} x1, {RANK.format(c='rev')} x2 from feats), model as (select date, ticker, y, coalesce(x1, 0.5) x1, coalesce(x2, 0.5) x2 from ranked where y is not null and coalesce(x1, x2) is not null)"


def _ranked(spark, sf_dir):
    p = P.relative_labels(weekly_panel(spark, sf_dir)).withColumn("y", F.round("fwd_rel_return", 9))
    p = P.compute(p, ("momentum_12_1", "momentum_20d", "reversal_5d")).withColumns({c: F.round(c, 9) for c in ("momentum_12_1", "momentum_20d", "reversal_5d")})
    return p.withColumns({"x1": P.pct_rank("momentum_20d"), "x2": P.pct_rank("reversal_5d")})


def _model(spark, sf_dir):
    return P.model_rows(_ranked(spark, sf_dir), ("x1", "x2"), "y").select("date", "ticker", "y", "x1", "x2")


@query("model_rows", MODEL + " select date, ticker, round(y, 6) y, round(x1, 6) x1, round(x2, 6) x2 from model")
def model_rows(spark, sf_dir):
    return _model(spark, sf_dir).select("date", "ticker", *(F.round(c, 6).alias(c) for c in ("y", "x1", "x2")))


FOLDS = """, days as (select date, row_number() over (order by date) - 1 i, count(*) over () n from (select distinct date from panel)),
    fold as (select fold_id, 150 + fold_id * ((n - 150) // 5) lo, case when fold_id = 4 then n else 150 + (fold_id + 1) * ((n - 150) // 5) end hi, date, i
             from days cross join (select unnest(range(5)) fold_id)),
    folds as (select cast(fold_id as integer) fold_id, date, i, lo, hi, case when i >= lo and i < hi then 'test' when i >= lo - 10 and i < lo then 'purged' when i >= hi and i < hi + 10 then 'embargoed' else 'train' end role from fold)"""


def _folds(spark, sf_dir):
    return V.walk_forward(weekly_panel(spark, sf_dir).select("date"), 5, 10, 10, 150)


@query("walk_forward_folds", GRID + FOLDS + " select fold_id, date, role from folds")
def walk_forward_folds(spark, sf_dir):
    return _folds(spark, sf_dir)


@query("leakage_check", GRID + FOLDS + " select count(*) n_leaks from folds where role = 'train' and i < hi and i + 10 >= lo")
def leakage_check(spark, sf_dir):
    return V.leaks(_folds(spark, sf_dir), 10).agg(F.count(F.lit(1)).alias("n_leaks"))


@query("fold_members", MODEL + FOLDS + " select fold_id, role, count(*) n_rows from model join folds using (date) group by 1, 2")
def fold_members(spark, sf_dir):
    return _model(spark, sf_dir).join(_folds(spark, sf_dir), "date").groupBy("fold_id", "role").agg(F.count(F.lit(1)).alias("n_rows"))


IC = MODEL + f", pr as (select date, {RANK.format(c='x1')} rs, {RANK.format(c='y')} rl from model), ics as (select date, corr(rs, rl) ic from pr group by date having count(*) >= 10 and count(distinct rs) >= 2 and count(distinct rl) >= 2)"


@query("rank_ic", IC + " select date, round(ic, 6) ic from ics")
def rank_ic(spark, sf_dir):
    return V.rank_ic(_model(spark, sf_dir), "x1", "y").select("date", F.round("ic", 6).alias("ic"))


SUMMARY = "count(ic) n_dates, round(avg(ic), 6) mean_ic, round(stddev_samp(ic), 6) sd_ic, round(avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0), 5) t_stat, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) ir, round(avg(cast(ic > 0 as integer)), 6) hit_rate"


def _summary(df, *keys):
    return V.ic_summary(df, *keys).select(*keys, "n_dates", *(F.round(c, 6).alias(c) for c in ("mean_ic", "sd_ic")), F.round("t_stat", 5).alias("t_stat"), *(F.round(c, 6).alias(c) for c in ("ir", "hit_rate")))


@query("ic_summary", IC + f" select {SUMMARY} from ics")
def ic_summary(spark, sf_dir):
    return _summary(V.rank_ic(_model(spark, sf_dir), "x1", "y"))


@query("ic_by_fold", IC + FOLDS + f" select fold_id, {SUMMARY} from ics join folds using (date) where role = 'test' group by 1")
def ic_by_fold(spark, sf_dir):
    test = _folds(spark, sf_dir).where("role = 'test'").select("fold_id", "date")
    return _summary(V.rank_ic(_model(spark, sf_dir), "x1", "y").join(test, "date"), "fold_id")


@query("quantile_spread", MODEL + ", q as (select *, count(*) over (partition by date) n, row_number() over (partition by date order by x1, ticker) r from model), b as (select *, greatest(ceil((r - 1) * 5 / (n - 1)), 1) - 1 b from q where n >= 10), d as (select date, avg(case when b = 4 then y end) - avg(case when b = 0 then y end) s from b group by 1) select count(s) n_dates, round(avg(s), 6) gross, round(avg(s) - 0.001, 6) net, round(avg(s) / nullif(stddev_samp(s) / sqrt(count(s)), 0), 5) t_stat from d")
def quantile_spread(spark, sf_dir):
    return V.quantile_spread(_model(spark, sf_dir), "x1", "y").select("n_dates", F.round("gross", 6).alias("gross"), F.round("net", 6).alias("net"), F.round("t_stat", 5).alias("t_stat"))


@query("shuffle_ic")
def shuffle_ic(spark, sf_dir):
    return V.shuffle_test(_model(spark, sf_dir), "x1", "y")


@query("baseline_compare", MODEL + ", base as (" + " union all ".join(f"select '{n}' baseline, date, {RANK.format(c=c)} rs, y from (select * from ranked where y is not null and {c} is not null)" for n, c in (("momentum", "m12"), ("reversal", "rev"), ("relative_strength", "m20"))) + f"), br as (select baseline, date, rs, {RANK.format(c='y').replace('partition by date', 'partition by baseline, date')} rl from base), bi as (select baseline, date, corr(rs, rl) ic from br group by 1, 2 having count(*) >= 10 and count(distinct rs) >= 2 and count(distinct rl) >= 2) select baseline, {SUMMARY} from bi group by 1")
def baseline_compare(spark, sf_dir):
    rows = _ranked(spark, sf_dir).where("y is not null")
    out = None
    for name, c in (("momentum", "momentum_12_1"), ("reversal", "reversal_5d"), ("relative_strength", "momentum_20d")):
        one = V.rank_ic(rows, c, "y").withColumn("baseline", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return _summary(out, "baseline")


RIDGE = MODEL + FOLDS + """, tr as (select fold_id, y, x1, x2 from model join folds using (date) where role = 'train'),
    m as (select fold_id, count(*)::double n, avg(x1) m1, avg(x2) m2, avg(y) my, sum(x1*x1) - count(*) * avg(x1) * avg(x1) + 10 a, sum(x2*x2) - count(*) * avg(x2) * avg(x2) + 10 b,
                 sum(x1*x2) - count(*) * avg(x1) * avg(x2) d, sum(x1*y) - count(*) * avg(x1) * avg(y) e, sum(x2*y) - count(*) * avg(x2) * avg(y) f from tr group by 1),
    co as (select fold_id, n, (b*e - d*f) / (a*b - d*d) b1, (a*f - d*e) / (a*b - d*d) b2, my, m1, m2 from m)"""


def _ridge(spark, sf_dir):
    train = _model(spark, sf_dir).join(_folds(spark, sf_dir).where("role = 'train'").select("fold_id", "date"), "date")
    return V.ridge_two(train, "x1", "x2", "y", 10.0, ("fold_id",))


@query("ridge_coefficients", RIDGE + " select fold_id, n, round(b1, 6) b1, round(b2, 6) b2, round(my - b1 * m1 - b2 * m2, 6) b0 from co")
def ridge_coefficients(spark, sf_dir):
    return _ridge(spark, sf_dir).select("fold_id", "n", *(F.round(c, 6).alias(c) for c in ("b0", "b1", "b2")))


@query("ridge_predictions", RIDGE + " select fold_id, date, ticker, round(my - b1 * m1 - b2 * m2 + b1 * x1 + b2 * x2, 6) score from model join folds using (date) join co using (fold_id) where role = 'test'")
def ridge_predictions(spark, sf_dir):
    test = _model(spark, sf_dir).join(_folds(spark, sf_dir).where("role = 'test'").select("fold_id", "date"), "date")
    return test.join(F.broadcast(_ridge(spark, sf_dir)), "fold_id").select("fold_id", "date", "ticker", F.round(F.expr("b0 + b1 * x1 + b2 * x2"), 6).alias("score"))


@query("feature_importance", RIDGE + " select feature, round(avg(abs(b)), 6) importance from (select 'x1' feature, b1 b from co union all select 'x2', b2 from co) group by 1")
def feature_importance(spark, sf_dir):
    co = _ridge(spark, sf_dir).select(F.expr("stack(2, 'x1', b1, 'x2', b2) as (feature, b)"))
    return co.groupBy("feature").agg(F.round(F.avg(F.abs("b")), 6).alias("importance"))


@query("ic_vs_coverage", COVER + ", c as (select date, n_available / greatest(n_expected, 1) coverage from cover)" + IC.replace(GRID, "") + FOLDS + ", pf as (select fold_id, avg(ic) ic, avg(coverage) coverage from folds join ics using (date) join c using (date) where role = 'test' group by 1) select count(*) n_folds, round(corr(ic, coverage), 5) corr_ic_coverage, round((select avg(ic) from (select ic from pf order by coverage, fold_id offset 1)), 6) ic_without_worst from pf")
def ic_vs_coverage(spark, sf_dir):
    cover = P.coverage_report(weekly_panel(spark, sf_dir)).select("date", "coverage")
    test = _folds(spark, sf_dir).where("role = 'test'").select("fold_id", "date")
    per = test.join(V.rank_ic(_model(spark, sf_dir), "x1", "y"), "date").join(cover, "date").groupBy("fold_id").agg(F.avg("ic").alias("ic"), F.avg("coverage").alias("coverage"))
    per = per.withColumn("k", F.row_number().over(Window.orderBy("coverage", "fold_id")))  # one row per fold
    return per.agg(F.count(F.lit(1)).alias("n_folds"), F.round(V.correlation("ic", "coverage"), 5).alias("corr_ic_coverage"), F.round(F.avg(F.when(F.col("k") > 1, F.col("ic"))), 6).alias("ic_without_worst"))


@query("gate_criteria", IC + FOLDS + ", f as (select fold_id, avg(ic) ic from ics join folds using (date) where role = 'test' group by 1), s as (select avg(ic) m, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) t from ics) select coalesce(m >= 0.03, false) ic_ok, coalesce(t >= 2, false) t_ok, (select count(*) from f where ic > 0) >= 4 folds_ok from s")
def gate_criteria(spark, sf_dir):
    ic = V.rank_ic(_model(spark, sf_dir), "x1", "y")
    test = _folds(spark, sf_dir).where("role = 'test'").select("fold_id", "date")
    folds = ic.join(test, "date").groupBy("fold_id").agg(F.avg("ic").alias("ic")).agg(F.count_if(F.col("ic") > 0).alias("positive_folds"))
    one = V.ic_summary(ic).crossJoin(folds).withColumns({"net": F.lit(0.0), "momentum_ic": F.lit(0.0), "random_ic": F.lit(0.0)})  # one row each
    return V.gate(one).select("ic_ok", "t_ok", "folds_ok")


@query("gbdt_predictions")
def gbdt_predictions(spark, sf_dir):
    """All registered features as ranks; the rows are written once, as every fold and tree reads them."""
    names = P.V1 + P.ORTHOGONAL
    p = P.compute(P.relative_labels(weekly_panel(spark, sf_dir)), names)
    rows = P.model_rows(P.normalise(p, names), names).select("date", "ticker", "fwd_rel_return", *names)
    return V.walk_forward_predict(saved(rows, "rows"), saved(_folds(spark, sf_dir), "folds"), list(names), "fwd_rel_return")

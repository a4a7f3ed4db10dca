"""Queries over quotes, claims, context, trades, gates and training-data preparation, with independent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking as C
from ..functions import text as T
from ..operators import evidence as E
from ..operators import outcomes as O
from ..operators import training as N
from ..sources.tables import table
from .catalog import query

# ---- quotes: benchmark passages located in documents

#: Claims by item: every fifth one re-spaced, every fifth one too short; an item is looked for in one language's documents.
QUOTES = "b as (select item_id, case when item_id % 5 = 1 then replace(text, ' ', '  ') when item_id % 5 = 2 then 'too short' else text end q, case when item_id % 2 = 0 then 'en' when item_id % 4 = 1 then 'fr' else 'de' end batch from benchmark), d as (select doc_id, lang batch, text from documents)"


def _quotes(spark, sf_dir):
    i = F.col("item_id")
    q = F.when(i % 5 == 1, F.regexp_replace("text", " ", "  ")).when(i % 5 == 2, "too short").otherwise(F.col("text"))
    batch = F.when(i % 2 == 0, "en").when(i % 4 == 1, "fr").otherwise("de")
    b = table(spark, sf_dir, "benchmark").select("item_id", q.alias("q"), batch.alias("batch"))
    return b, table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("batch"), "text")


def _located(b, d):
    return E.located(b.select(F.col("item_id").alias("claim_id"), "batch", F.col("q").alias("quote")), d.select("batch", F.col("doc_id").alias("source_id"), "text"))


SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query("quote_resolve", f"with {QUOTES} select item_id, doc_id, case when length(trim(q)) < 24 then 'too_short' when contains(text, trim(q)) then 'exact' when contains({SQUEEZE.format('text')}, {SQUEEZE.format('q')}) then 'whitespace' else 'fabricated' end status, case when length(trim(q)) >= 24 and contains(text, trim(q)) then cast(strpos(text, trim(q)) - 1 as integer) end exact_start from b join d using (batch)")
def quote_resolve(spark, sf_dir):
    """Every item beside every document of its language; texts are read for the ones that may hold the quote only."""
    b, d = _quotes(spark, sf_dir)
    found = _located(b, d).select(F.col("claim_id").alias("item_id"), F.col("source_id").alias("doc_id"), "r")
    r = b.select("item_id", "batch", E.too_short(F.col("q")).alias("short")).join(d.select("doc_id", "batch"), "batch").join(found, ["item_id", "doc_id"], "left")
    status = F.when(F.col("short"), F.lit(E.TOO_SHORT)).otherwise(F.coalesce("r.status", F.lit(E.FABRICATED)))
    return r.select("item_id", "doc_id", status.alias("status"), F.when(F.col("r.status") == "exact", F.col("r.start")).alias("exact_start"))


@query("quote_span_check", "select cast(0 as bigint) n_wrong")
def quote_span_check(spark, sf_dir):
    """Located spans read back from the document: none differs from the returned text."""
    b, d = _quotes(spark, sf_dir)
    r = _located(b, d).join(d.select(F.col("doc_id").alias("source_id"), "text"), "source_id")
    wrong = F.substring(F.col("text"), F.col("r.start") + 1, F.col("r.end") - F.col("r.start")) != F.col("r.text")
    return r.agg(F.count_if(wrong).alias("n_wrong"))


CLAIMS = f"{QUOTES}, src as (select batch, doc_id, text from d), cl as (select item_id, batch, q, (item_id * 7) % 200 pref from b), tr as (select cl.*, src.doc_id, case when length(trim(q)) < 24 then 'too_short' when contains(text, trim(q)) then 'exact' when contains({SQUEEZE.format('text')}, {SQUEEZE.format('q')}) then 'whitespace' else 'fabricated' end st, exists (select 1 from src s2 where s2.batch = cl.batch and s2.doc_id = cl.pref) known from cl left join src using (batch)), best as (select *, row_number() over (partition by item_id order by case when st in ('exact', 'whitespace') and doc_id = pref then 0 when st in ('exact', 'whitespace') then 1 else 2 end, doc_id) n from tr), res as (select item_id, case when st in ('exact', 'whitespace') then st when st = 'too_short' and known then 'too_short' else 'fabricated' end status, case when st in ('exact', 'whitespace') then doc_id end source_id, st in ('exact', 'whitespace') and known and doc_id <> pref recited from best where n = 1)"


def _resolved(spark, sf_dir):
    b, d = _quotes(spark, sf_dir)
    docs = d.select("batch", F.col("doc_id").alias("source_id"), "text")
    claims = b.select(F.col("item_id").alias("claim_id"), "batch", F.col("q").alias("quote"), ((F.col("item_id") * 7) % 200).alias("preferred"))
    return E.resolve_in_batch(claims, docs)


@query("resolve_in_any", f"with {CLAIMS} select item_id claim_id, status, source_id, recited from res")
def resolve_in_any(spark, sf_dir):
    return _resolved(spark, sf_dir).select("claim_id", "status", "source_id", "recited")


@query("claim_status_counts", f"with {CLAIMS} select count(*) lines_seen, count_if(status = 'exact') n_exact, count_if(status = 'whitespace') n_whitespace, count_if(status = 'fabricated') n_fabricated, count_if(status = 'too_short') n_too_short, count_if(recited) n_recited, round(count_if(status = 'exact') / nullif(count(*) + count_if(recited), 0), 6) exact_rate, round(count_if(status = 'fabricated') / nullif(count(*) + count_if(recited), 0), 6) fabrication_rate from res")
def claim_status_counts(spark, sf_dir):
    s = E.extraction_stats(_resolved(spark, sf_dir))
    return s.select("lines_seen", "n_exact", "n_whitespace", "n_fabricated", "n_too_short", "n_recited", F.round("exact_rate", 6).alias("exact_rate"), F.round("fabrication_rate", 6).alias("fabrication_rate"))


@query("quote_audit", f"with {CLAIMS}, c as (select r.item_id, r.source_id, case when r.item_id % 3 = 0 then 'no such quote' else trim(b.q) end q from res r join b using (item_id) where r.status = 'exact'), a as (select item_id, source_id % 3 briefing_id, not contains(text, q) bad from c join d on doc_id = source_id) select briefing_id, count(*) n_claims, count_if(bad) n_unverified, round(1 - count_if(bad) / count(*), 6) verification_rate, count_if(bad) = 0 passed from a group by 1")
def quote_audit(spark, sf_dir):
    b, d = _quotes(spark, sf_dir)
    c = _resolved(spark, sf_dir).where("status = 'exact'").withColumn("quote", F.when(F.col("claim_id") % 3 == 0, "no such quote").otherwise(F.col("quote")))
    c = c.withColumns({"briefing_id": F.col("source_id") % 3, "kind": F.lit("sourced")})
    return E.audit(c, d.select(F.col("doc_id").alias("source_id"), "text")).select("briefing_id", "n_claims", "n_unverified", F.round("verification_rate", 6).alias("verification_rate"), "passed")


@query("unknown_sources", f"with {CLAIMS} select item_id claim_id from res where source_id is not null and source_id not in (select doc_id from documents where doc_id % 2 = 0)")
def unknown_sources(spark, sf_dir):
    even = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("source_id"))
    return E.unknown_sources(_resolved(spark, sf_dir), even).select("claim_id")


# Model outputs made from events: a line is an object, a broken object, or prose.
OUTPUT = """o as (select event_id, event_type, case event_id % 6 when 0 then '{"kind": "inference", "text": "' || event_type || '"}' when 1 then '{"kind": "sourced", "text": "t", "source": "S1", "quote": "q"}' when 2 then '{"kind": "other", "text": "x"}' when 3 then '{broken}' when 4 then 'just prose' else '{"kind": "Inference", "text": "' || event_type || ' moves", "source": "S2"}' end line from events)"""


def _lines(spark, sf_dir):
    e, m = table(spark, sf_dir, "events"), F.col("event_id") % 6
    line = (
        F.when(m == 0, F.concat(F.lit('{"kind": "inference", "text": "'), "event_type", F.lit('"}')))
        .when(m == 1, F.lit('{"kind": "sourced", "text": "t", "source": "S1", "quote": "q"}')).when(m == 2, F.lit('{"kind": "other", "text": "x"}'))
        .when(m == 3, F.lit("{broken}")).when(m == 4, F.lit("just prose")).otherwise(F.concat(F.lit('{"kind": "Inference", "text": "'), "event_type", F.lit(' moves", "source": "S2"}')))
    )
    demos = spark.createDataFrame([("click",), ("view",)], "demo string")
    return E.claim_status(E.json_lines(e.select("event_id", line.alias("output")), "event_id"), demos)


@query("claim_parse", f"with {OUTPUT} select event_id, case event_id % 6 when 0 then case when event_type in ('click', 'view') then 'copied_demo' else 'inference' end when 1 then 'to_resolve' when 2 then 'missing_fields' when 3 then 'malformed_json' else 'inference' end status, event_id % 6 = 5 inference_with_citation from o where event_id % 6 <> 4")
def claim_parse(spark, sf_dir):
    return _lines(spark, sf_dir).select("event_id", "status", "inference_with_citation")


@query("jsonlines_parse", "select event_id, cast(json_extract(props, '$.k') as bigint) k from events")
def jsonlines_parse(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("extract_json_block", "select event_id, props as block from events")
def extract_json_block(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", C.json_block(F.concat(F.lit("Sure, here: "), F.col("props"), F.lit(' and more {"x": "}"}'))).alias("block"))


@query("content_addressed_put", "select substr(sha256(text), 1, 24) source_id, count(*) copies from documents group by 1")
def content_addressed_put(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = d.groupBy(F.substring(F.sha2("text", 256), 1, 24).alias("source_id")).agg(F.count(F.lit(1)).alias("copies"))
    return E.retained(d).select("source_id").join(n, "source_id")


@query("truncate_at_stop", "select doc_id, case when least(p1, p2) < 1000000000 then substr(text, 1, least(p1, p2) - 1) else text end t from (select doc_id, text, case when strpos(text, chr(10)) > 0 then strpos(text, chr(10)) else 1000000000 end p1, case when strpos(text, '. ') > 0 then strpos(text, '. ') else 1000000000 end p2 from documents)")
def truncate_at_stop(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_at(F.col("text"), ("\n", ". ")).alias("t"))


@query("strip_reasoning", "select item_id, trim(text) t from benchmark")
def strip_reasoning(spark, sf_dir):
    x = F.concat(F.lit("<think>why\nnot</think>"), F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", T.strip_reasoning(x).alias("t"))


# ---- context

@query("asof_latest_per_key", "select event_type, arg_max(value, ts) as value, max(ts) ts from events where ts <= timestamp '2024-01-15 12:00:00' and value is not null group by 1")
def asof_latest_per_key(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return E.latest_by_key(e, ["event_type"], "value", "ts", "2024-01-15 12:00:00").select("event_type", "value", "ts")


@query("asof_staleness", "select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) n from events where ts < timestamp '2024-01-21' and ts >= timestamp '2024-01-21' - interval 5 day) where n = 1")
def asof_staleness(spark, sf_dir):
    return E.latest_row_within(table(spark, sf_dir, "events"), ["user_id"], "ts", "2024-01-20", 5, "event_id").select("user_id", "event_id", "ts")


@query("conditional_counts", "select user_id, count_if(event_type = 'purchase') buys, count_if(event_type = 'error') sells, count(*) n from events group by 1")
def conditional_counts(spark, sf_dir):
    code = F.when(F.col("event_type") == "purchase", "P").when(F.col("event_type") == "error", "S").otherwise("A")
    return E.insider_tallies(table(spark, sf_dir, "events").select("user_id", code.alias("code")), "user_id")


@query("trailing_snapshot", """with b as (select o_custkey ticker, o_totalprice as close, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) n from orders where o_orderdate <= timestamp '2000-06-30')
    select ticker, max(case when n = 1 then close end) as close, round(max(case when n = 1 then close end) / nullif(max(case when n = 3 then close end), 0) - 1, 6) return_2, round(max(case when n = 1 then close end) / nullif(max(case when n = 6 then close end), 0) - 1, 6) return_5, count(*) bars from b where n <= 6 group by 1""")
def trailing_snapshot(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    bars = o.select(F.col("o_custkey").alias("ticker"), F.struct(F.col("o_orderdate"), F.col("o_orderkey")).alias("at"), F.col("o_orderdate").alias("d"), F.col("o_totalprice").alias("close"), F.lit(1.0).alias("volume"))
    # Several orders may fall on one day, so the order key breaks the tie within the date column.
    bars = bars.where("d <= timestamp_ntz'2000-06-30 00:00:00'").select("ticker", F.col("at").alias("date"), "close", "volume")
    far = F.struct(F.lit("2100-01-01").cast("timestamp_ntz").alias("o_orderdate"), F.lit(0).cast("bigint").alias("o_orderkey"))
    s = E.trailing_snapshot(bars.withColumn("date", F.col("date")).where(F.col("date") <= far), far, horizons=(2, 5))
    return s.select("ticker", "close", F.round("return_2", 6).alias("return_2"), F.round("return_5", 6).alias("return_5"), "bars")


@query("analyst_consensus", "with g as (select user_id, event_type, count(*) n from events group by 1, 2), t as (select user_id, string_agg(event_type || ':' || n, ',' order by n desc, event_type) grades from g group by 1) select e.user_id, round(avg(case when value > 50 then value end), 4) mean_target, max(case when value > 50 then value end) high_target, min(case when value > 50 then value end) low_target, count(*) n_firms, grades from events e join t on t.user_id = e.user_id group by 1, 6")
def analyst_consensus(spark, sf_dir):
    a = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("grade"), F.when(F.col("value") > 50, F.col("value")).alias("target"))
    c = E.consensus(a, "user_id")
    return c.select("user_id", F.round("mean_target", 4).alias("mean_target"), "high_target", "low_target", "n_firms", "grades")


# ---- outcomes

TR = "tr as (select o_orderkey trade_id, case o_orderstatus when 'O' then 'a' when 'F' then 'b' else 'c' end arm, case when o_orderkey % 4 = 0 then 'short' else 'long' end direction, o_totalprice entry_price, o_totalprice * (1 + (o_custkey % 21 - 10) / 100.0::double) exit_price, case when o_orderkey % 7 = 0 then null else (o_custkey % 5 - 2) / 100.0::double end bench, o_orderkey % 9 = 0 still_open from orders)"


def _trades(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    t = o.select(
        F.col("o_orderkey").alias("trade_id"), F.when(F.col("o_orderstatus") == "O", "a").when(F.col("o_orderstatus") == "F", "b").otherwise("c").alias("arm"),
        F.when(F.col("o_orderkey") % 4 == 0, "short").otherwise("long").alias("direction"), F.col("o_totalprice").alias("entry_price"), F.col("o_orderdate").alias("entry_date"),
    )
    x = o.where("o_orderkey % 9 <> 0").select(
        F.col("o_orderkey").alias("trade_id"), (F.col("o_totalprice") * (1 + (F.col("o_custkey") % 21 - 10) / 100)).alias("exit_price"),
        F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_custkey") % 5 - 2) / 100).alias("benchmark_return"), F.col("o_orderdate").alias("exit_date"),
    )
    return O.closed(t, x)


REL = f"with {TR}, cl as (select trade_id, arm, case when direction = 'short' then 0 - (exit_price / entry_price - 1) else exit_price / entry_price - 1 end raw, bench, still_open from tr)"


@query("close_trades", REL + " select trade_id, case when still_open then null else round(raw, 6) + 0.0::double end raw_return, case when still_open then null else round(raw - bench, 6) + 0.0::double end relative_return from cl")
def close_trades(spark, sf_dir):
    t = _trades(spark, sf_dir)
    return t.select("trade_id", (F.round("raw_return", 6) + F.lit(0.0)).alias("raw_return"), (F.round("relative_return", 6) + F.lit(0.0)).alias("relative_return"))  # no negative zero


@query("open_trades", REL + " select trade_id, arm from cl where still_open and arm = 'a'")
def open_trades(spark, sf_dir):
    return O.open_trades(_trades(spark, sf_dir), "a").select("trade_id", "arm")


@query("closed_trades", REL + " select trade_id, arm from cl where not still_open and arm = 'b'")
def closed_trades(spark, sf_dir):
    return O.closed_trades(_trades(spark, sf_dir), "b").select("trade_id", "arm")


@query("trade_performance_by_arm", REL + ", r as (select arm, round(raw - bench, 9) x from cl where not still_open and bench is not null) select arm, count(*) n, round(avg(x), 6) mean, round(avg(cast(x > 0 as integer)), 6) hit_rate, round(coalesce(stddev_samp(x), 0), 6) sd, round(avg(x) / nullif(stddev_samp(x) / sqrt(count(*)), 0), 4) t_stat from r group by 1")
def trade_performance_by_arm(spark, sf_dir):
    p = O.performance_by_arm(_trades(spark, sf_dir).withColumn("relative_return", F.round("relative_return", 9)))
    return p.select("arm", "n", *(F.round(c, 6).alias(c) for c in ("mean", "hit_rate", "sd")), F.round("t_stat", 4).alias("t_stat"))


LAB = "l as (select source, quality, toxic, doc_id from labels join documents using (doc_id))"


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")


@query("wilson_by_group", f"with {LAB}, s as (select source, sum(quality) k, count(*)::double n from l group by 1), p as (select *, k / n p from s) select source, round(greatest((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 0), 6) low, round(least((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 1), 6) high from p")
def wilson_by_group(spark, sf_dir):
    s = _labelled(spark, sf_dir).groupBy("source").agg(F.sum("quality").alias("k"), F.count(F.lit(1)).alias("n"))
    w = s.select("source", O.wilson(F.col("k"), F.col("n")).alias("w"))
    return w.select("source", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


@query("ece_bins", "with c as (select least(n_chars / 4000.0::double, 1.0) conf, quality from labels join documents using (doc_id)), b as (select least(floor(conf * 5), 4) bin, count(*) n, avg(conf) cf, avg(quality) ac from c group by 1) select cast(bin as bigint) bin, n, round(cf, 6) confidence, round(ac, 6) accuracy from b")
def ece_bins(spark, sf_dir):
    c = _labelled(spark, sf_dir).withColumn("conf", F.least(F.col("n_chars") / 4000, F.lit(1.0)))
    return O.calibration_bins(c, "conf", "quality").select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


@query("calibration_error", "with c as (select least(n_chars / 4000.0::double, 1.0) conf, quality from labels join documents using (doc_id)), b as (select least(floor(conf * 5), 4) bin, count(*) n, avg(conf) cf, avg(quality) ac from c group by 1) select round(sum(n * abs(cf - ac)) / sum(n), 6) ece from b")
def calibration_error(spark, sf_dir):
    c = _labelled(spark, sf_dir).withColumn("conf", F.least(F.col("n_chars") / 4000, F.lit(1.0)))
    return O.calibration_error(c, "conf", "quality").select(F.round("ece", 6).alias("ece"))


LAPS = "cs as (select event_id, user_id, value > 100 up, case event_id % 4 when 0 then 'I say UP' when 1 then 'down, surely' when 2 then 'Up' else 'no idea' end r from events), an as (select *, nullif(upper(regexp_extract(r, '(?i)\\b(UP|DOWN)\\b', 1)), '') a from cs)"


def _cases(spark, sf_dir):
    m = F.col("event_id") % 4
    r = F.when(m == 0, "I say UP").when(m == 1, "down, surely").when(m == 2, "Up").otherwise("no idea")
    return table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") > 100).alias("realized_up"), r.alias("response"))


@query("lap_score", f"with {LAPS} select count(*) n, count(a) n_parsed, round(avg(case when a is not null then cast((a = 'UP') = up as integer) end), 6) accuracy, round(avg(case when a is not null then cast((a = 'UP') = up as integer) end) - 0.5, 6) excess from an")
def lap_score(spark, sf_dir):
    return O.lap_score(_cases(spark, sf_dir)).select("n", "n_parsed", F.round("accuracy", 6).alias("accuracy"), F.round("excess", 6).alias("excess"))


@query("lap_split", f"with {LAPS}, bad as (select distinct event_id from an where a is not null and (a = 'UP') = up) select case when event_id in (select event_id from bad) then 'contaminated' else 'clean' end part, count(*) n from cs group by 1")
def lap_split(spark, sf_dir):
    c = _cases(spark, sf_dir)
    clean, bad = O.split_by(c, O.contaminated(c, "event_id"), ["event_id"])
    return clean.withColumn("part", F.lit("clean")).unionByName(bad.withColumn("part", F.lit("contaminated"))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("arm_gate", REL + ", r as (select arm, cast(raw > 0 as integer) win from cl where not still_open), s as (select arm, avg(win) acc, count(*) n from r group by 1) select arm, acc >= 0.55 accurate, n >= 150 enough, abs(acc - 0.5) > 0.02 informative, acc >= 0.55 and n >= 150 and abs(acc - 0.5) > 0.02 and acc - 0.45 >= 0.03 passed from s")
def arm_gate(spark, sf_dir):
    t = O.closed_trades(_trades(spark, sf_dir)).groupBy("arm").agg(F.avg((F.col("raw_return") > 0).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    arms = t.withColumns({"ci_low": F.lit(0.51), "ece": F.lit(0.1), "format_rate": F.lit(1.0), "baseline": F.lit(0.45), "lap_excess": F.lit(0.0)})
    return O.arm_gate(arms).select("arm", "accurate", "enough", "informative", "passed")


@query("reward_risk", "select l_orderkey, l_linenumber, case when l_discount = l_tax then null else round(abs(l_quantity - l_discount) / abs(l_discount - l_tax), 4) end rr from lineitem")
def reward_risk(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    rr = O.reward_risk(F.col("l_discount"), F.col("l_quantity"), F.col("l_tax"))
    return l.select("l_orderkey", "l_linenumber", F.when(rr != float("inf"), F.round(rr, 4)).alias("rr"))


# ---- training data

N_TOK = r"cast(len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) as bigint)"


@query("pack_offsets", f"with t as (select doc_id, source, {N_TOK} n_tokens from documents) select doc_id, n_tokens, cast(coalesce(sum(n_tokens) over (order by source, doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) token_offset, cast(floor(coalesce(sum(n_tokens) over (order by source, doc_id rows between unbounded preceding and 1 preceding), 0) / 19968) as bigint) shard_id from t")
def pack_offsets(spark, sf_dir):
    d = N.token_lengths(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_tokens")
    o = N.running_offset(d, ["source", "doc_id"])
    return o.select("doc_id", "n_tokens", "token_offset", N.shard_of(F.col("token_offset"), 20_000, 512).alias("shard_id"))


@query("shard_totals", f"with t as (select sum({N_TOK}) n from documents) select cast(floor(n / 512) * 512 as bigint) tokens, cast(floor(n / 512) as bigint) sequences, cast(ceil(floor(n / 512) / 39) as bigint) shards, cast(floor(floor(n / 512) / 8) as bigint) steps_per_epoch from t")
def shard_totals(spark, sf_dir):
    return N.shard_totals(N.token_lengths(table(spark, sf_dir, "documents")), 512, 20_000, 8)


@query("token_chunks")
def token_chunks(spark, sf_dir):
    """Windows over paragraphs; a token is its word's length, standing in for an injected tokenizer's id."""
    paragraphs = F.transform(F.filter(F.split("text", "\n"), lambda p: F.trim(p) != ""), lambda p: F.transform(F.split(F.trim(p), r"\s+"), lambda w: F.char_length(w)))
    t = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.packed_chunks(paragraphs, 256, 16, 32)).alias("chunk", "tokens"))
    return t.select("doc_id", "chunk", F.size("tokens").alias("n_tokens"))


SFT = f"c as (select conv_id, sum(case when role <> 'assistant' then {N_TOK} else 0 end) p, sum(case when role = 'assistant' then {N_TOK} else 0 end) k from conversations group by 1)"


def _sft_examples(spark, sf_dir):
    t = N.token_lengths(table(spark, sf_dir, "conversations"))
    own = F.col("role") == "assistant"
    return t.groupBy("conv_id").agg(F.coalesce(F.sum(F.when(~own, F.col("n_tokens"))), F.lit(0)).alias("n_prompt"), F.coalesce(F.sum(F.when(own, F.col("n_tokens"))), F.lit(0)).alias("n_completion"))


def _mask_sums(lengths):
    m = lengths.withColumn("mask", N.mask_array(F.col("kept_prompt"), F.col("kept_completion")))
    return m.select("conv_id", F.size("mask").alias("n_ids"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n_trained"))


@query("sft_mask_lengths", f"with {SFT}, m as (select conv_id, least(p, 4096) kp, least(k, 4096 - least(p, 4096)) kc from c) select conv_id, cast(kp as bigint) kept_prompt, cast(kc as bigint) kept_completion from m where kc > 0")
def sft_mask_lengths(spark, sf_dir):
    return N.masks(_sft_examples(spark, sf_dir)).select("conv_id", "kept_prompt", "kept_completion")


@query("sft_mask_sums", f"with {SFT}, m as (select conv_id, least(p, 4096) kp, least(k, 4096 - least(p, 4096)) kc from c) select conv_id, cast(kp + kc as integer) n_ids, cast(kc as integer) n_trained from m where kc > 0")
def sft_mask_sums(spark, sf_dir):
    return _mask_sums(sft_mask_lengths(spark, sf_dir))


@query("interleave_schedule", "select event_id batch_no, case when (event_id + 1) % 4 = 0 then ((event_id + 1) // 4 - 1) % 7 end sft_example from events")
def interleave_schedule(spark, sf_dir):
    return N.interleave(table(spark, sf_dir, "events").select(F.col("event_id").alias("batch_no")), 7, 0.25)


@query("replay_mix_counts", "select 'domain' origin, count(*) n from documents where lang <> 'en' union all select 'replay', cast(floor(count(*) * 0.25 / 0.75) as bigint) from documents where lang <> 'en'")
def replay_mix_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return N.replay_mix(d.where("lang <> 'en'"), d.where("lang = 'en'"), "doc_id", 0.25).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("validation_split")
def validation_split(spark, sf_dir):
    return N.validation_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("shard_cursor", "select event_id // 100 shard_id, event_id % 100 seq_no from events where event_id // 100 > 3 or (event_id // 100 = 3 and event_id % 100 > 50)")
def shard_cursor(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).alias("shard_id"), (F.col("event_id") % 100).alias("seq_no"))
    return N.after_cursor(s, 3, 50)


@query("cosine_rate", "select event_id step, round(case when event_id < 100 then 0.001 * (event_id + 1) / 100 else 0.5 * 0.001 * (1 + cos(pi() * least(1.0, (event_id - 100) / 900.0))) end, 9) rate from events")
def cosine_rate(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.round(N.cosine_rate(F.col("event_id"), 0.001, 100, 1000), 9).alias("rate"))


@query("tumbling_activity", "select time_bucket(interval 1 day, ts) as day, event_type, count(*) n, round(sum(value), 2) total from events group by 1, 2")
def tumbling_activity(spark, sf_dir):
    """The batch twin of ``streaming.windows.tumbling``."""
    from ..streaming.windows import tumbling

    t = tumbling(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day", "event_type")
    return t.select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


# ---- briefing


@query("segment_queries", "select segment, cast(len(metrics) + len(watch) + 3 as bigint) n_queries from (values " + ", ".join(f"('{s}', {m!r}, {w!r})" for s, _, m, w in __import__("tessera.operators.briefing", fromlist=["PROFILES"]).PROFILES) + ") v(segment, metrics, watch)")
def segment_queries(spark, sf_dir):
    from ..operators import briefing as B

    return B.segment_queries(B.profiles(spark)).groupBy("segment").agg(F.count(F.lit(1)).alias("n_queries"))


@query("first_wins_union", "select doc_id, min(q) query_no from (select doc_id, 0 q from documents where contains(text, 'license') union all select doc_id, 1 from documents where contains(text, 'token') union all select doc_id, 2 from documents where lang = 'fr') group by 1")
def first_wins_union(spark, sf_dir):
    from ..operators import briefing as B

    d, out = table(spark, sf_dir, "documents"), None
    for i, cond in enumerate((F.contains("text", F.lit("license")), F.contains("text", F.lit("token")), F.col("lang") == "fr")):
        one = d.where(cond).select("doc_id", F.lit(i).alias("query_no"))
        out = one if out is None else out.unionByName(one)
    return B.first_wins(out, ["doc_id"], "query_no")


@query("segment_lookup", "select c_custkey, case c_mktsegment when 'BUILDING' then 'memory' when 'MACHINERY' then 'foundry' else 'default' end segment from customer")
def segment_lookup(spark, sf_dir):
    from ..operators import briefing as B

    dim = spark.createDataFrame([("BUILDING", "memory"), ("MACHINERY", "foundry")], "ticker string, segment string")
    return B.with_segment(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("ticker")), dim).select("c_custkey", "segment")


@query("sft_example_status", """select event_id, case event_id % 4 when 0 then 'no_evidence' when 1 then 'accepted' when 2 then 'ticker_drift' else 'invalid' end status from events""")
def sft_example_status(spark, sf_dir):
    from ..operators import briefing as B

    m = F.col("event_id") % 4
    t = F.when(m == 2, "other").otherwise(F.col("event_type"))
    good = F.concat(F.lit('{"ticker": "'), t, F.lit('", "direction": "long", "conviction": 0.4}'))
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("ticker"), F.when(m == 0, " ").otherwise("said so").alias("evidence"), F.when(m == 3, '{"direction": "up"}').otherwise(good).alias("completion"))
    return e.select("event_id", B.sft_status(e).alias("status"))


@query("render_sources")
def render_sources(spark, sf_dir):
    from ..operators import briefing as B

    c = table(spark, sf_dir, "conversations")
    p = c.select(F.col("conv_id").alias("case_id"), F.lit("2024-01-01").cast("date").alias("doc_date"), F.col("turn").alias("ordinal"), F.col("turn").alias("chunk_id"), "text")
    return B.render_sources(p)


@query("briefing_passages")
def briefing_passages(spark, sf_dir):
    """Cases are sources; chunks are their documents, all dated alike."""
    from ..operators import briefing as B

    d = table(spark, sf_dir, "documents")
    chunks = d.select(F.col("source").alias("ticker"), F.col("doc_id").alias("chunk_id"), F.col("lang").alias("section"), F.lit("2024-01-01").cast("date").alias("doc_date"), F.col("doc_id").alias("ordinal"), "text")
    cases = d.select(F.col("source").alias("case_id"), F.col("source").alias("ticker"), F.lit("2024-06-01").cast("date").alias("as_of")).distinct()
    dim = spark.createDataFrame([("src1", "memory"), ("src2", "payments")], "ticker string, segment string")
    return B.CorpusRetriever(chunks, dim).fetch(cases).select("case_id", "chunk_id", "section")


@query("provenance_key", "select r_regionkey, substr(sha256('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}'), 1, 16) k from region")
def provenance_key(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", O.provenance_key("r_regionkey", "r_name").alias("k"))


@query("shard_order")
def shard_order(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).alias("shard_id"), (F.col("event_id") % 100).alias("seq_no"))
    return N.shuffled_order(s, 42)

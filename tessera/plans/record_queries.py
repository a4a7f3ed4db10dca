"""Queries over the readers of records, the index tables and training figures; records are made from the given tables."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index as X
from ..operators import panel as P
from ..operators import retrieval as R
from ..operators import training as N
from ..operators import validation as V
from ..sources import records as S
from ..sources import sinks
from ..sources.tables import shared_folder, table
from . import corpus_queries as C
from . import panel_queries as Q
from .catalog import query


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


FILINGS = "filings as (select o_custkey cik, cast(o_orderkey as varchar) accession, o_orderpriority form, cast(o_orderdate as date) doc_date, case when o_orderkey % 7 = 0 then '' else 'd' || o_orderkey || '.htm' end primary_doc from orders)"


def _submissions(spark, sf_dir):
    """Orders as issuers' filing lists: recent ones for even customers, an older page for odd ones."""
    o = table(spark, sf_dir, "orders")
    doc = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.concat(F.lit("d"), F.col("o_orderkey").cast("string"), F.lit(".htm")))
    f = F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("a"), F.col("o_orderpriority").alias("f"), F.col("o_orderdate").cast("date").cast("string").alias("d"), doc.alias("p")))
    lists = o.groupBy(F.col("o_custkey").alias("cik")).agg(f.alias("x"))
    page = F.struct(F.col("x.a").alias("accessionNumber"), F.col("x.f").alias("form"), F.col("x.d").alias("filingDate"), F.col("x.p").alias("primaryDocument"))
    recent = F.to_json(F.struct(F.struct(page.alias("recent")).alias("filings")))
    return S.submissions(lists.select("cik", F.when(F.col("cik") % 2 == 0, recent).otherwise(F.to_json(page)).alias("body")))


@query("submissions_scan", f"with {FILINGS} select * from filings")
def submissions_scan(spark, sf_dir):
    return _submissions(spark, sf_dir)


@query("recent_filings", f"with {FILINGS} select cik, accession from (select *, row_number() over (partition by cik order by doc_date desc, accession) n from filings where form in ('1-URGENT', '2-HIGH') and doc_date <= date '1999-06-30' and primary_doc <> '') where n <= 3")
def recent_filings(spark, sf_dir):
    return S.recent_filings(_submissions(spark, sf_dir), ["1-URGENT", "2-HIGH"], datetime.date(1999, 6, 30), 3).select("cik", "accession")


@query("filing_index_scan", "select l_orderkey accession, 'l' || l_linenumber || '.htm' name from lineitem")
def filing_index_scan(spark, sf_dir):
    name = F.concat(F.lit("l"), F.col("l_linenumber").cast("string"), F.lit(".htm"))
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("accession")).agg(F.collect_list(F.struct(name.alias("name"))).alias("item"))
    return S.filing_index(items.select("accession", F.to_json(F.struct(F.struct("item").alias("directory"))).alias("body")))


@query("resolve_issuers", "select lower(c_name) ticker, case when c_custkey % 3 <> 0 then c_custkey end cik from customer")
def resolve_issuers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return S.resolve_issuers(c.select(F.lower("c_name").alias("ticker")), c.where("c_custkey % 3 <> 0").select(F.col("c_name").alias("ticker"), F.col("c_custkey").alias("cik")))


@query("fetch_pending", "select doc_id, case when doc_id % 5 = 0 or doc_id % 3 = 0 then 'dropped' else 'fetched' end status, case when doc_id % 5 = 0 then 'fetch_failed:missing' when doc_id % 3 = 0 then 'fetch_failed:timeout' end drop_reason, case when doc_id % 5 <> 0 and doc_id % 3 <> 0 then length(text) end n from documents where text is not null")
def fetch_pending(spark, sf_dir):
    """A client's answers: every third a timeout, every fifth none."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    pending = d.select("doc_id", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("drop_reason"))
    answers = d.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("text"), F.when(F.col("doc_id") % 3 == 0, "timeout").alias("error"))
    return S.fetch_status(pending, answers).select("doc_id", "status", "drop_reason", F.char_length("text").cast("bigint").alias("n"))


def _ownership(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = lambda c: F.col(c).cast("string")
    tx = F.concat(
        F.lit("<nonDerivativeTransaction><securityTitle><value>Common</value></securityTitle><transactionDate><value>"), F.col("o_orderdate").cast("date").cast("string"),
        F.lit("</value></transactionDate><transactionCoding><transactionCode>"), F.substring("o_orderstatus", 1, 1), F.lit("</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>"),
        F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(s("o_orderkey")), F.lit("</value></transactionShares><transactionPricePerShare><value>1.5</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction>"),
    )
    each = o.groupBy("o_custkey").agg(F.concat_ws("", F.collect_list(tx)).alias("t"))
    head = F.concat(F.lit("<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>Owner "), s("o_custkey"), F.lit("</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>"), (F.col("o_custkey") % 2).cast("string"), F.lit("</isDirector><isOfficer>true</isOfficer></reportingOwnerRelationship></reportingOwner><nonDerivativeTable>"))
    return S.ownership(each.select(F.col("o_custkey").alias("ticker"), F.concat(head, F.col("t"), F.lit("</nonDerivativeTable></ownershipDocument>")).alias("xml")))


OWN = "tx as (select o_custkey ticker, 'Owner ' || o_custkey as owner, o_custkey % 2 = 1 director, true officer, cast(o_orderdate as date) tx_date, o_orderstatus code, cast(o_orderkey as double) shares, 1.5::double price from orders where o_orderkey % 9 <> 0)"


@query("ownership_scan", f"with {OWN} select * from tx")
def ownership_scan(spark, sf_dir):
    return _ownership(spark, sf_dir)


@query("ownership_window", f"with {OWN} select ticker, tx_date, shares from (select *, row_number() over (partition by ticker order by tx_date desc, owner, shares) n from tx where tx_date between date '1997-12-31' - 180 and date '1997-12-31') where n <= 20")
def ownership_window(spark, sf_dir):
    return S.ownership_window(_ownership(spark, sf_dir), datetime.date(1997, 12, 31)).select("ticker", "tx_date", "shares")


@query("macro_scan", "select 'ORDERS' series_id, cast(o_orderdate as date) value_date, cast(count(*) as double) as \"value\" from orders group by 2 having count(*) % 4 <> 0")
def macro_scan(spark, sf_dir):
    """Orders a day as a two-column file; every count divisible by four is missing."""
    path = _folder(spark, "macro")
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").cast("string").alias("DATE")).agg(F.count(F.lit(1)).alias("n"))
    days.select("DATE", F.when(F.col("n") % 4 == 0, ".").otherwise(F.col("n").cast("string")).alias("ORDERS")).write.csv(path, header=True)
    return S.macro_series(spark, path, "ORDERS")


@query("json_examples", "select conv_id, turn from conversations where turn % 3 <> 2")
def json_examples(spark, sf_dir):
    """Lines whose completion is an object, with a direction that isn't known in every third turn."""
    c, path = table(spark, sf_dir, "conversations"), _folder(spark, "examples")
    done = F.to_json(F.struct(F.get(F.array(F.lit("long"), F.lit("flat"), F.lit("up")), (F.col("turn") % 3).cast("int")).alias("direction"), F.lit(0.5).alias("conviction")))
    c.select(F.concat_ws("/", "conv_id", "turn").alias("prompt"), done.alias("completion")).write.json(path)
    place = F.split("prompt", "/")
    return S.examples(spark, path)[0].select(place[0].cast("bigint").alias("conv_id"), place[1].cast("bigint").alias("turn"))


@query("best_section", "select doc_id, min(case name when 'src1' then '0src1' when 'src0' then '1src0' else '2' || name end)[2:] as section from (select doc_id // 4 doc_id, source as name from documents where source is not null) group by 1")
def best_section(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source is not null").select(F.floor(F.col("doc_id") / 4).alias("doc_id"), F.col("source").alias("section"))
    return S.best_section(d.distinct(), ["src1", "src0"])


@query("percent_render", "select l_orderkey, l_linenumber, case when l_linenumber = 3 then 'n/a' else printf('%.1f%%', l_discount * 100) end p from lineitem")
def percent_render(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.percent(F.when(F.col("l_linenumber") != 3, F.col("l_discount"))).alias("p"))


@query("normalise_dispatch", Q.R20 + ", z as (select date, ticker, (r20 - avg(r20) over (partition by date)) / nullif(stddev_pop(r20) over (partition by date), 0) z from f) select date, ticker, round(case when z > 3 then 3.0 when z < -3 then -3.0 else z end, 6) r20 from z")
def normalise_dispatch(spark, sf_dir):
    return P.normalise(Q._r20(spark, sf_dir), ("r20",), "zscore").select("date", "ticker", F.round("r20", 6).alias("r20"))


@query("panel_written", Q.R20 + " select date, ticker, round(r20, 6) r20, case when r20 > 0 then r20 end is not null has_label from f")
def panel_written(spark, sf_dir):
    """Features and labels, joined and written by year, read again."""
    folder, f = _folder(spark, "panel"), Q._r20(spark, sf_dir)
    sinks.write_panel(f.select("date", "ticker", "close", "r20"), f.where("r20 > 0").select("date", "ticker", F.col("r20").alias("y")), f.groupBy("date").count(), folder)
    return spark.read.parquet(f"{folder}/features").select("date", "ticker", F.round("r20", 6).alias("r20"), F.col("y").isNotNull().alias("has_label"))


_SEARCH = f"with {C._bm25_sql()} select query_id, doc_id, round(score, 6) score, cast(rank as integer) rank from ({C._top_sql('(select query_id, doc_id, round(score, 9) score from bm)', 12)})"


@query("indexed_bm25_topk", _SEARCH)
def indexed_bm25_topk(spark, sf_dir):
    """The index is built of one language's documents, then grown by all it doesn't have, twice."""
    docs = table(spark, sf_dir, "documents")
    index = X.LexicalIndex(spark, _folder(spark, "lexical"))
    for some in (docs.where("lang = 'en'"), docs, docs):
        index.grow(some)
    s = index.search(C._queries(spark)).withColumn("score", F.round("score", 9))
    return R.top(s, 12).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("vector_store", "select label, count(*) n, round(sum(embedding[1]::double), 4) s from embeddings group by 1")
def vector_store(spark, sf_dir):
    v, folder = table(spark, sf_dir, "embeddings"), _folder(spark, "vectors")
    X.grow_vectors(v.where("vec_id % 2 = 0"), folder)
    X.grow_vectors(v, folder)
    assert X.grow_vectors(v, folder) == 0
    return spark.read.parquet(folder).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("embedding")[0].cast("double")), 4).alias("s"))


@query("bits_per_character", "select lang, cast(sum(n_chars) as bigint) n_chars, round(sum(n_chars * 0.25 + doc_id % 7) / ln(2) / nullif(sum(n_chars), 0), 6) bits_per_char from documents group by 1")
def bits_per_character(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "n_chars", (F.col("n_chars") * 0.25 + F.col("doc_id") % 7).alias("loss_nats"))
    return N.bits_per_character(d, "lang").withColumn("bits_per_char", F.round("bits_per_char", 6))


@query("throughput_summary", "select o_orderstatus, count(*) n_steps, cast(sum(o_custkey) as bigint) tokens, round(sum(o_custkey) / sum(o_totalprice), 8) tokens_per_second, round(median(o_totalprice), 4) median_seconds from orders where o_orderkey >= 10 group by 1")
def throughput_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_orderkey").alias("step"), F.col("o_custkey").alias("tokens"), F.col("o_totalprice").cast("double").alias("seconds"))
    t = N.throughput(o, "o_orderstatus", 10)
    return t.withColumns({"tokens_per_second": F.round("tokens_per_second", 8), "median_seconds": F.round("median_seconds", 4)})


@query("ridge_many_normal_equations", Q.RIDGE + " select fold_id, f feature, 0.0 as slope from (select distinct fold_id from co) cross join (select unnest(['x1', 'x2', 'x3', 'x4']) f)")
def ridge_many_normal_equations(spark, sf_dir):
    """Ridge over four features: what the normal equations leave, the slope of the penalised squares, is nothing."""
    names = ["x1", "x2", "x3", "x4"]
    train = Q._model(spark, sf_dir).join(Q._folds(spark, sf_dir).where("role = 'train'").select("fold_id", "date"), "date")
    train = train.withColumns({"x3": F.col("x1") * F.col("x2"), "x4": F.col("x1") * F.col("x1")})
    beta = V.ridge(train, names, "y")
    left = V.ridge_scores(train, beta, names).withColumn("e", F.col("y") - F.col("score"))
    sums = left.groupBy("fold_id").agg(*(F.sum(F.col(c) * F.col("e")).alias(c) for c in names))
    slope = sums.unpivot("fold_id", names, "feature", "g").join(beta, ["fold_id", "feature"])
    return slope.select("fold_id", "feature", (F.round(F.col("g") - 10.0 * F.col("coefficient"), 6) + 0.0).alias("slope"))

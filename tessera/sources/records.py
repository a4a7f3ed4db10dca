"""Readers for the engine's inputs: filings, exhibits, ownership XML, macro CSV, JSON lines, universes, shards.

All of them go through Spark's readers; network access is not part of the engine, so what a client fetched
comes as files or tables.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILING = "accessionNumber array<string>, form array<string>, filingDate array<string>, primaryDocument array<string>"


def submissions(raw: DataFrame, key: str = "cik", body: str = "body") -> DataFrame:
    """One row per filing from issuers' submission lists (columnar JSON); recent and older pages are rows of ``raw``."""
    j = F.from_json(body, f"filings struct<recent:struct<{_colon(FILING)}>>, {FILING}")
    pages = raw.select(key, j.alias("j")).select(key, F.coalesce("j.filings.recent", F.struct("j.accessionNumber", "j.form", "j.filingDate", "j.primaryDocument")).alias("f"))
    each = pages.select(key, F.explode(F.arrays_zip("f.accessionNumber", "f.form", "f.filingDate", "f.primaryDocument")).alias("x"))
    return each.select(key, F.col("x.accessionNumber").alias("accession"), F.col("x.form").alias("form"), F.to_date("x.filingDate").alias("doc_date"), F.col("x.primaryDocument").alias("primary_doc"))


def _colon(ddl: str) -> str:
    return ", ".join(f"{c.split(' ', 1)[0]}:{c.split(' ', 1)[1]}" for c in ddl.split(", "))


def filing_index(raw: DataFrame, key: str = "accession", body: str = "body") -> DataFrame:
    """(accession, name): the files of each filing from its directory JSON."""
    return raw.select(key, F.explode(F.from_json(body, "directory struct<item:array<struct<name:string>>>")["directory"]["item"]["name"]).alias("name"))


def recent_filings(filings: DataFrame, forms: list[str], as_of, limit: int, key: str = "cik") -> DataFrame:
    """The newest ``limit`` filings per issuer of the forms, with a document, up to ``as_of``."""
    w = Window.partitionBy(key).orderBy(F.desc("doc_date"), "accession")
    ok = F.col("form").isin(forms) & (F.col("doc_date") <= F.lit(as_of)) & (F.coalesce("primary_doc", F.lit("")) != "")
    return filings.where(ok).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def resolve_issuers(tickers: DataFrame, directory: DataFrame) -> DataFrame:
    """Tickers with their issuer number, matched without case; unknown ones keep a null."""
    d = directory.select(F.upper("ticker").alias("_t"), "cik")
    return tickers.join(d, F.upper("ticker") == F.col("_t"), "left").drop("_t")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text): one row per file."""
    return spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def fetch_status(pending: DataFrame, fetched: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pending documents with their text, or dropped with the reason that came instead."""
    out = pending.drop("status", "drop_reason").join(fetched.select(key, "text", "error"), key, "left")
    bad = F.col("text").isNull()
    return out.withColumns({"status": F.when(bad, "dropped").otherwise("fetched"), "drop_reason": F.when(bad, F.concat(F.lit("fetch_failed:"), F.coalesce("error", F.lit("missing"))))}).drop("error")


def macro_series(spark: SparkSession, path: str, series_id: str) -> DataFrame:
    """(series_id, value_date, value) from a two-column CSV; a dot is missing, rows that don't parse vanish, so an HTML page gives none."""
    raw = spark.read.csv(path, header=True, schema="d string, v string", enforceSchema=True)
    date = F.try_to_timestamp(F.col("d"), F.lit("yyyy-MM-dd")).cast("date")
    return raw.select(F.lit(series_id).alias("series_id"), date.alias("value_date"), F.expr("try_cast(v as double)").alias("value")).where("value_date is not null and value is not null")


OWNERSHIP = """nonDerivativeTable struct<nonDerivativeTransaction:array<struct<
    securityTitle:struct<value:string>, transactionDate:struct<value:string>, transactionCoding:struct<transactionCode:string>,
    transactionAmounts:struct<transactionShares:struct<value:string>, transactionPricePerShare:struct<value:string>>>>>,
    reportingOwner struct<reportingOwnerId:struct<rptOwnerName:string>, reportingOwnerRelationship:struct<isDirector:string, isOfficer:string, officerTitle:string>>"""


def ownership(raw: DataFrame, key: str = "ticker", body: str = "xml") -> DataFrame:
    """One row per non-derivative transaction of ownership reports; rows without date or shares, and bad XML, give none."""
    x = F.from_xml(body, OWNERSHIP, {"mode": "PERMISSIVE"})
    t = raw.select(key, x.alias("x")).select(key, "x.reportingOwner", F.explode("x.nonDerivativeTable.nonDerivativeTransaction").alias("t"))
    flag = lambda c: F.coalesce(F.lower(F.trim(c)).isin("1", "true"), F.lit(False))
    num = lambda c: F.expr(f"try_cast({c} as double)")
    out = t.select(
        key, F.col("reportingOwner.reportingOwnerId.rptOwnerName").alias("owner"), flag(F.col("reportingOwner.reportingOwnerRelationship.isDirector")).alias("director"),
        flag(F.col("reportingOwner.reportingOwnerRelationship.isOfficer")).alias("officer"), F.try_to_timestamp(F.substring("t.transactionDate.value", 1, 10), F.lit("yyyy-MM-dd")).cast("date").alias("tx_date"),
        F.col("t.transactionCoding.transactionCode").alias("code"), num("t.transactionAmounts.transactionShares.value").alias("shares"), num("t.transactionAmounts.transactionPricePerShare.value").alias("price"),
    )
    return out.where("tx_date is not null and shares is not null")


def ownership_window(tx: DataFrame, as_of, days: int = 180, limit: int = 20, key: str = "ticker") -> DataFrame:
    """Latest transactions per key in the window that ends at ``as_of``."""
    w = Window.partitionBy(key).orderBy(F.desc("tx_date"), "owner", "shares")
    end = F.lit(as_of).cast("date")
    return tx.where((F.col("tx_date") <= end) & (F.col("tx_date") >= F.date_sub(end, days))).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def examples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, counts) of JSON-lines examples: a prompt and a completion that is itself an object with the wanted fields."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    e = lines.select(F.from_json("value", "prompt string, completion string").alias("e")).select("e.*")
    inner = F.from_json("completion", "direction string, conviction double")
    ok = F.col("prompt").isNotNull() & inner["direction"].isin("long", "short", "flat") & inner["conviction"].between(0, 1)
    e = e.withColumn("ok", F.coalesce(ok, F.lit(False)))
    return e.where("ok").drop("ok"), e.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("n_invalid"))


def universe(spark: SparkSession, spec: dict | str) -> DataFrame:
    """(ticker, segment, pilot) from a mapping of segments to symbols, or its JSON file; symbols must be text."""
    if isinstance(spec, str):
        spec = json.loads(Path(spec).read_text())
    rows = []
    pilots = set(spec.get("pilot", []))
    for segment, symbols in spec["segments"].items():
        for s in symbols:
            if not isinstance(s, str):
                raise TypeError(f"symbol {s!r} of {segment} is no text; quote it")
            rows.append((s, segment, s in pilots))
    return spark.createDataFrame(sorted(rows), "ticker string, segment string, pilot boolean")


def shards(spark: SparkSession, path: str, seq_len: int) -> DataFrame:
    """A shard table (shard_id, seq_no, tokens); sequences of another length than ``seq_len`` are an error."""
    df = spark.read.parquet(path)
    bad = df.where(F.size("tokens") != seq_len).take(1)
    if bad:
        raise ValueError(f"a sequence has {len(bad[0]['tokens'])} tokens, not {seq_len}")
    return df


def best_section(sections: DataFrame, priority: list[str], key: str = "doc_id") -> DataFrame:
    """One section per filing: the first of the priority list that is there, else the first by name."""
    rank = F.coalesce(*(F.when(F.col("section") == p, F.lit(i)) for i, p in enumerate(priority)), F.lit(len(priority)))
    w = Window.partitionBy(key).orderBy(rank, "section")
    return sections.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

"""Document catalog: states, upserts, manifests, assertions, incremental stages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATES = ("discovered", "fetched", "cleaned", "deduped", "packed", "dropped")
#: Columns that an upsert doesn't change once a document is known.
IDENTITY = ("ticker", "url", "doc_date", "section", "license_ok")


def upsert(catalog: DataFrame, news: DataFrame, key: str = "doc_id", identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """The catalog with ``news`` inserted or updated; identity columns keep the old value where there is one."""
    old = catalog.withColumn("_old", F.lit(True)).alias("o")
    new = news.withColumn("_new", F.lit(True)).alias("n")
    both = old.join(new, key, "full_outer")
    cols = [F.when(F.col("_old").isNotNull() & (F.lit(c in identity) | F.col("_new").isNull()), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in catalog.columns if c != key]
    return both.select(key, *cols)


def pending(catalog: DataFrame, status: str, limit: int | None = None) -> DataFrame:
    out = catalog.where(F.col("status") == status)
    return out if limit is None else out.limit(limit)


def discovered(filings: DataFrame, forms: list[str], start: dt.date, cutoff: dt.date) -> DataFrame:
    """Filings of the forms since ``start``; those after the cutoff are recorded as dropped, with the reason."""
    late = F.col("doc_date") > F.lit(cutoff)
    return filings.where(F.col("form").isin(forms) & (F.col("doc_date") >= F.lit(start))).withColumns(
        {"status": F.when(late, "dropped").otherwise("discovered"), "drop_reason": F.when(late, "after_cutoff")}
    )


# Names of exhibits, and of files that are none.
EXHIBIT = r"(?i)(ex.?99|cfocommentary|prepared.?remark|commentary|press.?release|earnings)"
EXHIBIT_40F = EXHIBIT + r"|exhibit\s*\d+"
NO_EXHIBIT = r"(?i)(_cal|_def|_lab|_pre|_htm\.xml|\.xsd|R\d+\.htm|FilingSummary)"
WHOLE_SUBMISSION = r"^\d{10}-?\d{2}-?\d{6}\.txt$"


def is_exhibit(name, primary, form):
    """Whether a file of a filing is a text exhibit of interest."""
    pattern = F.when(form.startswith("40-F"), name.rlike(EXHIBIT_40F)).otherwise(name.rlike(EXHIBIT))
    return F.coalesce(name.rlike(r"(?i)\.(htm|html|txt)$") & (name != primary) & ~name.rlike(NO_EXHIBIT) & ~name.rlike(WHOLE_SUBMISSION) & pattern, F.lit(False))


def after_cutoff(catalog: DataFrame, cutoff: dt.date, most: int = 5) -> DataFrame:
    """Kept rows dated after the cutoff; a report of a few, must be empty."""
    return catalog.where((F.col("status") != "dropped") & (F.col("doc_date") > F.lit(cutoff))).limit(most)


def assert_empty(rows: DataFrame, what: str) -> None:
    found = rows.take(1)
    if found:
        raise AssertionError(f"{what}: {found[0].asDict()}")


def unlicensed(catalog: DataFrame) -> DataFrame:
    return catalog.where((F.col("status") != "dropped") & ~F.coalesce("license_ok", F.lit(False)))


def manifest(catalog: DataFrame) -> DataFrame:
    """One row: documents, tokens of finished ones, duplicates, dedup rate, first and last kept date."""
    done = F.col("status").isin("deduped", "packed")
    dup = F.count_if(F.col("drop_reason") == "near_duplicate")
    n = F.count(F.lit(1))
    kept = F.when(F.col("status") != "dropped", F.col("doc_date"))
    return catalog.agg(n.alias("n_docs"), F.coalesce(F.sum(F.when(done, F.col("token_len"))), F.lit(0)).alias("tokens"), dup.alias("n_duplicates"), (dup / F.greatest(n, F.lit(1))).alias("dedup_rate"), F.min(kept).alias("first_date"), F.max(kept).alias("last_date"))


def manifest_sets(catalog: DataFrame) -> DataFrame:
    """Documents and tokens by status, by source, and in all, in one pass over grouping sets."""
    return catalog.groupingSets([[], ["status"], ["source"]], "status", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("token_len").alias("tokens"), F.grouping_id().alias("level"))


def manifest_hash(row: DataFrame) -> DataFrame:
    return row.withColumn("sha256", F.sha2(F.to_json(F.struct(*sorted(row.columns))), 256))


def unseen(docs: DataFrame, indexed: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(indexed.select(key).distinct(), key, "left_anti")


def next_ids(rows: DataFrame, order: list[str], start: int, name: str = "chunk_id") -> DataFrame:
    """Contiguous ids from ``start`` in a total order: numbers inside range partitions plus what lies before."""
    parts = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    parts = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(F.broadcast(before.select("_p", "_b")), "_p").withColumn(name, (F.col("_i") + F.col("_b") + start).cast("bigint")).drop("_p", "_i", "_b")


def neighbours(chunks: DataFrame, refs: DataFrame, radius: int = 1) -> DataFrame:
    """Chunks of the same document within ``radius`` ordinals of each reference (doc_id, ordinal)."""
    r = refs.select("doc_id", F.col("ordinal").alias("at"))
    return chunks.join(r, "doc_id").where(F.col("ordinal").between(F.col("at") - radius, F.col("at") + radius))


def last_record(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: how resumed runs read an append-only log."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

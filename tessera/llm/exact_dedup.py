"""Exact dedup through an extendible-hash index kept on shared files, in DataFrame operations only.

1. Every row gets the 64-bit hash of its normalised text; its top ``depth`` bits name a slot of the directory.
2. The directory starts with one bucket and doubles while a bucket holds more than CAPACITY distinct hashes; only
   overfull buckets split, so local depths differ and all slots of a bucket that didn't split point to it. It is
   worked out from the counts of the slots and kept as a table; a slot that is overfull itself makes the directory double again.
3. Texts whose hash occurs again are looked up through the directory. One row per text and group of tasks goes to the
   owner task of the bucket's key range, which chains the entries of a hash and tells texts apart by their bytes. A bit
   filter keeps all other texts out of that shuffle, and combining before it leaves few rows of a hot text.
4. The index (bucket, hash, digest, survivor, size) is a table in the shared folder, dealt and sorted by bucket and hash, so that
   a bucket is read from one file. Rows find their chain by directory slot, bucket and hash.

Defined results: a null text counts as empty, so null, empty and blank texts are one group; equal
n_chars go to the smaller doc_id, a null doc_id comes last; repeated rows count one by one; extra
columns are kept by ``survivors`` whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, split_by_filter, without

#: Distinct hashes that a bucket may hold.
CAPACITY = 4096
#: Bits of the directory beyond those that buckets of equal size would need, and the least it has.
SPARE = 3
#: Groups with more than this share of the rows are joined by broadcast; there are at most so many of them.
HOT_GROUPS = 1000
#: Slots of a directory that is broadcast; a larger one is joined by shuffling.
SLOTS = 1 << 16
SALTS = 8
_ID_SPAN = "100000000000000000000"  # 10**20, above any 64-bit id


def normalised(text: Column) -> Column:
    """The text without the characters space and U+0009 to U+000D."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", "")


def _hash(norm: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(norm), 64 - bits) if bits < 64 else F.xxhash64(norm)


def _slot(h: Column, bits: int, depth: int) -> Column:
    """The first ``depth`` of a hash's bits."""
    return F.shiftrightunsigned(h, bits - depth) if depth else F.lit(0).cast("bigint")


def directory(hashes: DataFrame, bits: int = 64, capacity: int = CAPACITY, depth: int | None = None) -> tuple[DataFrame, int]:
    """(directory, depth): rows (slot, bucket, local) of the distinct hashes in the one column ``h`` of ``hashes``.

    A bucket is the shortest prefix, of ``local`` bits, under which no more than ``capacity`` hashes stand; its number is
    the last slot it covers. Starts at a depth that suits the count and doubles until no bucket is overfull, or all bits are used.
    """
    if depth is None:
        depth = min(bits, max(0, -(-hashes.count() // capacity) - 1).bit_length() + SPARE)
    while True:
        counts = materialise(hashes.groupBy(_slot(F.col("h"), bits, depth).alias("slot")).agg(F.count(F.lit(1)).alias("n")), "dedup-slots")
        if depth >= bits or not counts.where(F.col("n") > capacity).take(1):
            break
        release(counts)
        depth = min(bits, depth + SPARE)
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("local")
    prefix = lambda: F.call_function("shiftrightunsigned", F.col("slot"), F.lit(depth) - F.col("local"))
    above = counts.select("slot", "n", levels).withColumn("prefix", prefix())
    roomy = above.groupBy("local", "prefix").agg(F.sum("n").alias("n")).where((F.col("n") <= capacity) | (F.col("local") == depth)).select("local", "prefix")
    found = above.join(roomy, ["local", "prefix"]).groupBy("slot").agg(F.min("local").alias("local"))
    last = F.call_function("shiftleft", prefix() + 1, F.lit(depth) - F.col("local")) - 1
    out = materialise(found.select("slot", last.alias("bucket"), "local"), "dedup-directory")
    release(counts)
    return out, depth


def entries(docs: DataFrame, bits: int = 64) -> DataFrame:
    """The narrow entry of each row: doc_id, n (code points), hash, digest of the normalised text."""
    norm = normalised(F.col("text"))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n"),
        _hash(norm, bits).alias("h"),
        F.sha2(norm, 256).alias("digest"),
    )


class Index:
    """An extendible-hash index: ``slots`` (slot, bucket), ``chains`` (bucket, h, digest, keep_id, group_size) and its entries."""

    def __init__(self, own: DataFrame, slots: DataFrame, depth: int, chains: DataFrame, bits: int):
        self.own, self.slots, self.depth, self.chains, self.bits = own, slots, depth, chains, bits

    def place(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the bucket that the directory gives for their ``h``; hashes that it doesn't know go."""
        return _placed(rows, self.slots, self.bits, self.depth)

    def probe(self, rows: DataFrame) -> DataFrame:
        """``rows``, which have ``h`` and ``digest``, with (keep_id, group_size) of their chain's entry; null where there is none.

        Groups of a large share of the rows are few and met by broadcast, so none of them gathers in one task.
        """
        bar = -(-self.own.count() // HOT_GROUPS)
        hot = self.chains.where(F.col("group_size") > bar)
        key = ["bucket", "h", "digest"]
        first = self.place(rows).join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
        done = first.where("_hot").drop("_hot")
        rest = first.where("_hot is null").drop("_hot", "keep_id", "group_size")
        cold = self.chains.where(F.col("group_size") <= bar)
        return done.unionByName(rest.join(cold, key, "left")).drop("bucket")


def _placed(rows: DataFrame, slots: DataFrame, bits: int, depth: int) -> DataFrame:
    table = slots.select("slot", "bucket")
    table = F.broadcast(table) if slots.count() <= SLOTS else table
    return rows.withColumn("slot", _slot(F.col("h"), bits, depth)).join(table, "slot").drop("slot")


def build_index(docs: DataFrame, bits: int = 64, capacity: int = CAPACITY, saved: DataFrame | None = None) -> Index:
    """The index of a table, in the shared folder. Chains hold the texts whose hash occurs again."""
    own = saved if saved is not None else materialise(entries(docs, bits), "dedup-entries")
    hashes = materialise(own.groupBy("h").agg(F.count(F.lit(1)).alias("rows")), "dedup-hashes")
    slots, depth = directory(hashes.select("h"), bits, capacity)
    again = materialise(hashes.where("rows > 1").select("h"), "dedup-again")
    norm = normalised(F.col("text"))
    rank = F.char_length(F.coalesce("text", F.lit(""))).cast("decimal(12,0)") * F.lit(_ID_SPAN).cast("decimal(21,0)") - F.coalesce(
        F.col("doc_id").cast("decimal(20,0)"), F.lit("10000000000000000000").cast("decimal(20,0)")
    )  # the longest, then the smallest doc_id, as one fixed-width number, so hash aggregation combines it map-side
    busy, _ = split_by_filter(docs.select("doc_id", "text"), _hash(norm, bits), again)
    busy = busy.select(_hash(norm, bits).alias("h"), norm.alias("norm"), rank.cast("decimal(38,0)").alias("rank"), (F.spark_partition_id() % SALTS).alias("salt"))
    few = busy.groupBy("h", "norm", "salt").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("group_size"))
    # Owners take ranges of buckets: the entries of a hash are chained there, and equal bytes are one entry.
    dealt = _placed(few, slots, bits, depth).repartitionByRange("bucket")
    chained = dealt.groupBy("bucket", "h", "norm").agg(F.max("rank").alias("rank"), F.sum("group_size").alias("group_size")).where("group_size > 1")
    span = F.lit(_ID_SPAN).cast("decimal(38,0)")
    n = F.round(F.col("rank") / span, 0).cast("decimal(38,0)")  # rank = n * span - id, and ids are far smaller than span
    keep = (n * span).cast("decimal(38,0)") - F.col("rank")
    keep = F.when(keep == F.lit("10000000000000000000").cast("decimal(38,0)"), F.lit(None)).otherwise(keep).cast("bigint")
    index = chained.select("bucket", "h", F.sha2("norm", 256).alias("digest"), keep.alias("keep_id"), "group_size").sortWithinPartitions("bucket", "h")
    chains = materialise(index, "dedup-index")
    release(hashes, again)
    return Index(own, slots, depth, chains, bits)


def report(docs: DataFrame, bits: int = 64, capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of repeated rows with one doc_id that survives, each row says kept.
    """
    index = build_index(docs, bits, capacity)
    found = index.probe(index.own)
    keep = F.when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("digest").alias("text_sha256")
    )


def survivors(docs: DataFrame, bits: int = 64, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; rows without a doc_id stay."""
    index = build_index(docs, bits, capacity)
    found = index.probe(index.own).where("group_size is not null")
    gone = found.where(F.col("doc_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id")
    return without(docs, materialise(gone, "dedup-dropped"))

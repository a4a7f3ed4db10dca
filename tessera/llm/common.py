"""Shared plumbing: tables in the cluster's shared folder, and byte access to Arrow text columns."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session, as in tests, may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"{tempfile.gettempdir()}/tessera-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    The table stays until ``release`` or until the folder is cleared, as what is read from it may be read again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` from which nothing is read any more."""
    for df in tables:
        path = getattr(df, "_table_path", None)
        if path:
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
            df._table_path = None


def unused(df: DataFrame, *stems: str):
    """A column name like each stem that ``df`` doesn't have, in any case of its letters; one stem gives one name."""
    taken, found = {c.lower() for c in df.columns}, []
    for stem in stems:
        name, n = f"_{stem}", 0
        while name.lower() in taken:
            n += 1
            name = f"_{stem}_{n}"
        taken.add(name.lower())
        found.append(name)
    return found[0] if len(found) == 1 else found


def modest_batches(df: DataFrame, rows: int = 1000, size: int = 8 << 20) -> DataFrame:
    """Keep Arrow batches to so many rows and about so many bytes in this session: texts are long, and an executor holds several batches off its heap."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def small(batches, rows: int = 1000):
    """Arrow batches cut to so many rows, so that what is built from one stays small."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


_held: dict = {}


def trim() -> None:
    """Give freed memory back to the system, so that an idle worker holds little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back()


def give_back() -> None:
    """What the C library has been given back goes to the system; takes a few ms, so that a running task can afford it."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def rest(spark: SparkSession) -> None:
    """A full collection in the executors' JVMs, which hands heap that is no longer needed back to the system.

    A heap otherwise keeps the size of the most it ever held, and the Python workers of the next step come on top. One
    task per core, so that an idle cluster gets one everywhere; collections asked for at the same time are one.
    """
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).selectExpr("reflect('java.lang.System', 'gc') as done").write.format("noop").mode("overwrite").save()


def claim(name: str, clear: Callable[[], None]) -> None:
    """Called when a task starts: the caches of another operator, left in this worker by earlier tasks, are cleared."""
    if _held.get("name") not in (None, name):
        _held["clear"]()
        trim()
    _held.update(name=name, clear=clear)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """The texts of a string column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


#: Bits of a filter for each value that it is built of, and its size in bits as a power of two, at least and at most.
FILTER_LOAD, FILTER_LEAST, FILTER_MOST = 16, 16, 28


def filter_bits(values: int) -> int:
    """log2 of the bits of a filter of so many values: FILTER_LOAD bits a value, up to 2**FILTER_MOST (32 MB).

    With more values than that allows (17 million at the full load), a filter lets more pass than it need, and the exact
    joins that follow every filter get more rows.
    """
    return max(FILTER_LEAST, min(FILTER_MOST, (FILTER_LOAD * max(1, values) - 1).bit_length()))


def bit_filter(hashes: DataFrame) -> tuple[int, np.ndarray]:
    """(log2 of its bits, the filter's words): a filter of the 64-bit values in the one column of ``hashes``.

    Two bits a value; its size follows from the count (``filter_bits``). It is built by a combined
    aggregation. It lets all values of the column pass, and few others, so a join must follow.
    """
    bits = filter_bits(hashes.count())
    h, mask = F.col(hashes.columns[0]), F.lit((1 << bits) - 1)
    low, high = h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)
    spread = hashes.select(F.explode(F.array(low, high)).alias("b"))
    spread = spread.select(F.shiftright("b", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("bit"))
    rows = spread.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    for part in rows.to_batches():
        out[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return bits, out.view(np.uint64)


def may_hold(ref: tuple[int, np.ndarray], values: np.ndarray) -> np.ndarray:
    """Whether each unsigned 64-bit value may be in the filter."""
    size, words = ref
    ok = np.ones(len(values), bool)
    for shift in (0, 32):
        b = (values >> np.uint64(shift)) & np.uint64((1 << size) - 1)
        ok &= (words[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) > 0
    return ok


LINE = 64  # words of a filter that one row of its table holds


def split_by_filter(rows: DataFrame, h: Column, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash may be among the one column of ``hashes``, rows whose hash certainly isn't), in the JVM.

    The filter is a table of lines of 64-bit words that is broadcast; ``filter_bits`` sizes it from the count of
    ``hashes`` and bounds it. A null hash is of the second kind.
    """
    bits = filter_bits(hashes.count())
    names = hash_, line, words = unused(rows, "hash", "line", "words")
    slot = lambda x: F.shiftrightunsigned(x, 64 - bits)
    word = lambda x: F.shiftrightunsigned(x, 64 - bits + 6).cast("int")
    each = hashes.select(F.col(hashes.columns[0]).alias("h")).where("h is not null")
    each = each.select(word(F.col("h")).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), slot(F.col("h")).bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    lines = each.groupBy("w").agg(F.bit_or("bit").alias("bits")).groupBy(F.floor(F.col("w") / LINE).cast("int").alias(line))
    lines = lines.agg(F.map_from_entries(F.collect_list(F.struct(F.col("w") % LINE, "bits"))).alias(words))
    marked = rows.withColumn(hash_, h).withColumn(line, F.floor(word(F.col(hash_)) / LINE).cast("int")).join(F.broadcast(lines), line, "left")
    held = F.try_element_at(F.col(words), word(F.col(hash_)) % LINE)
    maybe = F.coalesce(F.getbit(held, slot(F.col(hash_)).bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    return marked.where(maybe).drop(*names), marked.where(~maybe).drop(*names)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in the one column of ``dropped``; only rows that may be dropped are shuffled."""
    name = unused(docs, "gone")
    gone = dropped.select(F.col(dropped.columns[0]).cast("bigint").alias(name))
    h = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("bigint")))
    maybe, sure = split_by_filter(docs, h, gone.select(F.xxhash64(name)))
    return sure.unionByName(maybe.join(gone.distinct(), maybe["doc_id"] == F.col(name), "left_anti"))

"""Substring dedup with one compressed FM-index per shard.

A window is WINDOW consecutive words. Its anchor is the smallest of the hashes of its GRAM-word grams, the leftmost
of equals, so equal windows have equal anchors, wherever they stand. The windows of a text that share an
anchor's place make a passage of at most 2 * WINDOW - GRAM words; only passages with one anchor can
hold equal windows, so anchors deal passages to shards.

1. Anchors are counted, combined before the shuffle. An anchor seen once has no repeated window. One whose
   passages are all the same has only repeated ones.
2. Of the others ("mixed") each distinct passage is sent once. A shard writes its passages one after
   another, builds their suffix array, and keeps the Burrows-Wheeler transform in a wavelet tree of packed bits.
   Every passage streams through by backward search: the longest match that still occurs twice ends at each
   tried place (matching statistics), and stretches of WINDOW words or more are reported as intervals.
3. Shards hold whole groups. A group of more than HOT passages (a passage in very many contexts) is split by the context that its
   windows hold: those that begin further before the anchor hold more words before it, the others more words after it, so each half
   of them is grouped anew by the words that all of its windows hold, down to single windows. A group that is still larger then
   has one and the same window in all of its passages.
4. Intervals go back to their documents, and covered words are removed.

Words, grams, passages and windows are compared by 64-bit hashes inside an anchor's group. Two bit filters, sized by
counts up to a bound (``common.filter_bits``), keep passages of anchors seen once out of the second shuffle.

A row is known by its id and a 64-bit hash of id and text.

Defined results: null or wordless texts have no words and the digest of the empty text; repeated rows
repeat each other's windows, so they lose them; texts shorter than a window stay; a null doc_id is kept as
null; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, claim, materialise, may_hold, modest_batches, small
from .words import mix, portions

WINDOW, GRAM = 35, 16
SPAN = WINDOW - GRAM + 1  # grams in a window
SHARD = 4096  # passages
HOT = 2048  # passages of one group that a shard takes whole
PORTION = 1 << 19  # bytes of text that are worked on at once
FEW = 100_000  # keys that are broadcast; more are joined by shuffling

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _forget() -> None:
    _powers[:] = [x[:1].copy() for x in _powers]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = 1 << int(n).bit_length()
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            with np.errstate(over="ignore"):
                _powers[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))])
    return _powers[0], _powers[1]


class Runs:
    """Hashes of any run of words in constant time."""

    def __init__(self, h: np.ndarray):
        up, self.down = _power(len(h) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h) * up[: len(h)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def all(self, k: int) -> np.ndarray:
        """The hashes of all runs of ``k`` words; there must be one."""
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k] + np.uint64(k))


def least(values: np.ndarray, span: int) -> np.ndarray:
    """Where the smallest of each ``span`` consecutive values stands, the leftmost of equals."""
    place, width = np.arange(len(values), dtype=np.int32), 1
    while width < span:
        step = min(width, span - width)  # windows of ``width`` and those ``step`` further
        right = values[step:] < values[:-step]
        place = np.where(right, place[step:], place[:-step])
        values = np.minimum(values[step:], values[:-step])
        width += step
    return place.astype(np.int64)


def passages(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, number of windows, anchor, hash of the words) of each passage of some texts.

    ``h`` has the hashes of their words, one text after another, and text k those from ``first[k]`` to ``first[k + 1]``;
    windows are counted through all of ``h``.
    """
    windows = np.maximum(np.diff(first) - WINDOW + 1, 0)
    n = int(windows.sum())
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    runs = Runs(h)
    grams = runs.all(GRAM)
    begin = np.cumsum(windows) - windows
    at = np.repeat(first[:-1] - begin, windows) + np.arange(n)  # the windows that lie in one text
    place = least(grams, SPAN)[at]
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))  # no place serves two texts
    count = np.diff(np.append(new, n))
    lo, place = at[new], place[new]
    content = runs.of(lo, lo + count - 1 + WINDOW) ^ mix((place - lo).astype(np.uint64))
    return np.searchsorted(first, lo, "right") - 1, lo, count, grams[place], content


def _count_pass(batches):
    claim("runs", _forget)
    for batch in small(batches):
        for _, _, words in portions(batch.column(0), PORTION):
            _, _, _, anchor, content = passages(words.hashes(), words.first)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))], ["anchor", "content"])


PASSAGE = "doc_id bigint, rid bigint, lo int, windows int, anchor bigint, content bigint, words binary"


def _binary(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes of ``values[start : start + size]`` for each; null for those of size 0."""
    ends = np.cumsum(size)
    data = values[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
    offset = np.concatenate([[0], ends * values.itemsize]).astype(np.int32)
    valid = np.packbits(size > 0, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(size), [pa.py_buffer(valid), pa.py_buffer(offset), pa.py_buffer(data)])


def _passage_pass(ref):
    def run(batches):
        claim("runs", _forget)
        shared, mixed = ref.value
        sent: set[int] = set()  # passages whose words this task has sent
        for batch in small(batches):
            ids, rids = batch.column("doc_id"), batch.column("rid")
            for row, _, words in portions(batch.column("text"), PORTION):
                h = words.hashes()
                text, lo, n, anchor, content = passages(h, words.first)
                keep = np.flatnonzero(may_hold(shared, anchor))
                if not len(keep):
                    continue
                text, lo, n, anchor, content = text[keep], lo[keep], n[keep], anchor[keep], content[keep]
                fresh = np.flatnonzero(may_hold(mixed, anchor))
                some, where = np.unique(content[fresh], return_index=True)
                unsent = np.array([c not in sent for c in some.tolist()], bool)
                if len(sent) > 200_000:
                    sent.clear()
                sent.update(some[unsent].tolist())
                size = np.zeros(len(lo), np.int64)
                fresh = fresh[where[unsent]]
                size[fresh] = n[fresh] - 1 + WINDOW
                rows = pa.array(text + row)
                columns = [ids.take(rows), rids.take(rows), *(pa.array(x.astype(np.int32)) for x in (lo - words.first[text], n))]
                columns += [*(pa.array(x.view(np.int64)) for x in (anchor, content)), _binary(h, lo, size)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PASSAGE.split(", ")])

    return run


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol must be unique and smallest."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, width = len(text), 1
    while True:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        width *= 2


_LOWER = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)  # the bits below each bit of a word


class WaveletTree:
    """Levelwise wavelet tree of a symbol sequence: packed bits, with a count per 64-bit word."""

    def __init__(self, symbols: np.ndarray):
        self.depth = max(1, int(symbols.max()).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        now = symbols
        for level in range(self.depth - 1, -1, -1):
            bit = ((now >> level) & 1).astype(np.uint8)
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.bits.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1]]))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` stands before place ``at``, plus where the symbol's block begins; see ``Index.extend``."""
        way = (symbol >> np.arange(self.depth - 1, -1, -1)[:, None]) & 1 != 0
        for bits, before, zeros, one in zip(self.bits, self.before, self.zeros, way, strict=True):
            word = at >> 6
            ones = before.take(word) + np.bitwise_count(bits.take(word) & _LOWER.take(at & 63))
            at = np.where(one, ones + zeros, at - ones)
        return at


class Index:
    """FM-index of passages. In the tree's last order the symbols stand sorted by bit-reversed path; ``base`` is where each begins there."""

    def __init__(self, parts: list[np.ndarray]):
        words = np.concatenate(parts)
        self.names, ids = np.unique(words, return_inverse=True)
        sizes = np.array([len(p) for p in parts])
        # After each passage a separator of its own, all smaller than any word; 0 ends the text.
        k = len(parts)
        text = np.zeros(len(ids) + k + 1, np.int64)
        ends = np.cumsum(sizes + 1) - 1
        text[ends] = np.arange(1, k + 1)
        free = np.ones(len(text), bool)
        free[ends] = False
        free[-1] = False
        text[free] = ids + k + 1
        order = suffix_array(text)
        last = text[order - 1]
        self.first = np.searchsorted(np.sort(text), np.arange(k + 1, k + 1 + len(self.names)))
        self.tree = WaveletTree(np.where(last > k, last - k, 0))  # separators are one symbol: no match crosses them
        every = np.arange(1, len(self.names) + 1)
        self.base = self.tree.rank(every, np.zeros(len(every), np.int64))
        self.codes = ids
        self.begin = np.cumsum(sizes) - sizes

    def extend(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the suffix range of word ``code`` followed by what the range stands for."""
        n = len(code)
        both = self.tree.rank(np.concatenate([code, code]) + 1, np.concatenate([low, high]))
        shift = self.first[code] - self.base[code]
        return both[:n] + shift, both[n:] + shift

    def reach(self, begin: np.ndarray, end: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Smallest start >= floor from which the words up to ``end`` of a passage at ``begin`` occur twice."""
        start = end.copy()
        low, high = np.zeros(len(end), np.int64), np.full(len(end), len(self.codes) + len(self.begin) + 1)
        live = np.flatnonzero(start > floor)
        while len(live):
            code = self.codes[begin[live] + start[live] - 1]
            lo, hi = self.extend(code, low[live], high[live])
            ok = hi - lo >= 2
            live, low_, high_ = live[ok], lo[ok], hi[ok]
            low[live], high[live] = low_, high_
            start[live] -= 1
            live = live[start[live] > floor[live]]
        return start


def repeated_windows(parts: list[np.ndarray], known: np.ndarray | None = None) -> np.ndarray:
    """For each passage a bit per window (bit i: the window at word i) that occurs in the shard twice; ``known`` ones have only such windows."""
    index = Index(parts)
    size = np.array([len(p) for p in parts])
    mask = np.zeros(len(parts), np.int64)
    zero = np.zeros(len(parts), np.int64)

    def mark(who, start, end):  # windows within the match [start, end)
        n = end - start - WINDOW + 1
        hit = n > 0
        mask[who[hit]] |= ((np.int64(1) << n[hit]) - 1) << start[hit]

    known = np.zeros(len(parts), bool) if known is None else known
    mask[known] = (np.int64(1) << (size[known] - WINDOW + 1)) - 1
    who = np.flatnonzero(~known)
    start = index.reach(index.begin[who], size[who], zero[who])
    mark(who, start, size[who])
    # Windows that begin before ``start`` all hold the words [start - 1, WINDOW); where these are unique none repeats.
    who, start = who[start > 0], start[start > 0]
    top = np.minimum(start - 1, size[who] - WINDOW)  # the last window still open
    core = index.reach(index.begin[who], np.full(len(who), WINDOW), zero[who])
    mark(who, core, np.full(len(who), WINDOW))
    open_ = core <= top
    who, top = who[open_], top[open_]
    while len(who):
        end = top + WINDOW
        start = index.reach(index.begin[who], end, zero[who])
        mark(who, start, end)
        top = np.minimum(top - 1, start - 1)  # a shorter match says nothing of the windows before
        more = top >= 1
        who, top = who[more], top[more]
    return mask


ROW = "anchor bigint, content bigint, windows int, copies bigint, words binary, low int, high int, key bigint"
MASK = "anchor bigint, content bigint, mask bigint"


def _place(words: np.ndarray, anchor: int) -> int:
    """Where the anchor gram begins in a passage."""
    at = np.arange(len(words) - GRAM + 1)
    return int(np.flatnonzero(Runs(words).of(at, at + GRAM).view(np.int64) == anchor)[0])


def _range(words: np.ndarray, anchor: int, windows: int, low: int, high: int) -> tuple[int, int]:
    """[first, last) of the windows that hold ``low`` to ``high`` words before the anchor."""
    if (low, high) == (0, SPAN - 1):
        return 0, windows
    a = _place(words, anchor)
    return max(0, a - high), min(windows, a - low + 1)


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    parts, first = [], []
    for raw, anchor, windows, low, high in zip(pdf["words"], pdf["anchor"], pdf["windows"], pdf["low"], pdf["high"], strict=True):
        words = np.frombuffer(raw, np.uint64)
        a, b = _range(words, anchor, windows, low, high)
        parts.append(words[a : b - 1 + WINDOW])
        first.append(a)
    mask = repeated_windows(parts, pdf["copies"].to_numpy() > 1)
    return pd.DataFrame({"anchor": pdf["anchor"], "content": pdf["content"], "mask": mask << np.array(first, np.int64)})


def _split(batches):
    """Each row's windows in two halves by the words they hold before the anchor, each with the hash of the words that all of it holds."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
    names = [c.split()[0] for c in ROW.split(", ")]
    for batch in small(batches):
        out: list[tuple] = []
        for anchor, content, windows, copies, raw, low, high, _ in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            words = np.frombuffer(raw, np.uint64)
            a, runs, middle = _place(words, anchor), Runs(words), (low + high + 1) // 2
            for lo, hi in ((low, middle - 1), (middle, high)):
                begin, end = _range(words, anchor, windows, lo, hi)
                if begin < end:
                    key = runs.of(np.array([a - lo]), np.array([a + WINDOW - hi])) ^ mix(np.array([lo * SPAN + hi], np.uint64))
                    out.append((anchor, content, windows, copies, raw, lo, hi, int(key.view(np.int64)[0])))
        columns = zip(*out, strict=True) if out else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _same_window(batches):
    """The masks of rows whose windows, one a row, are known to be equal."""
    for batch in small(batches):
        out = []
        for anchor, content, windows, low, high, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "windows", "low", "high", "words")), strict=True):
            first, last = _range(np.frombuffer(raw, np.uint64), anchor, windows, low, high)
            out.append((anchor, content, ((1 << (last - first)) - 1) << first))
        columns = zip(*out, strict=True) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "content", "mask"])


def _indexed(rows: DataFrame) -> DataFrame:
    """Masks of the repeated windows of some rows, through one index per shard of whole groups."""
    shards = max(1, -(-rows.count() // SHARD))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).repartition(min(shards, 20_000), "shard")
    return dealt.groupBy("shard").applyInPandas(_search, MASK)


def _masks(distinct: DataFrame) -> DataFrame:
    """(anchor, content, mask) of distinct passages of mixed anchors."""
    now = distinct.select("anchor", "content", "windows", "copies", "words", F.lit(0).alias("low"), F.lit(SPAN - 1).alias("high"), F.col("anchor").alias("key"))
    found = None

    def add(more):
        nonlocal found
        found = more if found is None else found.unionByName(more)

    while True:
        hot = materialise(now.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key"), "hot")
        n = hot.count()
        if not n:
            add(_indexed(now))
            return found
        hot = F.broadcast(hot) if n <= FEW else hot
        add(_indexed(now.join(hot, "key", "left_anti")))
        large = now.join(hot, "key", "left_semi").select(*now.columns)
        add(large.where("low = high").mapInArrow(_same_window, MASK))
        now = materialise(large.where("low < high").mapInArrow(_split, ROW), "split")


_PLAIN = bytes(32 if c == 32 or 9 <= c <= 13 else c for c in range(256))


def _windows(found: pa.Array, first: np.ndarray) -> np.ndarray:
    """The places of the repeated windows in a list of passages per text, counted like ``first``."""
    text = np.repeat(first[: len(found)], pc.fill_null(pc.list_value_length(found), 0).to_numpy())
    flat = found.flatten()
    lo, mask = (flat.field(k).to_numpy() for k in ("lo", "mask"))
    which, bit = np.nonzero(mask[:, None] >> np.arange(SPAN) & 1)
    return text[which] + lo[which] + bit


def _removed(batches):
    for batch in small(batches):
        for low, high, words in portions(batch.column("text"), PORTION):
            n = len(words.start)
            begins = np.zeros(n + 1, np.int64)
            begins[_windows(batch.column("found").slice(low, high - low), words.first) + 1] = 1
            begins = np.cumsum(begins)  # windows that begin before each word
            stay = begins[1:] == begins[np.maximum(np.arange(n) - WINDOW + 1, 0)]
            kept = np.concatenate([[0], np.cumsum(stay)])[words.first]
            # Each kept word with the byte that follows it in its text, which becomes the space between two.
            last = words.offset[np.searchsorted(words.offset, words.start, "right")]
            edge = np.zeros(len(words.data) + 1, np.int8)
            edge[words.start[stay]] = 1
            edge[np.minimum(words.end + 1, last)[stay]] -= 1
            chosen = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
            out = words.data[chosen].tobytes().translate(_PLAIN)
            ends = np.concatenate([[0], np.cumsum(chosen)])[words.offset].tolist()
            digest = [hashlib.sha256(out[a:b].rstrip(b" ")).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
            n_words = np.diff(words.first)
            columns = [batch.column("doc_id").slice(low, high - low), pa.array(n_words), pa.array(n_words - np.diff(kept)), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"])


def intervals(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, lo, mask): passages with repeated windows; ``docs`` has doc_id, rid and text."""
    spark = docs.sparkSession
    counted = docs.select("text").mapInArrow(_count_pass, "anchor bigint, content bigint").groupBy("anchor")
    counted = counted.agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("least"), F.max("content").alias("most"))
    shared = materialise(counted.where("n > 1").select("anchor", (F.col("least") != F.col("most")).alias("mixed")), "anchors")
    ref = spark.sparkContext.broadcast((bit_filter(shared.select("anchor")), bit_filter(shared.where("mixed").select("anchor"))))
    found = docs.mapInArrow(_passage_pass(ref), PASSAGE).join(shared, "anchor")
    found = materialise(found, "passages")
    distinct = (
        found.where("mixed").groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), F.first("windows").alias("windows"), F.max("words").alias("words"))
    )
    masks = materialise(_masks(materialise(distinct, "contents")).where("mask <> 0"), "masks")
    full = F.expr("shiftleft(1L, windows) - 1")
    same = found.where("not mixed").select("doc_id", "rid", "lo", full.alias("mask"))
    part = found.where("mixed").select("doc_id", "rid", "lo", "anchor", "content").join(masks, ["anchor", "content"]).select("doc_id", "rid", "lo", "mask")
    return same.unionByName(part)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    own = modest_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("rid", F.xxhash64("doc_id", "text"))
    found = intervals(own).groupBy(F.col("rid").alias("r"), F.col("doc_id").alias("d")).agg(F.collect_list(F.struct("lo", "mask")).alias("found"))
    return own.join(found, (own["rid"] == found["r"]) & own["doc_id"].eqNullSafe(found["d"]), "left").select("doc_id", "text", "found").mapInArrow(_removed, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")

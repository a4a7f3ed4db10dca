"""N-gram Jaccard self-join by a distributed prefix tree.

A document's set: its distinct 5-word shingles as 64-bit hashes. The global order of shingles is: rare
ones by hash, then frequent ones by how frequent they are. Two sets that link share a shingle among the
first n - ceil(0.8 n) + 1 of each, so those shingles are the branches of the tree that owner tasks hold:

1. One pass finds the digest of each set and the frequent shingles (in 1 document of RARE or more; their
   number is bounded by the mean set size times RARE, whatever the input). Counts leave out shingles that a block of a million
   has once, so they are lower bounds; they set the order only, and any order finds all links. Equal sets are one node.
2. A second pass writes each node's branches. Every node of a branch is paired with the branch's leader, a
   node drawn by hash, so a node in many branches meets many others of its kind at linear cost.
3. A parity signature (a bit per shingle hash, xor) bounds the symmetric difference from below and drops
   most pairs that can't link, and never one that can.
4. Exact overlap: the sets paired with one node form a trie in the global order, walked depth first; sets
   that share a beginning share the partial overlap, and a subtree ends where what remains can't reach
   the overlap that a link needs. First each node with its nearest leader, then its other leaders where they
   may connect components; then, with the components known, every pair of a branch's nodes in different components, so no link that connects is lost and
   groups of copies aren't expanded into pairs. In branches of more than HOT nodes those outside the
   leader's component meet the rest in a join that splits skewed keys.

Defined results: null or wordless texts have an empty set and link with nothing; a row with a null doc_id
is returned, with a null component; repeated rows are one node; an empty table gives no rows; only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, claim, materialise, may_hold, modest_batches, small, trim, utf8, without
from .components import components
from .words import TABLE, grams

K = 5
NUM, DEN = 4, 5  # similarity 0.8
RARE = 5000
LEAST_FREQUENT = 32
HOT = 4096  # nodes of a branch that one task pairs up; the pairs of a larger one are found by a join, and all pairs are verified in tries
HOT_SETS = 1000  # sets that more than one row in so many has are met by broadcast
TRIE = 256  # sets in one trie


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = TABLE.of(words)
    if len(h) < K:
        return grams(h, len(h)) ^ np.uint64(len(h))  # the whole sequence, apart from shingles of K words
    return np.unique(grams(h, K))


def need(a: int, b: int) -> int:
    """Least overlap with which sets of sizes ``a`` and ``b`` link."""
    return -(-NUM * (a + b) // (NUM + DEN))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _first_pass(batches):
    """Rows kind 0: (doc_id, n, digest); kind 1: (shingle, documents of this task that have it), from two up."""
    parts, held, rows = [], 0, 0

    def counted():
        every = np.sort(np.concatenate([np.zeros(0, np.uint64), *parts]))
        edge = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        n = np.diff(np.append(edge, len(every)))
        many = n > 1
        return every[edge][many], n[many]

    def out(kind, key, n, digest):
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(n), pa.int32()), key, pa.array(n, pa.int64()), digest], ["kind", "key", "n", "digest"])

    def flush():
        key, n = counted()
        for i in range(0, len(key), 100_000):
            yield out(1, _signed(key[i : i + 100_000]), n[i : i + 100_000], pa.nulls(len(key[i : i + 100_000]), pa.binary()))

    claim("words", TABLE.clear)
    for batch in small(batches):
        sets = [shingles(t) for t in utf8(batch.column("text"))]
        yield out(0, batch.column("doc_id"), [len(s) for s in sets], pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()))
        for s in sets:
            parts.append(s)
            held += len(s)
        if held > 1_000_000:
            yield from flush()
            parts, held = [], 0
    yield from flush()
    parts = []
    trim()


def _ordered(s: np.ndarray, heavy: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, int]:
    """The set in global order, and how many of its shingles are frequent."""
    if not len(heavy):
        return s, 0
    at = np.searchsorted(heavy, s)
    at[at == len(heavy)] = 0
    often = heavy[at] == s
    n = int(often.sum())
    if not n:
        return s, 0
    tail = s[often]
    return np.concatenate([s[~often], tail[np.argsort(level[at[often]], kind="stable")]]), n


def parity(s: np.ndarray) -> bytes:
    """Xor of one bit per shingle, in the least power of two of bits from the set's size up (64 at least)."""
    bits = 1 << max(6, int(len(s) - 1).bit_length())
    count = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(count.astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """At least so many shingles are in one set only; the longer signature is folded to the shorter's length."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _second_pass(ref):
    def run(batches):
        claim("words", TABLE.clear)
        heavy, level = ref.value
        for batch in small(batches):
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc, text in zip(ids, utf8(batch.column("text")), strict=True):
                s = shingles(text)
                n = len(s)
                if n and doc is not None:
                    order, often = _ordered(s, heavy, level)
                    rows.append((doc, n, often, order[: n + (-NUM * n // DEN) + 1].view(np.int64).copy(), parity(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest()))
            if rows:
                d, n, o, b, p, g = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, pa.int64()), pa.array(n, pa.int32()), pa.array(o, pa.int32()), pa.array(b, pa.list_(pa.int64())), pa.array(p, pa.binary()), pa.array(g, pa.binary())],
                    ["doc_id", "n", "often", "branches", "sig", "digest"],
                )
        trim()

    return run


def _folded(sig: np.ndarray, width: int) -> np.ndarray:
    """Signatures, one a row, folded to ``width`` words."""
    while sig.shape[1] > width:
        half = sig.shape[1] // 2
        sig = sig[:, :half] ^ sig[:, half:]
    return sig


def _cross_pairs(doc: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray, sig: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one branch's nodes in different components that sizes, remaining lengths and signatures let link.

    ``pos`` is the branch's place in each set. Where it is the first common shingle of a pair, the overlap is at
    most what remains of either set from there; a pair that this rules out is met again at its first common one.
    """
    left = n - pos
    _, at, count = np.unique(root, return_inverse=True, return_counts=True)
    width = np.array([len(x) // 8 for x in sig])
    kinds = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
    table = {w: np.frombuffer(b"".join(sig[i] for i in who), np.uint64).reshape(len(who), w) for w, who in kinds.items()}
    place = np.zeros(len(doc), np.int64)
    for who in kinds.values():
        place[who] = np.arange(len(who))
    low, high = [], []
    for i in np.flatnonzero(at != count.argmax()):  # the largest component meets the others only
        own, wi = table[int(width[i])][place[i] : place[i] + 1], int(width[i])
        for w, who in kinds.items():
            if max(w, wi) > 2 * min(w, wi):
                continue  # such sizes can't link
            ok = (root[who] != root[i]) & (NUM * np.maximum(n[who], n[i]) <= DEN * np.minimum(n[who], n[i]))
            ok &= np.minimum(left[who], left[i]) * (NUM + DEN) >= NUM * (n[who] + n[i])
            met = who[ok]
            if len(met):
                common = min(w, wi)
                gap = np.bitwise_count(_folded(table[w][ok], common) ^ _folded(own, common)).sum(axis=1)
                total = n[met] + n[i]
                met = met[gap <= total - 2 * -(-NUM * total // (NUM + DEN))]
                low.append(np.minimum(doc[met], doc[i]))
                high.append(np.maximum(doc[met], doc[i]))
    return np.concatenate([doc[:0], *low]), np.concatenate([doc[:0], *high])


def _pair_up(batches):
    """Rows (branch, doc_id, n, pos, root, sig) sorted by branch: pairs across components, once per task and block of branches."""
    rest, found, held = None, [], 0

    def out():
        a, b = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first])], ["a", "b"])

    def walk(t):
        nonlocal held
        branch, doc, n, pos, root = (t.column(c).to_numpy() for c in ("branch", "doc_id", "n", "pos", "root"))
        sig = t.column("sig")
        edge = np.flatnonzero(np.concatenate([[True], branch[1:] != branch[:-1], [True]])) if len(branch) else []
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            pair = _cross_pairs(doc[i:j], n[i:j].astype(np.int64), pos[i:j].astype(np.int64), root[i:j], sig.slice(i, j - i).to_pylist())
            found.append(pair)
            held += len(pair[0])

    for batch in batches:
        t = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        branch = t.column("branch").to_numpy()
        cut = int(np.searchsorted(branch, branch[-1])) if len(branch) else 0
        rest = t.slice(cut).to_batches()[0] if len(branch) > cut else None
        walk(t.slice(0, cut))
        if held > 500_000:
            yield out()
            found.clear()
            held = 0
    if rest is not None:
        walk(pa.Table.from_batches([rest]))
    yield out()
    rest = None
    found.clear()
    trim()


def _may_link(batches):
    """Drop pairs that sizes or signatures rule out; keep a distance estimate."""
    for batch in batches:
        na, nb, sa, sb = (batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb"))
        gap = np.array([apart(x, y) for x, y in zip(sa, sb, strict=True)], np.int64)
        most = np.array([x + y - 2 * need(x, y) for x, y in zip(na, nb, strict=True)], np.int64)
        small = np.array([min(x, y) >= need(x, y) for x, y in zip(na, nb, strict=True)], bool)
        keep = pa.array((gap <= most) & small)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(gap).filter(keep)], ["a", "b", "gap"])


def _sets(ref, ends):
    def run(batches):
        claim("words", TABLE.clear)
        heavy, level = ref.value
        for batch in small(batches):
            keep = may_hold(ends.value, batch.column("h").to_numpy().view(np.uint64))
            batch = batch.filter(pa.array(keep))
            made = [_ordered(shingles(t), heavy, level)[0].astype("<u8").tobytes() for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "set"])
        trim()

    return run


def walk_trie(probe: np.ndarray, others: list[np.ndarray]) -> list[bool]:
    """Whether each of ``others`` links with ``probe``; all are in the global order.

    The others in lexicographic order are a depth-first walk of their trie. reach[d] is the overlap of
    the probe with the path down to depth d; it is kept for the depth shared with the set before. A walk down ends
    where overlap so far plus the remaining length is below what a link needs.
    """
    inside = np.sort(probe)
    m = len(probe)
    order = sorted(range(len(others)), key=lambda i: others[i].astype(">u8").tobytes())
    result = [False] * len(others)
    reach = np.zeros(1, np.int64)
    before, depth = probe[:0], 0
    for i in order:
        s = others[i]
        n = len(s)
        top = min(len(before), n, depth)
        differ = np.flatnonzero(before[:top] != s[:top])
        shared = int(differ[0]) if len(differ) else top
        goal = need(m, n)
        reach = reach[: shared + 1]
        depth = shared
        while depth < n:
            if reach[depth] + min(n - depth, m - reach[depth]) < goal:
                break
            step = s[depth : depth + 64]
            at = np.searchsorted(inside, step)
            at[at == m] = 0
            hit = (inside[at] == step) if m else np.zeros(len(step), bool)
            reach = np.concatenate([reach, reach[depth] + np.cumsum(hit)])
            depth += len(step)
        result[i] = depth == n and bool(reach[n] >= goal)
        before = s
    return result


def _verify(batches):
    """Rows (a, salt, b, set) sorted by (a, salt), the probe's own row (b null) first: the pairs that link."""
    key, probe, names, sets = None, None, [], []

    def close():
        if names:
            ok = pa.array(walk_trie(probe, sets))
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(names), pa.int64()).filter(ok), pa.array(names, pa.int64()).filter(ok)], ["a", "b"])

    for batch in batches:
        for a, salt, b, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b", "set")), strict=True):
            if (a, salt) != key:
                yield from close()
                key, probe, names, sets = (a, salt), None, [], []
            s = np.frombuffer(raw, "<u8")
            if b is None:
                probe = s
            elif probe is not None:
                names.append(b)
                sets.append(s)
                if len(names) == TRIE:
                    yield from close()
                    names, sets = [], []
    yield from close()
    probe, names, sets = None, [], []
    trim()


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. The partners of one node are split over salts of TRIE sets."""
    salted = pairs.select("a", "b").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(1 << 20)).cast("int"))
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TRIE).cast("int").alias("parts"))
    salted = salted.join(many, "a").select("a", "b", F.pmod("salt", "parts").alias("salt"))
    partners = salted.join(sets, salted["b"] == sets["doc_id"]).select("a", "salt", "b", "set")
    probes = salted.select("a", "salt").distinct().join(sets, F.col("a") == sets["doc_id"]).select("a", "salt", F.lit(None).cast("bigint").alias("b"), "set")
    rows = partners.unionByName(probes).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_verify, "a bigint, b bigint")


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): rows (doc_id, n, digest, node) of every document, roots (node, root) of nodes with a link."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = materialise(modest_batches(own).mapInArrow(_first_pass, "kind int, key bigint, n bigint, digest binary"), "ngram-first")
    rows = first.where("kind = 0").select(F.col("key").alias("doc_id"), "n", "digest")
    total = rows.count()
    bar = max(LEAST_FREQUENT, total // RARE)
    often = first.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= bar).toPandas()
    key = often["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    ref = spark.sparkContext.broadcast((key[order], np.log2(np.maximum(1, often["n"].to_numpy(np.int64)[order])).astype(np.int64)))
    nodes = rows.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    branches = own.mapInArrow(_second_pass(ref), "doc_id bigint, n int, often int, branches array<bigint>, sig binary, digest binary")
    mine = nodes.select(F.col("node"), F.col("digest").alias("d"))
    branches = materialise(branches.join(mine, (F.col("doc_id") == F.col("node")) & (F.col("digest") == F.col("d")), "left_semi").drop("digest"), "ngram-branches")
    spread = branches.select(F.posexplode("branches").alias("pos", "branch"), "doc_id", "n").withColumn("lot", F.xxhash64("branch", "doc_id"))
    # How many nodes a branch has, combined before its shuffle; branches of one node end here.
    sizes = spread.groupBy("branch").agg(F.count(F.lit(1)).alias("size"), F.min("lot").alias("least")).where("size > 1")
    busy = materialise(spread.join(sizes, "branch"), "ngram-busy")
    leaders = busy.where("lot = least").groupBy("branch").agg(F.min("doc_id").alias("leader"))
    led = busy.select("branch", "doc_id", "n", "size").join(leaders, "branch").where("doc_id <> leader")
    star = led.select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct()
    sigs = branches.select("doc_id", "n", "sig")

    def screened(found: DataFrame) -> DataFrame:
        left, right = sigs.toDF("a", "na", "sa"), sigs.toDF("b", "nb", "sb")
        return found.join(left, "a").join(right, "b").mapInArrow(_may_link, "a bigint, b bigint, gap bigint")

    pairs = materialise(screened(star), "ngram-star")

    def across(found: DataFrame, roots: DataFrame) -> DataFrame:
        ra, rb = roots.toDF("a", "ra"), roots.toDF("b", "rb")
        return found.join(ra, "a", "left").join(rb, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")

    def sets_of(found: DataFrame) -> DataFrame:
        """Sets, in the global order, of the nodes of some pairs: a filtered pass over the documents."""
        ends = materialise(found.select(F.col("a").alias("doc_id")).unionAll(found.select("b")).distinct(), "ngram-ends")
        bits = spark.sparkContext.broadcast(bit_filter(ends.select(F.xxhash64("doc_id").alias("h"))))
        sets = own.withColumn("h", F.xxhash64("doc_id")).mapInArrow(_sets(ref, bits), "doc_id bigint, set binary")
        return materialise(sets.join(ends, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "ngram-sets")

    def merged(roots: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Components with the links among ``pairs`` added."""
        links = materialise(_linked(pairs, sets), "ngram-links")
        if not links.take(1):
            return roots
        stars = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        return materialise(components(stars.unionAll(links)), "ngram-roots")

    # First each node with the nearest of its leaders, then the other pairs that could still connect two components.
    sets = sets_of(pairs)
    roots = spark.createDataFrame([], "node bigint, root bigint")
    both = pairs.select("a", "b", "gap").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "gap"))
    near = both.groupBy("a").agg(F.min(F.struct("gap", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    near = materialise(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "ngram-near")
    roots = merged(roots, near, sets)
    roots = merged(roots, across(pairs.select("a", "b").join(near, ["a", "b"], "left_anti"), roots), sets)
    # Then every pair of nodes of one branch that are still in different components.
    known = busy.select("branch", "doc_id", "n", "pos", "size").join(roots.toDF("doc_id", "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    torn = known.groupBy("branch").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("branch")
    known = materialise(known.join(torn, "branch", "left_semi"), "ngram-torn")
    calm = known.where(F.col("size") <= HOT).select("branch", "doc_id", "n", "pos", "root").join(branches.select("doc_id", "sig"), "doc_id")
    rest = calm.select("branch", "doc_id", "n", "pos", "root", "sig").repartition("branch").sortWithinPartitions("branch").mapInArrow(_pair_up, "a bigint, b bigint")
    large = known.where(F.col("size") > HOT)
    head = large.join(leaders, "branch").where("doc_id = leader").select("branch", F.col("root").alias("head"))
    stray = large.join(head, "branch").where("root <> head").select("branch", F.col("doc_id").alias("s"), F.col("n").alias("sn"), F.col("pos").alias("sp"), F.col("root").alias("sr"))
    met = stray.join(large.select("branch", "doc_id", "n", "pos", "root"), "branch").where(f"sr <> root and {NUM} * greatest(n, sn) <= {DEN} * least(n, sn) and {NUM + DEN} * least(n - pos, sn - sp) >= {NUM} * (n + sn)")
    rest = rest.unionAll(met.select(F.least("s", "doc_id").alias("a"), F.greatest("s", "doc_id").alias("b"))).distinct()
    rest = materialise(screened(rest).select("a", "b").join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "ngram-rest")
    if rest.take(1):
        roots = merged(roots, rest, sets_of(rest))
    # Sets that a large share of the rows have are few, and met by broadcast; the others don't gather in one task.
    bar = -(-total // HOT_SETS)
    hot = F.broadcast(nodes.where(F.col("copies") > bar).withColumn("_hot", F.lit(True)))
    met = rows.join(hot, "digest", "left")
    rest = met.where("_hot is null").select(*rows.columns).join(nodes.where(F.col("copies") <= bar), "digest", "left")
    return met.where("_hot").select(*rows.columns, "node").unionByName(rest.select(*rows.columns, "node")), roots


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    rows, roots = join(docs)
    found = rows.join(roots, "node", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("root", "node"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.cast("bigint").alias("component_id"))


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of linked documents the one with the smallest doc_id."""
    gone = report(docs).where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return without(docs, materialise(gone, "ngram-dropped"))

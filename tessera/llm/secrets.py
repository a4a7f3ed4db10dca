"""Secret scans: fixed patterns plus sliding-window Shannon entropy, all as Spark SQL expressions.

Nothing leaves the JVM. Places of matches come from the lengths of the segments between them, added up by a
blockwise running total; the entropy of a window slides along a candidate with a count per character,
packed five bits each into a few longs, that one character in and one out update. Work grows in
proportion to the text, however long it is and however many matches it has.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned alike; ``redact``
keeps extra columns whatever their names; ``scan`` refuses a table that has a column named as its own;
an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

# Fixed values of the contract: the three base kinds in the order that breaks ties.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6

# Entropy scan. A candidate is a run of token characters; a window of WINDOW characters slides on it.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Character classes a candidate can belong to, narrowest first, with the least entropy in bits of a window.
CLASSES = (
    ("digit", "0123456789", None),  # numbers alone are no secret
    ("hex", "0123456789abcdef", 2.9),
    ("alnum", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 3.6),
    ("base64", "+/-=0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz", 3.75),
)
#: Candidates that match are suppressed: placeholders, alphabets in order, UUIDs, words without digits.
ALLOW = (
    r"(?i)example|placeholder|changeme|redacted|dummy|sample|test_?key",
    r"(?i)abcdefghij|0123456789|1234567890|qwertyuiop",
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[^0-9]*$",
    r"^[A-Za-z]+[-_/=+]+[0-9]{1,4}$",
    r"^(?:[a-z]++[-/_])++[a-z0-9]*$",
)
SPANS = "_spans"

FAN = 256  # elements of a block of a running total
CUTS = 64  # spans that are cut out of one piece of text
PIECE = 4096  # windows of a long candidate that are walked together
BITS, SLOTS = 5, 12  # a count takes BITS bits, a long holds SLOTS counts
WORDS = 6  # longs for the largest class
ONE = 1 << 32  # entropies are summed as integers in units of 1 / ONE, so that sums don't depend on their order


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _part(xs: Column, first: Column, size: int) -> Column:
    """At most ``size`` elements of an array from ``first``, in time that doesn't depend on the array's length."""
    return F.transform(F.sequence(first, F.least(first + size, F.size(xs)) - 1), lambda i: F.get(xs, i))


def _run(xs: Column, add) -> Column:
    """Running totals of an array by appending, for short arrays."""
    zero = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("out"))

    def step(acc, x):
        now = F.coalesce(add(acc["last"], x), x)
        return F.struct(now.alias("last"), F.array_append(acc["out"], now).alias("out"))

    return F.aggregate(xs, zero, step)["out"]


def running(xs: Column, add) -> Column:
    """Running totals of a long array that isn't empty: by appending inside blocks of FAN, and over the blocks' ends."""

    def joined(parts, before):
        # parts: running totals by block; before: running totals of the blocks' last elements.
        each = lambda part, b: F.transform(part, lambda x: F.coalesce(add(F.get(before, b - 1), x), x))
        return F.flatten(F.transform(parts, each))

    parts = lambda y: F.transform(F.sequence(F.lit(0), F.floor((F.size(y) - 1) / FAN).cast("int")), lambda b: _run(_part(y, b * FAN, FAN), add))
    return _let(_let(xs, parts), lambda low: _let(_run(F.transform(low, lambda p: F.element_at(p, -1)), add), lambda before: joined(low, before)))


def _placed(kinds: Column) -> Column:
    """Structs (start, end, kind, value) of the matches of structs (kind, hits, gaps): what matched, and the lengths between."""

    def one(p):
        sizes = F.transform(p["hits"], lambda h, i: F.get(p["gaps"], i) + F.char_length(h))
        span = lambda ends: lambda h, i: F.struct((F.get(ends, i) - F.char_length(h)).alias("start"), F.get(ends, i).alias("end"), p["kind"].alias("kind"), h.alias("value"))
        return _let(running(sizes, lambda a, b: a + b), lambda ends: F.transform(p["hits"], span(ends)))

    return F.flatten(F.transform(kinds, one))


def _fits(span: Column) -> Column:
    """Whether a match counts: an assignment whose value has six characters, a candidate that is suspicious, any other."""
    value = F.char_length(F.regexp_extract(span["value"], f"^{ASSIGN}$", 1)) >= ASSIGN_VALUE
    return F.when(span["kind"] == 0, value).when(span["kind"] == 3, _suspicious(span["value"])).otherwise(F.lit(True))


def found_spans(text: Column) -> Column:
    """All spans of a text that isn't null: leftmost non-overlapping matches of each kind in turn, those that count."""
    kinds = [
        F.when(
            text.rlike(pattern),
            F.struct(
                F.lit(k).alias("kind"),
                F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
                F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g).cast("bigint")).alias("gaps"),
            ),
        )
        for k, pattern in enumerate((ASSIGN, ACCESS, HEX, CANDIDATE))
    ]
    return F.filter(_placed(F.filter(F.array(*kinds), lambda k: k.isNotNull())), _fits)


def _weight(n: int) -> int:
    return round(n * math.log2(n) * ONE) if n > 0 else 0


def _longs(values) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def _least(codes: Column) -> Column:
    """Least sum of c * log2(c), in units of 1 / ONE, over the windows of an array of letter numbers; null without a window."""
    up = _longs([_weight(c + 1) - _weight(c) for c in range(WINDOW + 1)])
    down = _longs([0, *(_weight(c - 1) - _weight(c) for c in range(1, WINDOW + 2))])
    shift = lambda x, n: F.call_function("shiftright", x, n)
    one = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n)
    place = lambda c: (F.floor(c / SLOTS).cast("int"), (c % SLOTS * BITS).cast("int"))

    def pair(c, i):
        gone = F.when(i >= WINDOW, F.get(codes, i - WINDOW))
        (w, b), (v, a) = place(c), place(gone)
        return F.struct((gone.isNotNull() & (gone == c)).alias("same"), w.alias("w"), b.alias("b"), v.alias("v"), a.alias("a"), i.alias("i"))

    zero = F.struct(F.array_repeat(F.lit(0).cast("bigint"), WORDS).alias("n"), F.lit(0).cast("bigint").alias("s"), F.lit(None).cast("bigint").alias("least"))

    def step(acc, x):
        held = lambda word, bit: shift(F.get(acc["n"], word), bit).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
        n = F.transform(
            acc["n"],
            lambda word, j: word + F.when(j == x["w"], one(x["b"])).otherwise(F.lit(0)) - F.when(j == x["v"], one(x["a"])).otherwise(F.lit(0)),
        )
        s = acc["s"] + F.get(up, held(x["w"], x["b"])) + F.when(x["v"].isNotNull(), F.get(down, held(x["v"], x["a"]))).otherwise(F.lit(0))
        moved = F.struct(F.when(x["same"], acc["n"]).otherwise(n).alias("n"), F.when(x["same"], acc["s"]).otherwise(s).alias("s"))
        return _let(moved, lambda m: F.struct(m["n"].alias("n"), m["s"].alias("s"), F.when(x["i"] >= WINDOW - 1, F.least(acc["least"], m["s"])).otherwise(acc["least"]).alias("least")))

    return F.aggregate(F.transform(codes, pair), zero, step)["least"]


def _least_sum(value: Column, alphabet: Column) -> Column:
    """Least sum of c * log2(c), in units of 1 / ONE, over all windows of ``value``; null if it is shorter than a window.

    One pass with incremental counts: when a character enters with count c, the sum grows by f(c+1) - f(c); when one
    leaves it shrinks likewise. Long values are walked in pieces of PIECE windows that overlap, so that what is
    held at once stays small.
    """
    pieces = F.regexp_extract_all(value, F.lit(f"(?=(.{{1,{PIECE + WINDOW - 1}}})).{{1,{PIECE}}}"), F.lit(1))
    codes = lambda p: F.transform(F.filter(F.split(p, "", -1), lambda c: c != ""), lambda c: F.instr(alphabet, c) - 1)
    return F.array_min(F.transform(pieces, lambda p: _let(codes(p), _least)))


def peak_entropy(value: Column, alphabet: str) -> Column:
    """Largest Shannon entropy, in bits, of any window of WINDOW characters of ``value``; 0 if it is shorter."""
    return F.coalesce(F.lit(math.log2(WINDOW)) - _least_sum(value, F.lit(alphabet)) / F.lit(float(ONE * WINDOW)), F.lit(0.0))


def most_sum(bar: float | None) -> int:
    """The largest sum of a window whose entropy is ``bar`` or more; no bar is one that no window reaches."""
    return -1 if bar is None else math.floor((math.log2(WINDOW) - bar) * WINDOW * ONE)


def _suspicious(value: Column) -> Column:
    """Whether no allow rule suppresses a candidate and its entropy reaches the bar of its character class."""
    kind, ok = None, F.lit(True)
    for rule in ALLOW:
        ok = ok & ~value.rlike(rule)
    for _, alphabet, bar in CLASSES:
        inside = value.rlike(f"^[{alphabet.replace('-', '')}{'-' if '-' in alphabet else ''}]*$")
        this = F.struct(F.lit(alphabet).alias("letters"), F.lit(most_sum(bar)).cast("bigint").alias("most"))
        kind = F.when(inside, this) if kind is None else kind.when(inside, this)
    return F.when(ok, _let(kind, lambda k: F.when(k["most"] >= 0, _least_sum(value, k["letters"]) <= k["most"]).otherwise(F.lit(False)))).otherwise(F.lit(False))


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))),
            lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``_spans``: an array of (start, end, kind, value), the kind as its place in KINDS."""
    if SPANS in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {SPANS} already")
    return docs.withColumn(SPANS, found_spans(F.coalesce(F.col(text), F.lit(""))))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts by base kind, the digest of the base spans, all spans."""
    found = scan(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter(SPANS, lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.filter(SPANS, lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _joined(F.col(SPANS)).alias("spans"),
    )


def _masked(text: Column, rows: Column, mask: str) -> Column:
    """``text`` with ``mask`` for each stretch of ``rows``, structs (b, s, e) in order: what stands from b to s stays.

    Texts are cut from blocks of rows, and these from blocks of blocks, so no cut searches from the start of a long text.
    """
    whole = lambda a: F.greatest(a, F.lit(0).cast("bigint"))
    cut = lambda t, base, a, b: F.substring(t, (whole(a) - base + 1).cast("int"), F.greatest(b - whole(a), F.lit(0).cast("bigint")).cast("int"))

    def pieces(t, base, some, depth):
        """The masked text from the first to the last of some rows; ``t`` begins at ``base``."""
        if depth == 0:
            return F.array_join(F.transform(some, lambda r: F.when(r["s"] > r["b"], F.concat(cut(t, base, r["b"], r["s"]), F.lit(mask))).otherwise(F.lit(""))), "")
        size = CUTS**depth

        def block(k):
            first, last = F.get(some, k * size), F.get(some, F.least((k + 1) * size, F.size(some)) - 1)
            inside = F.struct(whole(first["b"]).alias("from"), cut(t, base, first["b"], last["e"]).alias("t"), _part(some, k * size, size).alias("rows"))
            return _let(inside, lambda p: pieces(p["t"], p["from"], p["rows"], depth - 1))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(some) - 1) / size).cast("int")), block), "")

    tail = F.substring(text, (F.element_at(rows, -1)["e"] + 1).cast("int"), F.char_length(text))
    return F.concat(pieces(text, F.lit(0).cast("bigint"), rows, 2), tail)


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with the union of the found spans of ``text`` replaced; spans that touch share one mask. n_chars follows; null stays null."""
    text, (order, ends, rows, new) = F.col("text"), unused(docs, "order", "ends", "rows", "new")
    body = F.coalesce(text, F.lit(""))
    spans = F.transform(found_spans(body), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    found = docs.withColumn(order, F.array_sort(spans))
    # With the spans in order: the furthest end up to each one; b, the furthest end before it, is -1 for the first.
    found = found.withColumn(ends, F.when(F.size(order) > 0, running(F.transform(order, lambda s: s["end"]), lambda a, b: F.greatest(a, b))))
    before = lambda i: F.when(i == 0, F.lit(-1).cast("bigint")).otherwise(F.get(F.col(ends), i - 1))
    found = found.withColumn(rows, F.transform(order, lambda s, i: F.struct(before(i).alias("b"), s["start"].alias("s"), F.get(F.col(ends), i).alias("e"))))
    found = found.withColumn(new, F.when(F.size(rows) > 0, _masked(body, F.col(rows), mask)).otherwise(text))
    columns = {"text": F.col(new).alias("text"), "n_chars": F.coalesce(F.char_length(new), F.col("n_chars")).cast("bigint").alias("n_chars")}
    return found.select(*[columns.get(c, F.col(c)) for c in docs.columns])

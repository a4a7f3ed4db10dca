"""Offset-preserving chunking and passage expansion.

The next chunk's start depends on where the one before ended, so chunk offsets are computed by an Arrow
UDF over whole batches; a chunk's text stays a substring of its document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<ordinal:int,start:int,end:int>>"


@dataclass(frozen=True)
class ChunkSpec:
    target: int = 1800
    overlap: int = 300
    least: int = 200
    snap: int = 250


def _break_near(text: str, at: int, window: int) -> int:
    """Where to end a chunk planned to end at ``at``: after the next newline within ``window``, else after the
    last one before, else at the next sentence's first character, else where planned."""
    ahead = text.find("\n", at, at + window)
    if ahead >= 0:
        return ahead + 1
    behind = text.rfind("\n", max(0, at - window), at)
    if behind >= 0:
        return behind + 1
    for i in range(at, min(len(text), at + window)):
        if text[i].isspace() and i > at and text[i - 1] in ".!?":
            return i + 1
    return at


def chunk_offsets(text: str | None, spec: ChunkSpec = ChunkSpec()) -> list[tuple[int, int, int]]:
    """(ordinal, start, end) of overlapping passages; each next one starts ``overlap`` before the last end.

    A text under ``least`` characters has none; a blank passage takes no ordinal.
    """
    n = len(text or "")
    out: list[tuple[int, int, int]] = []
    start = 0
    while n >= spec.least and start < n:
        plan = start + spec.target
        end = n if plan >= n else min(n, max(_break_near(text, plan, spec.snap), start + spec.least))
        if not text[start:end].isspace():
            out.append((len(out), start, end))
        if end == n:
            break
        start = end - spec.overlap if end - spec.overlap > start else end
    return out


def chunks(text: Column, spec: ChunkSpec = ChunkSpec()) -> Column:
    """Chunk spans of a text column."""

    @F.pandas_udf(SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: [{"ordinal": o, "start": s, "end": e} for o, s, e in chunk_offsets(t, spec)])

    return run(text)


def expanded(text: Column, start: Column, end: Column, before: int = 600, after: int = 900, snap: int = 400, back: int = 300) -> Column:
    """(start, end) of a passage around a hit, in the JVM.

    Widened by ``before`` and ``after``. The start moves past the first newline within ``snap``, the end back to
    the last newline within ``snap``; then, unless it is at a sentence end, back to the last one within ``back``. The hit
    itself is never cut.
    """
    size = F.char_length(text)
    low, high = F.greatest(start - before, F.lit(0)), F.least(end + after, size)
    piece = lambda a, b: F.substring(text, a + 1, b - a)
    first = F.instr(piece(low, F.least(low + snap, start)), "\n")
    low = F.when((low > 0) & (first > 0), low + first).otherwise(low)
    edge = F.greatest(end, high - snap)
    last = F.instr(F.reverse(piece(edge, high)), "\n")
    high = F.when((high < size) & (last > 0), high - last).otherwise(high)
    edge = F.greatest(end, high - back)
    tail = piece(edge, high)
    done = F.regexp_extract(tail, r'(?s)^.*[.!?]"?', 0)
    ends = piece(high - 1, high).rlike("[.!?]")
    high = F.when((high > 0) & ~ends & (F.char_length(done) > 0), edge + F.char_length(done)).otherwise(high)
    return F.struct(low.cast("int").alias("start"), high.cast("int").alias("end"))


def token_chunks(tokens: list[list[int]], window: int = 4096, overlap: int = 128, least: int = 256) -> list[list[int]]:
    """Paragraphs' tokens gathered into windows; what is carried over is the last ``overlap`` tokens.

    A long paragraph is cut by strides. Pieces under ``least`` are dropped at an overflow and at the end.
    """
    out: list[list[int]] = []
    held: list[int] = []
    for para in tokens:
        if len(para) > window:
            if held:
                out.append(held)
            step = window - overlap
            out += [para[i : i + window] for i in range(0, len(para), step) if len(para[i : i + window]) >= least]
            held = []
        elif len(held) + len(para) > window:
            if len(held) >= least:
                out.append(held)
            held = held[-overlap:] + para
        else:
            held = held + para
    if len(held) >= least:
        out.append(held)
    return out


def extract_json(text: str | None) -> str | None:
    """The first fenced JSON block, or the first balanced object; strings and escapes are respected."""
    if not text:
        return None
    fence = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", text, re.S)
    if fence:
        return fence[1]
    at = text.find("{")
    while at >= 0:
        depth, inside, escaped = 0, False, False
        for i in range(at, len(text)):
            c = text[i]
            if inside:
                inside = escaped or c != '"'
                escaped = c == "\\" and not escaped
            elif c == '"':
                inside = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if depth == 0:
                    return text[at : i + 1]
        at = text.find("{", at + 1)
    return None


def json_block(text: Column) -> Column:
    """The first JSON object of a text column, as text."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(extract_json)

    return run(text)


def packed_chunks(tokens: Column, window: int = 4096, overlap: int = 128, least: int = 256) -> Column:
    """Token windows of a column of paragraphs' tokens (array of arrays)."""

    @F.pandas_udf("array<array<int>>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda paragraphs: token_chunks([[int(t) for t in p] for p in paragraphs], window, overlap, least))

    return run(tokens)

"""Best-fit packing of documents into fixed-length token sequences.

Tokenising: the vocabulary drops white space, so every white-space run is a boundary and a text's ids
are the ids of its chunks in order. Distinct chunks go to the tokenizer once per worker; texts are
expanded from that table with array operations.

Packing: bounded-space online best-fit. A task keeps at most OPEN_BINS open sequences in a bitset keyed
by free space; a piece goes to the open sequence with the least room that holds it; when all are open
and none fits, the fullest closes. Sequences still partly empty when a task ends are packed again, those
of GROUP tasks together, so the loss doesn't grow with the number of tasks.

Defined results: a null text counts as empty and still has its end token; repeated rows are packed one
by one; an empty table gives no rows; only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, give_back, materialise, modest_batches, small, texts, trim

SEQUENCE = 4096
END_ID = 1
OPEN_BINS = 512
GROUP = 32
#: Chunks a worker remembers; beyond it the table starts anew. Longer chunks aren't remembered.
CACHE = 150_000
LONGEST = 64
#: Chunks that the tokenizer encodes in one call, and texts worked on at once: its encodings take far more memory than their ids.
PORTION = 2000
TEXTS = 200
FULL_ENOUGH = 0.97

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


class ChunkTable(dict):
    """Chunk -> number; the ids of a chunk lie at begin[number] in one flat array.

    ``encode`` maps a list of chunks to (all ids one after another, ids of each chunk). Unknown chunks are
    numbered at once and encoded together by ``settle``.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int = CACHE):
        super().__init__()
        self.encode, self.limit = encode, limit
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.pending: list = []
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.used = self.count = 0

    def __missing__(self, chunk):
        number = self.count + len(self.pending)
        self[chunk] = number
        self.pending.append(chunk)
        return number

    def settle(self) -> None:
        """Encode what is pending."""
        if not self.pending:
            return
        ids, sizes = self.encode(self.pending)
        need, n = len(ids), len(sizes)
        while self.used + need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + n > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.flat[self.used : self.used + need] = ids
        self.begin[self.count : self.count + n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.count : self.count + n] = sizes
        self.used += need
        self.count += n
        self.pending = []

    def expand(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of chunks ``numbers``, one after another."""
        sizes = self.size[numbers]
        total = int(sizes.sum())
        shift = self.begin[numbers] - (np.cumsum(sizes) - sizes)
        return self.flat[np.repeat(shift, sizes) + np.arange(total)]

    def tidy(self) -> None:
        """Start anew if the table is over its bound. Numbers given out before are void then."""
        if self.count > self.limit:
            self._reset()


class _ChunkEncoder:
    """Encode many chunks in one call of the tokenizer where the ids themselves show where a word ends.

    A Latin-1 chunk of letters is one word of the vocabulary's pattern, with marks after it two; the last
    token of a word, and no other, carries the end-of-word suffix. Other chunks are encoded one by one.
    """

    LINE = 500
    MARKS = ".,!?;:%&$*#)]|"

    def __init__(self, tok):
        suffix = tok.model.end_of_word_suffix
        self.batch = getattr(tok, "encode_batch_fast", tok.encode_batch)
        self.last = np.zeros(max(tok.get_vocab().values()) + 1, bool)
        for token, i in tok.get_vocab().items():
            self.last[i] = bool(suffix) and token.endswith(suffix)

    def words(self, chunk: str) -> int:
        """Words of a chunk, 0 if it is not of the simple kind."""
        if len(chunk) > LONGEST or (not chunk.isascii() and max(chunk) > "\xff"):
            return 0
        if chunk.isalpha():
            return 1
        return 2 if chunk.rstrip(self.MARKS).isalpha() else 0

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [self._portion(chunks[i : i + PORTION]) for i in range(0, max(1, len(chunks)), PORTION)]
        return np.concatenate([ids for ids, _ in made]), np.concatenate([sizes for _, sizes in made])

    def _portion(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.fromiter(map(self.words, chunks), np.int64, len(chunks))
        easy, hard = np.flatnonzero(counts), np.flatnonzero(counts == 0)
        names = [chunks[i] for i in easy]
        lines = [" ".join(names[i : i + self.LINE]) for i in range(0, len(names), self.LINE)]
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in self.batch(lines, add_special_tokens=False))])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == counts.sum() and (not len(ends) or ends[-1] == len(ids)):
            upto = np.concatenate([[0], ends[np.cumsum(counts[easy]) - 1]]) if len(easy) else np.zeros(1, np.int64)
        else:  # the vocabulary isn't of this kind
            hard, easy, ids, upto = np.arange(len(chunks)), easy[:0], ids[:0], np.zeros(1, np.int64)
        sizes = np.zeros(len(chunks), np.int64)
        sizes[easy] = np.diff(upto)
        rest = [e.ids for e in self.batch([chunks[i] for i in hard], add_special_tokens=False)]
        sizes[hard] = [len(x) for x in rest]
        begin = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.uint32)
        flat[np.repeat(begin[easy] - upto[:-1], sizes[easy]) + np.arange(len(ids))] = ids
        for i, x in zip(hard, rest, strict=True):
            flat[begin[i] : begin[i] + len(x)] = x
        return flat, sizes


_tables: dict[str, ChunkTable] = {}


def _word_table(path: str) -> ChunkTable:
    if path not in _tables:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _tables[path] = ChunkTable(_ChunkEncoder(tok))
    return _tables[path]


def _chunks(text: str) -> list[str]:
    """Chunks between white space. U+001C to U+001F split in Python but not in the tokenizer, so such texts stay whole."""
    if not text.isprintable() and any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [text]
    return text.split()


def token_ids(batch: list[str], path: str) -> Iterator[np.ndarray]:
    """The ids of each text, as the tokenizers library gives them without special tokens."""
    table = _word_table(path)
    table.tidy()
    numbers = []
    for text in batch:
        words = _chunks(text)
        numbers.append(np.fromiter(map(table.__getitem__, words), np.int64, len(words)))
        if len(table.pending) > 50_000:
            table.settle()
    table.settle()
    give_back()
    for n in numbers:
        yield table.expand(n)
    for long in [c for c in table if len(c) > LONGEST] if table.used > 1 << 24 else []:
        del table[long]


class BestFit:
    """Bounded-space online best-fit bins of ``capacity``, at most ``open_bins`` open at once."""

    def __init__(self, capacity: int = SEQUENCE, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits = 0  # bit f is set while an open bin has f tokens of room
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece of ``length`` tokens."""
        fit = self.bits >> length
        if fit:
            room = length + (fit & -fit).bit_length() - 1
            number = self.at[room].pop()
            if not self.at[room]:
                self.bits ^= 1 << room
        else:
            if self.open == self.open_bins:  # the fullest closes
                room = (self.bits & -self.bits).bit_length() - 1
                self.at[room].pop()
                if not self.at[room]:
                    self.bits ^= 1 << room
                self.open -= 1
            room, number = self.capacity, self.made
            self.made += 1
            self.open += 1
        left = room - length
        if left:
            self.at[left].append(number)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return number, self.capacity - room

    def unfinished(self, share: float = FULL_ENOUGH) -> set[int]:
        """Open bins filled to less than ``share``."""
        return {n for room, names in enumerate(self.at) if room > self.capacity * (1 - share) for n in names}


def _first_pass(path: str):
    def run(batches):
        from pyspark import TaskContext

        claim("packing", _tables.clear)
        part = TaskContext.get().partitionId()
        bins = BestFit()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        last = []
        for batch in batches:
            rows = []
            for some in small([batch], TEXTS):
                for doc, ids in zip(some.column(0).to_pylist(), token_ids(texts(some.column(1)), path), strict=True):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), SEQUENCE)):
                        cut = ids[start : start + SEQUENCE]
                        number, offset = bins.put(len(cut))
                        rows.append((doc, piece, start, len(cut), zlib.crc32(cut.tobytes()), number, offset))
            for i in range(0, len(rows), 50_000):
                last.append(pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 50_000], strict=True), kinds, strict=True)], names))
            # A bin that is open now may be finished later; the batch is held back until the task ends, 60 bytes a piece.
        loose = np.array(sorted(bins.unfinished()), np.int64)
        for b in last:
            number = b.column(5).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array((np.int64(part) << 32) | number), b.column(6), pa.array(np.isin(number, loose)), pa.array(np.full(len(number), part // GROUP, np.int64))],
                [*names, "loose", "grp"],
            )
        last.clear()
        trim()

    return run


def _second_pass(pdf):
    """Best fit again over the pieces of partly filled sequences, longest first."""
    pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    bins = BestFit()
    placed = [bins.put(int(n)) for n in pdf["length"]]
    base = (1 << 60) + (int(pdf["grp"].iloc[0]) << 32) if len(pdf) else 0
    return pdf.assign(sequence_id=[base + n for n, _ in placed], offset=[o for _, o in placed]).drop(columns=["loose", "grp"])


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    first = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = materialise(modest_batches(first).mapInArrow(_first_pass(tokenizer_path), PIECES + ", loose boolean, grp bigint"), "packed")
    done = first.where(~F.col("loose")).drop("loose", "grp")
    again = first.where("loose").groupBy("grp").applyInPandas(_second_pass, PIECES)
    return done.unionByName(again)

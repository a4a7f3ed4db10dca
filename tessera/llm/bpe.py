"""Byte-level BPE by prefix-sharing trie traversal.

The last token of the encoding of a prefix is a function of that prefix: of the vocabulary's tokens that
end there, exactly one, t, may follow the last token of the prefix before it, because merging would leave
the pair as it is. Distinct words, in sorted order, are a depth-first walk of their trie: the
states on the stack up to the depth shared with the word before stay, so shared prefixes are done once.

Defined results: a null text counts as empty, with no ids; repeated rows are encoded alike; empty tables
give no rows; only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, texts
from .packing import ChunkTable

# Fixed value: the vocabulary's split pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_split = regex.compile(PATTERN).findall
#: Words of these characters alone split alike in every Unicode version; others go to the library's own splitter.
_plain = regex.compile(r"[\t-\r\x20-\x7e\xa1-ʯͰ-ͳΆ-ϿЀ-ҁ‐-‧一-龥]*").fullmatch
_odd_space = regex.compile(r"^\s|\s$|\s\s").search
CACHE = 500_000


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes are themselves, the others follow U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TrieBpe:
    """Encoder and decoder for one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        letters = _byte_alphabet()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.bytes_of = {i: as_bytes(t) for t, i in spec["model"]["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.longest = max(map(len, self.id_of))
        #: Age of a token: bytes are oldest, then merges in order. (left, right) -> age of what they merge to.
        self.age, self.parts, self.joined = {}, {}, {}
        for b in range(256):
            t = self.id_of[bytes([b])]
            self.age[t], self.parts[t] = b, None
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (self.id_of[as_bytes(p)] for p in (pair if isinstance(pair, list) else pair.split(" ")))
            whole = self.id_of[self.bytes_of[left] + self.bytes_of[right]]
            self.joined[left, right] = 256 + rank
            if whole not in self.age:
                self.age[whole], self.parts[whole] = 256 + rank, (left, right)
        self.follows: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}  # words seen before, at most CACHE and one batch
        self.splitter = Tokenizer.from_file(path).pre_tokenizer

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens ends in exactly these two.

        Undo merges from the youngest down; if a merge across the border is older than the youngest merge
        still standing at either side, it would have come first and broken the pair.
        """
        key = (left, right)
        known = self.follows.get(key)
        if known is not None:
            return known
        age, parts, joined = self.age, self.parts, self.joined
        bar_left = bar_right = 1 << 60  # merges across count only below these ages
        a, b, ok = left, right, True
        while True:
            across = joined.get((a, b))
            # At equal ages the leftmost pair merges first: a's own merge is further left, b's further right.
            if across is not None and across < bar_left and across <= bar_right:
                ok = False
                break
            pa_, pb_ = parts[a], parts[b]
            if pa_ is None and pb_ is None:
                break
            if pb_ is None or (pa_ is not None and age[a] > age[b]):
                bar_left, bar_right, a = min(bar_left, age[a]), min(bar_right, age[a] - 1), pa_[1]
            else:
                bar_left, bar_right, b = min(bar_left, age[b] + 1), min(bar_right, age[b]), pb_[0]
        if len(self.follows) > 2_000_000:
            self.follows.clear()
        self.follows[key] = ok
        return ok

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Distinct words -> ids, by one depth-first walk of their trie."""
        found: dict[bytes, list[int]] = {}
        id_of, longest, follow, known = self.id_of.get, self.longest, self.may_follow, self.follows.get
        last = [-1]  # last[i]: the last token of the word's first i bytes
        size = [0]
        before = b""
        for word in sorted(words):
            shared, top = 0, min(len(before), len(word))
            while shared < top and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for n in range(min(end, longest), 0, -1):
                    t = id_of(word[end - n : end])
                    if t is None:
                        continue
                    p = last[end - n]
                    ok = True if p < 0 else known((p, t))
                    if ok is None:
                        ok = follow(p, t)
                    if ok:
                        last.append(t)
                        size.append(n)
                        break
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= size[at]
            found[word] = ids[::-1]
            before = word
        return found

    def split(self, text: str) -> list[str]:
        """The words of ``text`` in order; joined they are the text again."""
        if _plain(text):
            return _split(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, ids of each chunk); a chunk's words don't depend on what surrounds it."""
        split = list(map(self.split, chunks))
        words = list(chain.from_iterable(split))
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        fresh = {w for w in words if w not in known}
        known.update((w.decode(), ids) for w, ids in self.encode_words([w.encode() for w in fresh]).items())
        found = list(map(known.__getitem__, words))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        upto = np.concatenate([[0], np.cumsum(lengths)])
        last = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        return ids, np.diff(upto[np.concatenate([[0], last])])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_ready: dict[str, tuple[TrieBpe, ChunkTable]] = {}


def _tools(path: str) -> tuple[TrieBpe, ChunkTable]:
    if path not in _ready:
        bpe = TrieBpe(path)
        _ready[path] = bpe, ChunkTable(bpe.encode_chunks, CACHE)
    return _ready[path]


def _stretches(bpe: TrieBpe, text: str) -> list[str]:
    """Cut a text where a space stands between two characters that aren't white space: a word always starts there."""
    parts = text.split(" ")
    if "" in parts or _odd_space(text):
        return bpe.split(text)
    return [parts[0], *[" " + p for p in parts[1:]]]


def encode(batch: list[str], path: str) -> Iterator[np.ndarray]:
    """The ids of each text."""
    bpe, table = _tools(path)
    table.tidy()
    marks = list(bpe.special)
    pieces: list[list] = []
    for text in batch:
        runs: list = [text]
        for mark in marks:
            if mark in text:
                runs = [x for run in runs for part in ([run] if isinstance(run, int) else run.split(mark)) for x in (part, bpe.special[mark])][:-1]
        own = []
        for run in runs:
            if isinstance(run, int):
                own.append(run)
            elif run:
                words = _stretches(bpe, run)
                own.append(np.fromiter(map(table.__getitem__, words), np.int64, len(words)))
        pieces.append(own)
        if len(table.pending) > 100_000:
            table.settle()
    table.settle()
    for own in pieces:
        ids = [np.array([x], np.uint32) if isinstance(x, int) else table.expand(x) for x in own]
        yield ids[0] if len(ids) == 1 else np.concatenate([np.zeros(0, np.uint32), *ids])


def _report(path: str):
    def run(batches):
        claim("bpe", _ready.clear)
        bpe, _ = _tools(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                some = batch.slice(low, 2000)
                rows = []
                for ids in encode(texts(some.column(1)), path):
                    text = bpe.decode(ids.tolist())
                    rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
                n, a, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _report(tokenizer_path), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )

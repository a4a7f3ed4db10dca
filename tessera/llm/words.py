"""Words of texts as 64-bit hashes: one text at a time with a table per worker of the words seen before, or many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

LIMIT = 150_000


class WordHashes(dict):
    """UTF-8 word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


TABLE = WordHashes()
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(29)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return hashes[:0]
    out = hashes[:n].copy()
    for i in range(1, k):
        out = (out * _PRIME) ^ (hashes[i : n + i] + (out >> _FOLD))
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


LONG = 64  # bytes; longer words are hashed one by one
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first k bytes of eight


class Words:
    """The words of many texts, as bounds in one array of bytes.

    ``data``: the texts one after another; ``offset``: where each begins, and the end of the last. Word i is
    ``data[start[i] : end[i]]``, and text k has the words ``first[k]`` to ``first[k + 1]``.
    """

    def __init__(self, data: np.ndarray, offset: np.ndarray):
        self.data, self.offset = data, offset
        inside = np.ones(len(data) + 1, bool)
        inside[-1] = False
        inside[:-1] = (data != 32) & (data - np.uint8(9) > 4)
        # Two words may meet where one text ends and the next begins.
        before = np.concatenate([[False], inside[:-1]])
        before[offset] = False
        self.start = np.flatnonzero(inside & ~before)
        after = inside[1:].copy()
        after[offset[offset > 0] - 1] = False
        self.end = np.flatnonzero(inside[:-1] & ~after) + 1
        self.first = np.searchsorted(self.start, offset)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: eight bytes at a time, all words side by side."""
        eight = np.ndarray(len(self.data) + 1, "<u8", np.concatenate([self.data, np.zeros(8, np.uint8)]), strides=(1,))
        size = self.end - self.start
        h = mix(mix((eight[self.start] & _BYTES[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _PRIME)))
        live, done = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(live):
            left = size[live] - done
            h[live] = mix(mix(h[live] * _PRIME ^ (eight[self.start[live] + done] & _BYTES[np.minimum(left, 8)])))
            live, done = live[left > 8], done + 8
        for i in np.flatnonzero(size > LONG):
            h[i] = xxhash.xxh64_intdigest(self.data[self.start[i] : self.end[i]])
        return h


def portions(column: pa.Array, size: int):
    """(low, high, words) of consecutive rows of a string column that hold about ``size`` bytes, or one longer text; null counts as empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offset = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offset, offset[low] + size, "right")) - 1)
        yield low, high, Words(data[offset[low] : offset[high]], offset[low : high + 1] - offset[low])
        low = high

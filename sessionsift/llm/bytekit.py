"""Numpy over the UTF-8 bytes of a batch of texts: words, their hashes, per-document sums.

Every rule of these operators that names ASCII classes can be read from single bytes, because all bytes of
a non-ASCII character are 0x80 or above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Most text bytes that are worked on at once; numpy needs some 50 bytes for each of them.
SLICE_BYTES = 1_000_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of words made of ASCII letters and digits (lower-cased) and all non-ASCII characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    p = _powers.get(base)
    if p is None or len(p) < n:
        p = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        p[0] = 1
        _powers[base] = p = np.multiply.accumulate(p)
    return p[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most SLICE_BYTES of text (one row at least): the rows, their bytes, offsets."""
    col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
    if not len(col):
        return
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, side="right")) - 1)
        yield batch.slice(i, j - i), data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


class Words:
    """Words of a slice: runs of ``is_word`` bytes that don't cross documents.

    start, end: byte positions; doc: row of each word; first: for each row the index of its first word
    (one more entry at the end); hash: 64-bit hash of each word's bytes.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, is_word: np.ndarray):
        n = len(data)
        w = np.zeros(n + 1, dtype=bool)
        w[:n] = is_word[data]
        begins = w.copy()
        begins[1:] &= ~w[:-1]
        at = off[:-1]
        begins[at] = w[at]  # a new document begins a new word
        ends = np.zeros(n + 1, dtype=bool)
        ends[1:] = w[:-1] & (~w[1:] | begins[1:])
        self.start, self.end = np.flatnonzero(begins[:n]), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.data = data

    @property
    def hash(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        n = len(self.data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * _power(_BASE_INV, n)[self.start])


def word_hash(word: str) -> int:
    """The hash that ``Words.hash`` gives for this (lower-case) word."""
    h = sum((b + 1) * pow(_BASE, i, 2**64) for i, b in enumerate(word.encode())) % 2**64
    return int(mix(np.array([h], dtype=np.uint64))[0])


def char_count(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Code points of each row."""
    sums = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]

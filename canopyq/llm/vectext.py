"""Whole-column text primitives on Arrow buffers: words, word hashes, windows.

A word is a maximal run of bytes other than space and \\x09-\\x0D.  UTF-8
continuation bytes never fall in that range, so the split is exact on bytes.
Hashes are 64-bit and depend on nothing but the text, so every executor and
every retry computes the same value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds a worker's memory whatever the batch.
CHUNK_BYTES = 1 << 19

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
BASE2 = 0xD6E8FEB86659FD93 | 1


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finalizer (xor-shift and multiply) over an array."""
    h = h.copy()
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def inverse(base: int) -> int:
    """Inverse of an odd number modulo 2**64."""
    return pow(base, -1, 1 << 64)


def byte_table(seed: int, lower: bool) -> np.ndarray:
    """A mixed 64-bit value for each byte; A-Z count as a-z if lower."""
    t = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed))
    if lower:
        t[65:91] = t[97:123]
    return t


SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[32, *range(9, 14)]] = True


class Words:
    """Words of a column slice: byte spans, and the first word of each row."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        if texts.null_count:
            texts = texts.fill_null(b"")
        _, offsets, data = texts.buffers()
        n = len(texts)
        off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        lo, hi = int(off[0]), int(off[-1])
        self.buf = np.frombuffer(data, dtype=np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
        self.offsets = off - lo
        size = len(self.buf)
        word = ~SEPARATOR[self.buf]
        edge = np.zeros(size + 1, dtype=bool)
        edge[self.offsets] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | edge[1:size]
        ends = word
        ends[:-1] &= SEPARATOR[self.buf[1:]] | edge[1:size]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        #: rows + 1 positions into starts and ends
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.rows = n

    def hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        """A hash for each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        ends = np.cumsum(lens)
        at = np.arange(ends[-1]) - np.repeat(ends - lens, lens)
        data = byte_table(seed, lower)[self.buf[at + np.repeat(self.starts, lens)]]
        data *= powers(BASE, int(lens.max()))[at]
        return mix(np.add.reduceat(data, ends - lens) + lens.astype(np.uint64))

    def marks(self) -> np.ndarray:
        """32 bits that tell apart rows of one id with different bytes."""
        total = np.append(np.uint64(0), np.cumsum(byte_table(7, False)[self.buf]))
        return (mix(total[self.offsets[1:]] - total[self.offsets[:-1]] + np.diff(self.offsets).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def place(self) -> np.ndarray:
        """Each word's number in its row, from 0."""
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.counts)


def windows(hashes: np.ndarray, at: np.ndarray, size: int, base: int = BASE) -> np.ndarray:
    """Hash of the window of size words that starts at each position in at."""
    n = len(hashes)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(base, n), out=sums[1:])
    return mix((sums[at + size] - sums[at]) * powers(inverse(base), n + 1)[at])


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most limit bytes of text, or one row."""
    col = batch.column(batch.schema.get_field_index(column))
    if not len(col):
        return
    wide = col.cast(pa.large_binary())
    off = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j

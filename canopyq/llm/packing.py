"""Packing tokenised documents into fixed windows by best-fit decreasing.

Each document's ids get an end id.  A document longer than a window is first
cut into full windows, which are sealed at once; the remainders wait in a pool
of bounded size.  The pool is packed longest first: a segment tree over
remaining capacities finds the tightest open window that takes a piece.  When
the pool is done, windows that are still open are topped up by cutting the
emptiest ones' pieces, so at most one window a pool flush stays partly filled,
and that one is open again in the next pool.  A partition's last one is cut into
sequences of powers of two, which need no padding, so padding stays small
however finely a table is partitioned.

Everything happens where the documents are read: no shuffle, memory bounded by
the pool.  Ids come from the byte-level BPE vocabulary file; a rank encoder
over the same vocabulary does the bulk, if it agrees on a fixed text that has
characters of all kinds.

Defined results: a null text counts as empty (one end id).  Rows that repeat a
doc_id are packed each for itself.  An empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .dealing import release, small_batches
from .vectext import chunks

PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def probe_text() -> str:
    """A fixed text with characters of all kinds, alone and in runs, and blanks of all lengths."""
    marks = "'s 't 're 've 'm 'll 'd 'S don't I'll ... !!! -- #@ \t\t\n\n \r\n  x   y    z\u00a0\u2003 \u3000 "
    wide = [chr(c) for c in range(0x20, 0x2FFFF, 61) if not 0xD800 <= c < 0xE000]
    runs = [f"{chr(c)}{chr(c + 1)}a{i}{chr(c) * 3}" + " " * (i % 5) for i, c in enumerate(range(0x21, 0x1F900, 307)) if not 0xD700 <= c < 0xE000]
    return marks + "".join(wide) + marks + " ".join(wide[:999]) + "".join(runs) + "0123456789 " * 9 + "naïve Straße Ærøskøbing Ελλάδα Россия 中文字 한국어 हिन्दी العربية"


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file.

    The rank encoder is used if the file asks for nothing but byte-level BPE with
    merges in the order of their ids, and both give the same ids of probe_text().
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        added = {x["content"] for x in spec.get("added_tokens", [])}
        self.special = [x for x in added if x]
        vocab, model = spec["model"]["vocab"], spec["model"]
        ranks = {bytes(symbols[c] for c in t): i for t, i in vocab.items() if t not in added}
        #: Fixed value: the pre-tokenisation pattern of this byte-level format.
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
        plain = model["type"] == "BPE" and not model.get("dropout") and not spec.get("normalizer") and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and merged == sorted(merged)
        self.fast = None
        if plain:
            fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            probe = probe_text()
            if fast.encode_ordinary(probe) == self.full.encode(probe, add_special_tokens=False).ids:
                self.fast = fast

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)


class CapacityTree:
    """Max segment tree over remaining capacities 0..size: which ones an open window has."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.has = [False] * (2 * self.leaves)

    def put(self, cap: int, there: bool) -> None:
        i = cap + self.leaves
        self.has[i] = there
        while i > 1:
            i >>= 1
            now = self.has[2 * i] or self.has[2 * i + 1]
            if self.has[i] == now:
                break
            self.has[i] = now

    def tightest(self, need: int) -> int:
        """Smallest capacity that is there and at least need, or -1."""
        i = need + self.leaves
        if self.has[i]:
            return need
        while i > 1:
            if not i & 1 and self.has[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.has[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit(lengths: list[int], size: int, opened: list[int]) -> list[int]:
    """The window of each piece, pieces longest first; opened: windows' free room, added to as needed."""
    tree = CapacityTree(size)
    by_cap: list[list[int]] = [[] for _ in range(size + 1)]
    for w, cap in enumerate(opened):
        if cap:
            by_cap[cap].append(w)
            tree.put(cap, True)
    place = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        cap = tree.tightest(need)
        if cap < 0:
            w, cap = len(opened), size
            opened.append(size)
        else:
            w = by_cap[cap].pop()
            if not by_cap[cap]:
                tree.put(cap, False)
        place[i] = w
        left = opened[w] = cap - need
        if left:
            if not by_cap[left]:
                tree.put(left, True)
            by_cap[left].append(w)
    return place


def fill_up(windows: list[list[tuple]], size: int) -> list[list[tuple]]:
    """Full windows, and at most one that is not: the emptiest windows' pieces are cut into the others' gaps.

    A piece is (doc, start, ids, doc_tokens).
    """
    used = [sum(len(p[2]) for p in w) for w in windows]
    order = sorted(range(len(windows)), key=lambda i: (-used[i], i))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        to, source = order[lo], order[hi]
        room = size - used[to]
        if not room:
            lo += 1
            continue
        if not windows[source]:
            hi -= 1
            continue
        doc, start, ids, total = windows[source].pop()
        take = min(room, len(ids))
        windows[to].append((doc, start + len(ids) - take, ids[len(ids) - take :], total))
        if take < len(ids):
            windows[source].append((doc, start, ids[:-take], total))
        used[to] += take
        used[source] -= take
    return [windows[i] for i in order if windows[i]]


def power_cuts(window: list[tuple]) -> list[list[tuple]]:
    """A window's pieces as sequences whose lengths are falling powers of two."""
    out, pieces = [], list(window)
    left = sum(len(p[2]) for p in pieces)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out.append([])
        while room:
            doc, start, ids, total = pieces.pop(0)
            take = min(room, len(ids))
            out[-1].append((doc, start, ids[:take], total))
            if take < len(ids):
                pieces.insert(0, (doc, start + take, ids[take:], total))
            room -= take
    return out


def _packer(path: str, size: int, end_id: int, pool_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encoder, sequence = None, (task.partitionId() if task else 0) << 40
        rows: list[tuple] = []
        pool: list[tuple] = []
        rest: list[tuple] = []

        def seal(window: list[tuple]) -> None:
            nonlocal sequence
            at = 0
            for doc, start, ids, total in window:
                rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, sequence, at))
                at += len(ids)
            sequence += 1

        def pack(last: bool) -> None:
            nonlocal pool, rest
            windows = [rest] if rest else []
            opened = [size - sum(len(p[2]) for p in w) for w in windows]
            for piece, w in zip(pool, best_fit([len(p[2]) for p in pool], size, opened)):
                if w == len(windows) or w > len(windows):
                    windows += [[] for _ in range(w + 1 - len(windows))]
                windows[w].append(piece)
            windows, pool, rest = fill_up(windows, size), [], []
            for w in windows:
                if sum(len(p[2]) for p in w) == size:
                    seal(w)
                elif last:
                    for part in power_cuts(w):
                        seal(part)
                else:
                    rest = w

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECE_SCHEMA)], schema=PIECE_SCHEMA)
            rows.clear()
            return got

        for batch in batches:
            for part in chunks(batch):
                encoder = encoder or Encoder(path)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.append(encoder.encode(text or ""), np.uint32(end_id))
                    cut = len(ids) // size * size
                    for at in range(0, cut, size):
                        seal([(doc, at, ids[at : at + size], len(ids))])
                    if cut < len(ids):
                        pool.append((doc, cut, ids[cut:].copy(), len(ids)))
                    if len(pool) >= pool_size:
                        pack(False)
                    if len(rows) >= 1024:
                        yield out()
        if pool or rest:
            pack(True)
        if rows:
            yield out()
        encoder = None
        release()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0, pool_size: int = 4096) -> DataFrame:
    """Pack documents into sequences of at most size ids.

    docs: doc_id long, text string; tokenizer: path of a byte-level BPE file
    that every executor can read; end_id follows each document.  Returns one
    row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset.
    """
    small_batches(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_packer(tokenizer, size, end_id, pool_size), PIECE)


def crc32_column(column: str = "ids"):
    """Unsigned CRC-32 of a binary column, as long."""
    return F.crc32(F.col(column))


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF

"""Benchmark decontamination by SimHash windows and exact verification.

Every window of a document, at every word, has a 64-bit SimHash of its weighted
words, and so has every window of an item; fingerprints within RADIUS bits name a
document and an item.  Fingerprints are cut into RADIUS + 1 blocks, and such two
agree in one block at least, so the block tables find all of them.  Of all
item-sized windows of the document the one with the largest weighted
5-word-shingle Jaccard similarity to the item decides.

Two window sizes stand for an item: the largest of SIZES that fits into it, and
the length of a run of words that it shares with any window of similarity 0.75
(sure_run(), 8 words mostly).  Equal words have equal fingerprints, so the second
size misses nothing that the exact similarity would accept, however a copy was
changed or cut; the first finds copies by their whole.  Sums over a window are
built by doubling from those over half of it.

The benchmark is the small side: it is measured first, and taken to the
executors in slices of at most SLICE_BYTES of text (measured: some 60 MB of tables
in a worker, and 300 MB while they are built).  Documents are never shuffled; their words are taken in blocks, so
memory is bounded whatever a text's length beyond the text and its hashes.

Defined results: null or empty texts, on either side, match nothing.  Items
under five words are one shingle.  Repeated items are items of their own;
repeated document rows give repeated matches.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .dealing import groups, small_batches
from .substring_dedup import _ids
from .vectext import Words, chunks, windows

#: Window sizes by doubling: 8 to 8192 words; the sums of the largest fit 16 bits.
SIZES = tuple(8 << k for k in range(11))
RADIUS = 3
SLICE_BYTES = 8 << 20
#: Words whose bit sums are held at once.
WORDS = 1 << 14
OUT = "doc_id long, item_id long, similarity double, start_word long, n_words long"


def weights(w: Words) -> np.ndarray:
    """A word's weight: longer words tell more; 1 to 4."""
    return 1 + np.minimum(w.ends - w.starts, 12) // 4


def sure_run(h: np.ndarray, least: float) -> int:
    """Words in a row that an item (its word hashes) shares with any window of similarity least.

    Two shared runs of 7 words at most, or one in an item of 10 words or more,
    stay under 0.75 whatever the weights.  One shared shingle is all that is sure
    of a smaller least, or of an item that repeats itself.
    """
    n = len(h)
    if n > 5 and (least < 0.75 or len(np.unique(windows(h, np.arange(n - 2), 3))) < n - 2):
        return 5
    return n if n < 7 else 6 if n == 7 else 7 if n < 10 else 8


def sizes_for(h: np.ndarray, least: float) -> set[int]:
    """Window sizes at which an item is indexed."""
    return {sure_run(h, least), *[s for s in SIZES if s <= len(h)][-1:]} - {0}


def simhash(sums: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Fingerprints from weighted sums of set bits (rows of 64) and the weights' totals."""
    return np.packbits(sums > (total >> 1)[:, None], axis=1).view(np.uint64).ravel()


def window_prints(hashes: np.ndarray, weight: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(size, first word, fingerprints of the windows from there on) for all windows of each size."""
    if not sizes:
        return
    n = len(hashes)
    step = max(WORDS, *sizes)
    for lo in range(0, n, step):
        part = hashes[lo : lo + step + max(sizes) - 1]
        power = 1
        total = weight[lo : lo + len(part)].astype(np.uint16)
        sums = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1) * total.astype(np.uint8)[:, None]
        # size -> sums over the words that the binary digits of size so far stand for
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        while power <= max(sizes) and power <= len(part):
            for size in sizes:
                if size & power:
                    if size not in held:
                        held[size] = power, sums, total
                    else:
                        done, s, t = held[size]
                        k = len(part) - done - power + 1
                        held[size] = done + power, s[: max(k, 0)] + sums[done : done + max(k, 0)], t[: max(k, 0)] + total[done : done + max(k, 0)]
                    done, s, t = held[size]
                    if done == size and len(s):
                        yield size, lo, simhash(s[:step], t[:step].astype(s.dtype))
            k = len(sums) - power
            if k <= 0:
                break
            if sums.dtype == np.uint8 and 8 * power > 255:
                sums = sums.astype(np.uint16)
            sums, total = sums[:k] + sums[power:], total[:k] + total[power:]
            power *= 2


class Index:
    """Block tables over the items' fingerprints, for each window size."""

    def __init__(self, items: list[tuple[int, str]], least: float = 0.75):
        self.ids = [i for i, _ in items]
        w = Words(pa.array([t for _, t in items], pa.string()))
        h, weight = w.hashes(lower=True), weights(w)
        self.sizes = w.counts
        self.shingles, self.total = [], []
        wanted: dict[int, list[int]] = {}
        for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
            x, there = _shingles(h[a:b], weight[a:b])
            self.shingles.append(x)
            self.total.append(there)
            for size in sizes_for(h[a:b], least):
                wanted.setdefault(size, []).append(i)
        item, place = w.row_of_word(), w.place()
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {size: [] for size in wanted}
        member = {size: np.isin(np.arange(w.rows), own) for size, own in wanted.items()}
        for size, lo, prints in window_prints(h, weight, sorted(wanted)):
            at = slice(lo, lo + len(prints))
            own = member[size][item[at]] & (place[at] + size <= w.counts[item[at]])
            found[size].append((prints[own], item[at][own]))
        self.tables = {}
        for size, parts in found.items():
            prints, of = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((of, prints))
            order = order[groups(prints[order], of[order])[0]]
            prints, of = prints[order], of[order].astype(np.int32)
            blocks = []
            for b in range(RADIUS + 1):
                key = (prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)
                order = np.argsort(key, kind="stable").astype(np.int32)
                blocks.append((order, np.searchsorted(key[order], np.arange(65537, dtype=np.uint64))))
            self.tables[size] = (prints, of, blocks)

    def near(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in prints, entry of the size's table) of all fingerprints within RADIUS bits."""
        own, _, blocks = self.tables[size]
        found = []
        for b, (order, first) in enumerate(blocks):
            key = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            n = first[key + 1] - first[key]
            hit = np.flatnonzero(n)
            k = n[hit]
            at = np.repeat(hit, k)
            entry = order[np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[key[hit]], k)]
            close = np.bitwise_count(prints[at] ^ own[entry]) <= RADIUS
            found.append(np.stack([at[close], entry[close]]))
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        return both[0], both[1]


def _shingles(h: np.ndarray, weight: np.ndarray, size: int = 5) -> tuple[np.ndarray, int]:
    """Distinct shingles of some words, ascending, and the sum of their weights."""
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), 0
    size = min(size, n)
    x, first = np.unique(windows(h, np.arange(n - size + 1), size), return_index=True)
    sums = np.append(0, np.cumsum(weight))
    return x, int((sums[first + size] - sums[first]).sum())


def _places(h: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each shingle of a document, its weight, and where the same one was last before it (or -1)."""
    x = windows(h, np.arange(len(h) - size + 1), size)
    sums = np.append(0, np.cumsum(weight))
    order = np.argsort(x, kind="stable")
    same = x[order[1:]] == x[order[:-1]]
    before = np.full(len(x), -1)
    before[order[1:][same]] = order[:-1][same]
    return x, sums[size:] - sums[:-size], before


def best_window(x: np.ndarray, weight: np.ndarray, before: np.ndarray, mine: np.ndarray, total: int, length: int) -> tuple[float, int]:
    """Largest similarity of an item and a window of length shingles, and the first such window's start.

    Windows may reach over either end of the document.  A shingle counts once in
    a window: at its first place there, so for the starts after the place before.
    """
    none = np.iinfo(np.int64).min
    place = np.arange(len(x))
    low = np.maximum(place - length + 1, np.where(before < 0, none, before + 1)) + length - 1
    k = np.minimum(np.searchsorted(mine, x), len(mine) - 1)
    common = mine[k] == x
    n = len(x) + length
    there = np.cumsum(np.bincount(low, weight, n) - np.bincount(place + length, weight, n))
    common = np.cumsum(np.bincount(low[common], weight[common], n) - np.bincount(place[common] + length, weight[common], n))
    similarity = common / (total + there - common)
    i = int(similarity.argmax())
    return float(similarity[i]), i - length + 1


def _matches(items: list[tuple[int, str]], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, least)
        for batch in batches:
            for part in chunks(batch):
                rows = list(matches(part, index, least))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["doc_id", "item_id", "similarity", "start_word", "n_words"])

    return run


def matches(part: pa.RecordBatch, index: Index, least: float) -> Iterator[tuple]:
    """Best match of each document of a slice with each item that it holds."""
    w = Words(part.column(1))
    if not len(w.starts):
        return
    h, weight, place, row = w.hashes(lower=True), weights(w), w.place(), w.row_of_word()
    pairs: set[tuple[int, int]] = set()
    for size, lo, prints in window_prints(h, weight, sorted(index.tables)):
        own = np.flatnonzero(place[lo : lo + len(prints)] + size <= w.counts[row[lo : lo + len(prints)]])
        pos, entry = index.near(size, prints[own])
        if len(pos):
            pairs.update(zip(row[lo + own[pos]].tolist(), index.tables[size][1][entry].tolist()))
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    last, held = None, {}
    for r, item in sorted(pairs):
        if r != last:
            last, held = r, {}
        n, count = int(index.sizes[item]), int(w.counts[r])
        size = min(5, n)
        if count < size:
            continue
        if size not in held:
            held[size] = _places(h[w.first[r] : w.first[r + 1]], weight[w.first[r] : w.first[r + 1]], size)
        similarity, start = best_window(*held[size], index.shingles[item], index.total[item], n - size + 1)
        if similarity >= least:
            a = max(start, 0)
            best[r, item] = similarity, a, min(start + n, count) - a
    ids, ok = _ids(part)
    for (r, item), (similarity, a, n) in best.items():
        yield int(ids[r]) if ok[r] else None, index.ids[item], similarity, a, n


def slices(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items with text, in slices of about SLICE_BYTES at most."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    size = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    k = max(1, math.ceil(size / SLICE_BYTES))
    for i in range(k):
        part = items if k == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(k)) == i)
        yield [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.75) -> DataFrame:
    """doc_id, item_id, similarity, start_word and n_words of every item that a document holds."""
    small_batches(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in slices(benchmark):
        part = docs.mapInArrow(_matches(items, least), OUT)
        out = part if out is None else out.unionByName(part)
    return out


def _clean(items: list[tuple[int, str]], least: float, names: list[str]):
    at = [names.index("doc_id"), names.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, least)
        for batch in batches:
            for part in chunks(batch):
                # row numbers stand in for ids, which may repeat
                numbered = pa.RecordBatch.from_arrays([pa.array(range(part.num_rows), pa.int64()), part.column(at[1])], names=["doc_id", "text"])
                bad = {m[0] for m in matches(numbered, index, least)}
                yield part.filter(pa.array([i not in bad for i in range(part.num_rows)]))

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.75) -> DataFrame:
    """The rows of docs that hold no benchmark item, with their columns."""
    for items in slices(benchmark):
        docs = docs.mapInArrow(_clean(items, least, docs.columns), docs.schema)
    return docs

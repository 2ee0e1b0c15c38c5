"""Substring deduplication with difference-cover anchors.

Two texts that share at least ``window`` words share, whatever their
alignment, an anchor: a short word window whose position modulo a period lies
in a difference cover in both texts.  So only windows at cover positions are
hashed and matched (about a fifth of all positions); every shared anchor then
extends to the full windows around it, which are matched by a 96-bit hash.

Stages: anchors -> shared anchors -> full windows that hold one -> the
smallest doc_id of each window -> covered words.  Every match is decided by
hash groups in a bucket (sorting, no pairs), and the answers return to the
documents' buckets as blocks; a document's text moves once.  A passage that very
many documents share is settled where it is found, as far as that goes: of a
flush's equal anchors two documents' travel, of a bucket's equal windows the
smallest document's, and the others' answers go straight back.

Defined results: a null or empty text has no words and none are removed.  Rows
with a null doc_id keep all words and take no part.  Rows that repeat a doc_id
are the same document, whatever their texts: they never cover each other.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .dealing import BLOCK, Outbox, aside, bucket_of, buckets_of, by_bucket, deal, groups, opened, parts, repeated, small_batches
from .vectext import BASE2, Words, chunks, windows

#: Period and perfect difference cover modulo it: every residue is a difference of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)

#: mark: tells apart rows of one doc_id with different texts.
ANCHOR = [("h", "<u8"), ("doc", "<i8"), ("mark", "<u4"), ("pos", "<i4")]
SPOT = [("doc", "<i8"), ("mark", "<u4"), ("pos", "<i4")]
WINDOW = [("h", "<u8"), ("g", "<u4"), ("doc", "<i8"), ("mark", "<u4"), ("pos", "<i4")]
OUT = "doc_id long, n_words long, n_removed long, kept binary"


def _ids(batch: pa.RecordBatch | pa.Table, name: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """An id column's values, and which are not null."""
    col = batch.column(name) if isinstance(batch, pa.Table) else batch.column(batch.schema.get_field_index(name))
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), col.is_valid().to_numpy(zero_copy_only=False)


def _anchors(window: int, buckets: int):
    short = window - PERIOD + 1
    in_cover = np.zeros(PERIOD, bool)
    in_cover[list(COVER)] = True

    def combine(keys: np.ndarray, cols: list[np.ndarray]) -> list[tuple]:
        h, doc, mark, pos = cols
        some = repeated(h)
        some = some[np.lexsort((doc[some], h[some]))]
        at, n = groups(h[some])
        known = np.repeat(doc[some][at] < doc[some][at + n - 1], n)  # two documents of this flush: shared, whatever others have
        ends = np.zeros(len(some), bool)
        ends[at] = ends[at + n - 1] = True
        travels = np.ones(len(h), bool)
        travels[some[known & ~ends]] = False
        some = some[known]
        return [(-1 - buckets_of(doc[some], buckets), [c[some] for c in (doc, mark, pos)]), (keys[travels], [c[travels] for c in cols])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Outbox(ANCHOR, buckets, combine=combine)
        for batch in batches:
            for part in chunks(batch):
                w = Words(part.column(1))
                ids, ok = _ids(part)
                place, row = w.place(), w.row_of_word()
                n = w.counts[row]
                at = np.flatnonzero(in_cover[place % PERIOD] & (place + short <= n) & (n >= window) & ok[row])
                h = windows(w.hashes(), at, short)
                yield from out.add((h % np.uint64(buckets)).astype(np.int32), h, ids[row[at]], w.marks()[row[at]], place[at])
        yield from out.flush()

    return run


def _shared_anchors(buckets: int):
    """Places of anchors that two documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, passed = Outbox(SPOT, buckets), []
        for x in by_bucket(aside(batches, passed), ANCHOR):
            yield from passed
            passed.clear()
            order = np.argsort(x["h"], kind="stable")
            h, doc, mark, pos = (x[k][order] for k in ("h", "doc", "mark", "pos"))
            at, n = groups(h)
            low, high = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)
            keep = np.repeat(low < high, n)
            yield from out.add(buckets_of(doc[keep], buckets), doc[keep], mark[keep], pos[keep])
        yield from passed
        yield from out.flush()

    return run


def _spots_by_row(w: Words, ids: np.ndarray, ok: np.ndarray, spots: dict[str, np.ndarray]) -> np.ndarray:
    """Word numbers (over all rows) of the places in spots; equal rows get the same."""
    order = np.argsort(spots["doc"], kind="stable")
    doc, mark, pos = spots["doc"][order], spots["mark"][order], spots["pos"][order]
    lo, hi = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
    n = np.where(ok, hi - lo, 0)
    row = np.repeat(np.arange(len(ids)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]
    return (w.first[row] + pos[k])[mark[k] == w.marks()[row]]


def _full_windows(window: int, buckets: int):
    """Windows that hold a shared anchor, of one bucket of documents."""
    short = window - PERIOD + 1

    def combine(keys: np.ndarray, cols: list[np.ndarray]) -> list[tuple]:
        h, g, doc, mark, pos = cols
        some = repeated(h)
        some = some[np.lexsort((doc[some], g[some], h[some]))]
        at, n = groups(h[some], g[some])
        later = some[doc[some] > np.repeat(doc[some][at], n)]
        travels = np.ones(len(h), bool)
        travels[later] = False
        return [(-1 - buckets_of(doc[later], buckets), [c[later] for c in (doc, mark, pos)]), (keys[travels], [c[travels] for c in cols])]

    def run(docs: pa.Table, blocks: pa.Table) -> pa.Table:
        spots = opened(list(blocks.column("payload").combine_chunks()) if blocks.num_rows else [], SPOT)
        out = Outbox(WINDOW, buckets, 1 << 40, combine)
        if len(spots["doc"]) and docs.num_rows:
            for batch in docs.combine_chunks().to_batches():
                for part in chunks(batch):
                    w = Words(part.column("text"))
                    ids, ok = _ids(part)
                    anchors = _spots_by_row(w, ids, ok, spots)
                    if not len(anchors):
                        continue
                    place, row = w.place(), w.row_of_word()
                    # a window that starts in [anchor - (window - short), anchor] holds the anchor
                    mark = np.zeros(len(place) + 1, np.int32)
                    np.add.at(mark, np.maximum(anchors - (window - short), w.first[row[anchors]]), 1)
                    np.add.at(mark, anchors + 1, -1)
                    at = np.flatnonzero((np.cumsum(mark[:-1]) > 0) & (place + window <= w.counts[row]))
                    if len(at):
                        words = w.hashes()
                        h, g = windows(words, at, window), windows(words, at, window, BASE2)
                        list(out.add((h % np.uint64(buckets)).astype(np.int32), h, g >> np.uint64(32), ids[row[at]], w.marks()[row[at]], place[at]))
        return pa.Table.from_batches(out.flush(), schema=_block_schema())

    return run


def _block_schema() -> pa.Schema:
    return pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])


def _covered(buckets: int):
    """Places of windows that a smaller document has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, passed = Outbox(SPOT, buckets), []
        for x in by_bucket(aside(batches, passed), WINDOW):
            yield from passed
            passed.clear()
            order = np.lexsort((x["g"], x["h"]))
            h, g, doc, mark, pos = (x[k][order] for k in ("h", "g", "doc", "mark", "pos"))
            at, n = groups(h, g)
            keep = doc > np.repeat(np.minimum.reduceat(doc, at), n)
            yield from out.add(buckets_of(doc[keep], buckets), doc[keep], mark[keep], pos[keep])
        yield from passed
        yield from out.flush()

    return run


def _kept(window: int):
    """The words left of each document of a bucket."""

    def run(docs: pa.Table, blocks: pa.Table) -> pa.Table:
        spots = opened(list(blocks.column("payload").combine_chunks()) if blocks.num_rows else [], SPOT)
        cols: list[list] = [[], [], [], []]
        for batch in docs.combine_chunks().to_batches():
            for part in chunks(batch):
                w = Words(part.column("text"))
                ids, ok = _ids(part)
                begins = _spots_by_row(w, ids, ok, spots)
                mark = np.zeros(len(w.starts) + window + 1, np.int32)
                np.add.at(mark, begins, 1)
                np.add.at(mark, begins + window, -1)
                gone = np.cumsum(mark[: len(w.starts)]) > 0
                lost = np.append(0, np.cumsum(gone))[w.first]
                # kept words and one separator after each, copied as bytes
                stay = np.flatnonzero(~gone)
                lens = w.ends[stay] - w.starts[stay] + 1
                ends = np.cumsum(lens)
                size = int(ends[-1]) if len(stay) else 0
                src = np.arange(size) - np.repeat(ends - lens, lens) + np.repeat(w.starts[stay], lens)
                text = np.append(w.buf, np.uint8(32))[src]
                text[ends - 1] = 32
                cut = np.append(0, ends)[np.searchsorted(stay, w.first)]
                raw = text.tobytes()
                cols[0] += [i if k else None for i, k in zip(ids.tolist(), ok.tolist())]
                cols[1] += w.counts.tolist()
                cols[2] += np.diff(lost).tolist()
                cols[3] += [raw[a : b - 1] if b > a else b"" for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def dedup_substrings(docs: DataFrame, window: int = 50) -> DataFrame:
    """Remove words in windows that also start in a document with a smaller doc_id.

    docs: doc_id long, text string.  Returns doc_id, n_words, n_removed, kept
    (kept words joined by one space) for each row.
    """
    if window < PERIOD + 1:
        raise ValueError(f"window must be over {PERIOD}")
    small_batches(docs)
    n = parts(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    home = docs.withColumn("bucket", bucket_of("doc_id", n)).repartition(n, "bucket")
    anchors = deal(docs.mapInArrow(_anchors(window, n), BLOCK), n)
    shared = anchors.mapInArrow(_shared_anchors(n), BLOCK).repartition(n, "bucket")
    full = home.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(_full_windows(window, n), BLOCK)
    covered = deal(full, n).mapInArrow(_covered(n), BLOCK).repartition(n, "bucket")
    return home.groupBy("bucket").cogroup(covered.groupBy("bucket")).applyInArrow(_kept(window), OUT)

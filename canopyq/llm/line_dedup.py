"""Line deduplication by two Bloom filters and exact confirmation.

Every eligible line key is reduced to a 128-bit hash.  A map task keeps one
entry for each distinct key of its own rows, and lets keys that it has itself
seen in two documents pass as suspects.  The entries are dealt by hash range;
a range streams through two Bloom filters, one for keys seen once and one for
keys seen twice.  Only the ranges' suspects (keys in the second filter) are
shuffled with their documents, counted exactly, and given the document that
keeps them.  A frequent key sends one entry per map flush, however many
documents hold it.  The filters stand by hash range, behind the first exchange: a
pair of filters for all keys would have to grow with them on every executor.

Defined results: a null or empty text is one empty line.  Rows that repeat a
doc_id are one document: they count once and keep or lose a key together.  Rows
with a null doc_id keep all lines and do not count.  Ties cannot arise: the
largest doc_id keeps a key.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..sources.shared import shared_checkpoint
from .dealing import BLOCK, Outbox, bucket_of, deal, groups, join_hot, opened, parts, release, small_batches
from .substring_dedup import _ids
from .vectext import chunks, mix

#: Characters stripped from a line's ends.
BLANKS = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}

#: An entry: key hash, a document that holds it, whether the map task saw two.
ENTRY = [("h", "<u8"), ("g", "<u8"), ("doc", "<i8"), ("many", "<u1")]
OUT = "doc_id long, n_lines long, n_dropped long, kept string"


def line_key(line: str) -> str:
    """A line without blanks at its ends, A-Z in lower case."""
    return line.strip(BLANKS).translate(LOWER) if not line.isascii() else _ascii_lower(line.strip(BLANKS))


def _ascii_lower(s: str) -> str:
    return s.lower()


def _hash(key: str) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"))
    return x >> 64, x & 0xFFFFFFFFFFFFFFFF


class Bloom:
    """A Bloom filter over pairs of 64-bit hashes."""

    def __init__(self, expected: int, error: float = 0.01):
        self.k = max(1, round(-math.log2(error)))
        self.bits = 1 << max(10, math.ceil(math.log2(max(expected, 1) * self.k / math.log(2))))
        self.words = np.zeros(self.bits >> 3, np.uint8)

    def _at(self, h: np.ndarray, g: np.ndarray) -> Iterator[np.ndarray]:
        step = mix(g) | np.uint64(1)
        at = mix(h ^ np.uint64(0x5BD1E995))
        for _ in range(self.k):
            yield (at & np.uint64(self.bits - 1)).astype(np.int64)
            at = at + step

    def add(self, h: np.ndarray, g: np.ndarray) -> None:
        for at in self._at(h, g):
            np.bitwise_or.at(self.words, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def has(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in self._at(h, g):
            found &= (self.words[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def _entries(least: int, buckets: int, flush: int = 1 << 18):
    """Map side: (bucket, entries) for the filters; bucket -1 - b: suspects with all their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int]] = []

        def out() -> Iterator[pa.RecordBatch]:
            h = np.array([x[0] for x in held], np.uint64)
            g = np.array([x[1] for x in held], np.uint64)
            doc = np.array([x[2] for x in held], np.int64)
            held.clear()
            order = np.lexsort((doc, g, h))
            h, g, doc = h[order], g[order], doc[order]
            at, n = groups(h, g)
            many = doc[at] != doc[at + n - 1]
            box = Outbox(ENTRY, buckets, 1 << 40)
            list(box.add((h[at] % np.uint64(buckets)).astype(np.int32), h[at], g[at], doc[at], many))
            yield from box.flush()
            new, _ = groups(h, g, doc)
            rest = np.setdiff1d(new[np.repeat(many, n)[new]], at)
            box = Outbox(ENTRY, buckets, 1 << 40)
            list(box.add(-1 - (mix(h[rest] ^ doc[rest].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32), h[rest], g[rest], doc[rest], np.ones(len(rest))))
            yield from box.flush()

        for batch in batches:
            for part in chunks(batch):
                ids, ok = _ids(part)
                for doc, known, text in zip(ids.tolist(), ok.tolist(), part.column(1).to_pylist()):
                    if not known or not text or len(text) < least:
                        continue
                    for line in text.split("\n"):
                        if len(line) >= least and len(key := line_key(line)) >= least:
                            held.append((*_hash(key), doc))
                if len(held) >= flush:
                    yield from out()
        if held:
            yield from out()

    return run


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of keys that the second filter has, as rows (h, g, doc)."""

    def rows(x: dict[str, np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x["h"][keep].view(np.int64)), pa.array(x["g"][keep].view(np.int64)), pa.array(x["doc"][keep])], names=["h", "g", "doc"])

    def buckets() -> Iterator[tuple[int, list]]:
        now, held = None, []
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1)):
                if k != now and held:
                    yield now, held
                    held = []
                now = k
                held.append(v)
        if held:
            yield now, held

    width = sum(np.dtype(k).itemsize for _, k in ENTRY)
    for bucket, payloads in buckets():
        if bucket < 0:
            for p in payloads:
                yield rows(opened([p], ENTRY), slice(None))
            continue
        total = sum(p.as_buffer().size for p in payloads) // width
        once, twice = Bloom(total), Bloom(total)
        for p in payloads:  # a key comes once in a payload
            x = opened([p], ENTRY)
            again = once.has(x["h"], x["g"]) | (x["many"] > 0)
            twice.add(x["h"][again], x["g"][again])
            once.add(x["h"], x["g"])
        for p in payloads:
            x = opened([p], ENTRY)
            keep = twice.has(x["h"], x["g"])
            if keep.any():
                yield rows(x, keep)


LOSS = [("doc", "<i8"), ("h", "<u8"), ("g", "<u8")]


def _losses(buckets: int):
    """Rows (doc, h, g) as blocks by the document's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Outbox(LOSS, buckets)
        for b in batches:
            doc, h, g = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            yield from out.add((doc % buckets).astype(np.int32), doc, h.view(np.uint64), g.view(np.uint64))
        yield from out.flush()

    return run


def _lost(blocks: pa.Table) -> dict[int, set]:
    x = opened(list(blocks.column("payload").combine_chunks()) if blocks.num_rows else [], LOSS)
    lost: dict[int, set] = {}
    for doc, h, g in zip(x["doc"].tolist(), x["h"].tolist(), x["g"].tolist()):
        lost.setdefault(doc, set()).add((h, g))
    return lost


def _left(text: str | None, gone: set | None, least: int) -> tuple[list[str], list[str]]:
    """A text's lines, and those that stay."""
    lines = (text or "").split("\n")
    return lines, lines if not gone else [s for s in lines if len(s) < least or len(key := line_key(s)) < least or _hash(key) not in gone]


def _kept(least: int):
    def run(docs: pa.Table, blocks: pa.Table) -> pa.Table:
        lost = _lost(blocks)
        cols: list[list] = [[], [], [], []]
        for doc, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()):
            lines, kept = _left(text, lost.get(doc), least)
            for c, v in zip(cols, (doc, len(lines), len(lines) - len(kept), "\n".join(kept))):
                c.append(v)
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    return run


def _rewritten(least: int, names: list[str]):
    def run(docs: pa.Table, blocks: pa.Table) -> pa.Table:
        lost = _lost(blocks)
        ids, texts = docs.column("_line_doc").to_pylist(), docs.column("text").to_pylist()
        texts = [t if doc not in lost else "\n".join(_left(t, lost[doc], least)[1]) for doc, t in zip(ids, texts)]
        at = docs.schema.get_field_index("text")
        release()
        return docs.set_column(at, docs.schema.field(at), pa.array(texts, docs.schema.field(at).type)).select(names)

    return run


def _loss_blocks(docs: DataFrame, n: int, least_chars: int, least_docs: int) -> DataFrame:
    """(document, key) of every line to drop, as blocks by the document's bucket."""
    entries = deal(docs.mapInArrow(_entries(least_chars, n), BLOCK), n)
    suspects = entries.mapInArrow(_suspects, "h long, g long, doc long")
    held = shared_checkpoint(suspects.distinct())
    frequent = held.groupBy("h", "g").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper")).where(F.col("n_docs") >= least_docs)
    losses = join_hot(held, frequent, ["h", "g"], "n_docs", held.count()).where(F.col("doc") != F.col("keeper")).select("doc", "h", "g")
    return losses.mapInArrow(_losses(n), BLOCK).repartition(n, "bucket")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """Drop lines whose key many documents hold, but for the largest doc_id that holds it.

    docs: doc_id long, text string.  Returns doc_id, n_lines (before), n_dropped,
    kept (text of the lines left) for each row.
    """
    small_batches(docs)
    n = parts(docs)
    docs = _texts(docs)
    blocks = _loss_blocks(docs, n, least_chars, least_docs)
    home = docs.withColumn("bucket", bucket_of("doc_id", n)).repartition(n, "bucket")
    return home.groupBy("bucket").cogroup(blocks.groupBy("bucket")).applyInArrow(_kept(least_chars), OUT)


def rewrite_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """docs with all its columns, and text without the lines that dedup_lines() drops (a null text stays null)."""
    small_batches(docs)
    n = parts(docs)
    blocks = _loss_blocks(_texts(docs), n, least_chars, least_docs)
    home = docs.withColumn("_line_doc", F.col("doc_id").cast("long")).withColumn("_line_bucket", bucket_of("_line_doc", n)).repartition(n, "_line_bucket")
    return home.groupBy("_line_bucket").cogroup(blocks.groupBy("bucket")).applyInArrow(_rewritten(least_chars, docs.columns), docs.schema)

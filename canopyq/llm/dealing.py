"""Dealing compact binary blocks to buckets, and meeting rows in a bucket.

Rows of numbers (hashes, positions, ids) move between stages as blocks: one
binary value per bucket and map flush that holds the rows' columns one after
another.  A shuffle then carries a few large values instead of millions of
small rows; it stays an ordinary Spark exchange, so it spills, is retried and
recovers as usual.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

BLOCK = "bucket int, payload binary"
BLOCK_SCHEMA = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])


#: Rows of an Arrow batch where the session has Spark's default: texts are larger than the rows that default has in mind.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> None:
    """Lower the session's Arrow batch size, if nobody has set it; bounds JVM and worker memory."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))


#: Buckets at most: beyond, they get larger (some 200 MB each for 200 TB of text).
MOST_BUCKETS = 1_000_000


def parts(df: DataFrame, each_mb: float = 14) -> int:
    """Buckets so that each holds about each_mb of df's text, which is measured; at least the session's shuffle partitions; odd."""
    size = df.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(conf, min(MOST_BUCKETS, math.ceil(size / (each_mb * (1 << 20))))) | 1


def bucket_of(column: str, buckets: int) -> Column:
    """Bucket of an id column; buckets_of() gives the same.  Nulls, however many, are dealt to all buckets in turn."""
    return F.coalesce(F.pmod(F.col(column), F.lit(buckets)), F.pmod(F.monotonically_increasing_id(), F.lit(buckets))).cast("int")


def buckets_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (ids % buckets).astype(np.int32)


def blocks(keys: np.ndarray, cols: list[np.ndarray]) -> pa.RecordBatch:
    """Rows as one block a bucket."""
    order = np.argsort(keys, kind="stable")
    keys, cols = keys[order], [c[order] for c in cols]
    cut = np.flatnonzero(np.diff(keys)) + 1
    lows, highs = [0, *cut.tolist()], [*cut.tolist(), len(keys)]
    data = [b"".join(c[lo:hi].tobytes() for c in cols) for lo, hi in zip(lows, highs)]
    return pa.RecordBatch.from_arrays([pa.array(keys[lows], pa.int32()), pa.array(data, pa.binary())], schema=BLOCK_SCHEMA)


class Outbox:
    """Collects rows of the given fields and hands them out as blocks, one per bucket.

    combine: what a flush makes of its keys and columns, as several such lists;
    the place to send less of a frequent key.
    """

    def __init__(self, fields: list[tuple[str, str]], buckets: int, limit: int = 1 << 18, combine: Callable | None = None):
        # some rows a block even with very many buckets, as far as 4 million rows go
        self.fields, self.buckets, self.limit = fields, buckets, max(limit, min(8 * buckets, 1 << 22))
        self.combine = combine or (lambda keys, cols: [(keys, cols)])
        self.keys: list[np.ndarray] = []
        self.cols: list[list[np.ndarray]] = [[] for _ in fields]
        self.held = 0

    def add(self, keys: np.ndarray, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            self.keys.append(keys.astype(np.int32, copy=False))
            for held, c, (_, kind) in zip(self.cols, cols, self.fields):
                held.append(c.astype(kind, copy=False))
            self.held += len(keys)
            if self.held >= self.limit:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        keys, cols = np.concatenate(self.keys), [np.concatenate(c) for c in self.cols]
        self.keys, self.cols, self.held = [], [[] for _ in self.fields], 0
        for k, c in self.combine(keys, cols):
            if len(k):
                yield blocks(k, c)


def repeated(values: np.ndarray, least: int = 2) -> np.ndarray:
    """Places of the values that occur least times or more, in their order; cheap where there are none."""
    ordered = np.sort(values)
    hit = ordered[: len(ordered) - least + 1] == ordered[least - 1 :] if len(ordered) >= least else np.zeros(0, bool)
    return np.flatnonzero(np.isin(values, np.unique(ordered[: len(hit)][hit]))) if hit.any() else np.zeros(0, np.int64)


def aside(batches: Iterator[pa.RecordBatch], passed: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of buckets from 0 on; those of bucket -1 - b, which are done here, are put into passed as blocks of b."""
    for batch in batches:
        below = pc.less(batch.column(0), 0)
        direct = batch.filter(below)
        if direct.num_rows:
            passed.append(pa.RecordBatch.from_arrays([pa.array(-1 - direct.column(0).to_numpy(), pa.int32()), direct.column(1)], schema=BLOCK_SCHEMA))
        yield batch.filter(pc.invert(below))


def release() -> None:
    """Give freed memory back to the system: workers stay for other tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def opened(payloads: list, fields: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    """The rows in some payloads, column by column."""
    width = sum(np.dtype(kind).itemsize for _, kind in fields)
    got: dict[str, list[np.ndarray]] = {name: [] for name, _ in fields}
    for p in payloads:
        buf, at = p.as_buffer(), 0
        n = buf.size // width
        for name, kind in fields:
            got[name].append(np.frombuffer(buf, dtype=kind, count=n, offset=at))
            at += n * np.dtype(kind).itemsize
    return {name: np.concatenate(got[name]) if got[name] else np.zeros(0, kind) for name, kind in fields}


def deal(blocks: DataFrame, n: int) -> DataFrame:
    """Blocks with all of a bucket in one partition, bucket after bucket; every partition gets one bucket from 0 on."""
    return blocks.repartitionById(n, F.pmod(F.col("bucket"), F.lit(n)).cast("int")).sortWithinPartitions("bucket")


def numbered_buckets(batches: Iterator[pa.RecordBatch], fields: list[tuple[str, str]]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Each bucket's number and rows from batches that deal() has ordered; one bucket is held at a time."""
    now, held = None, []
    for b in batches:
        for k, v in zip(b.column(0).to_pylist(), b.column(1)):
            if k != now:
                if held:
                    yield now, opened(held, fields)
                now, held = k, []
            held.append(v)
    if held:
        yield now, opened(held, fields)
    held.clear()
    release()


def by_bucket(batches: Iterator[pa.RecordBatch], fields: list[tuple[str, str]]) -> Iterator[dict[str, np.ndarray]]:
    """Each bucket's rows, as numbered_buckets() without the number."""
    for _, x in numbered_buckets(batches, fields):
        yield x


def groups(*sorted_cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal rows, and the runs' lengths, in sorted columns."""
    n = len(sorted_cols[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in sorted_cols:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, n))


#: Keys that a hot-key broadcast may hold at most.
HOT_KEYS = 100_000


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, most_rows: int, how: str = "inner") -> DataFrame:
    """rows joined with facts (one row a key; count: how many of rows have it), without one task for a frequent key.

    most_rows bounds the number of rows, so at most HOT_KEYS keys can have more
    than most_rows / HOT_KEYS of them: those facts are broadcast, the others
    meet their rows by a shuffle.
    """
    least = max(1000, most_rows // HOT_KEYS + 1)
    hot = F.broadcast(facts.where(F.col(count) > least))
    cold = facts.where(F.col(count) <= least)
    return rows.join(hot, keys, "inner").unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how))

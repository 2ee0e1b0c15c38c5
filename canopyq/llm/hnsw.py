"""Approximate nearest neighbours: one small-world graph per shard, results merged.

Vectors are dealt to shards of bounded size by a hash of their id.  Each shard
builds a hierarchical navigable small-world graph over its distinct vectors
(equal vectors are one node with a list of ids, so a very frequent vector costs
one node a shard and loses no id) and keeps it as flat neighbour arrays in one
row.  Query rows are packed into blocks; blocks are broadcast, a bounded number of
bytes at a time, to the shards, where a block walks the graph in lock step.  Each
shard's list is cut to what can win before it moves, and the lists are merged by
distance, then id.

Every vector is indexed.  Distances in results are exact, in double precision,
on the original vectors.  Defined results: vectors that are null, empty, zero,
or with null or non-finite components take no part, as query or candidate.
Vectors of different lengths are in shards of their own and are no candidates of
each other.  Every query row gets results of its own; its candidates are all rows
but itself, so another row with its id, or its vector, is one.  Ties go to the
smaller vec_id, and a tie is settled over all equally distant nodes that the walk
has found.  Where squares of components would leave the range of doubles, shards
are kept apart by magnitude and distances are worked out in scaled numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.shared import shared_checkpoint
from .dealing import release

#: Links of a node on the ground level and above, and the beams' widths.
GROUND, UPPER = 32, 16
BUILD_BEAM, SEARCH_BEAM = 64, 96
BATCH = 256
#: Vectors of a shard: the most, and the least worth a graph of its own where cores would idle.
SHARD_ROWS, LEAST_ROWS = 65536, 4096
#: Bytes of query vectors in a block, which is broadcast.
BLOCK_BYTES = 32 << 20
#: Powers of two of the largest component that share a shard; within twice that, squares are in range.
MAGNITUDES = 400


def _distances(x: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its row of node ids."""
    d = x[ids] - queries[:, None, :]
    return np.einsum("bkd,bkd->bk", d, d)


def _beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The width nearest nodes that a best-first walk from entry finds, for all queries in lock step; -1 fills up."""
    n, b = len(x), len(queries)
    seen = np.zeros((b, n), bool)
    rows = np.arange(b)
    ids = np.full((b, width), -1)
    dist = np.full((b, width), np.inf, dtype=x.dtype)
    done = np.ones((b, width), bool)
    ids[:, 0], done[:, 0] = entry, False
    dist[:, 0] = _distances(x, queries, entry[:, None])[:, 0]
    seen[rows, entry] = True
    while True:
        at = np.where(done, np.inf, dist).argmin(axis=1)
        live = np.flatnonzero(~done[rows, at])
        if not len(live):
            return ids, dist
        at = at[live]
        node = ids[live, at]
        done[live, at] = True
        near = links[node]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        safe = np.where(near >= 0, near, node[:, None])
        seen[live[:, None], safe] = True
        d = np.where(fresh, _distances(x, queries[live], safe), np.inf)
        every = np.concatenate([dist[live], d], axis=1)
        best = np.argpartition(every, width - 1, axis=1)[:, :width] if every.shape[1] > width else np.tile(np.arange(width), (len(live), 1))
        dist[live] = np.take_along_axis(every, best, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1), best, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], axis=1), best, 1) | ~np.isfinite(dist[live])


def _diverse(x: np.ndarray, nodes: np.ndarray, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Up to most of each node's candidates: near ones that no kept one is nearer to; then the nearest of the rest."""
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    good = np.isfinite(dist) & (ids >= 0) & (ids != nodes[:, None])
    v = x[np.maximum(ids, 0)]
    square = np.einsum("bkd,bkd->bk", v, v)
    between = square[:, :, None] + square[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
    kept = np.zeros_like(good)
    for j in range(ids.shape[1]):
        crowded = (kept & (between[:, j, :] < dist[:, j : j + 1])).any(axis=1)
        repeated = (kept & (ids == ids[:, j : j + 1])).any(axis=1)
        kept[:, j] = good[:, j] & ~crowded & ~repeated & (kept.sum(axis=1) < most)
    rank = np.where(kept, 0, np.where(good, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
    take = np.argsort(rank, axis=1)[:, :most]
    out = np.where(np.take_along_axis(good, take, 1), np.take_along_axis(ids, take, 1), -1)
    # a candidate may come twice among the rest
    again = np.sort(out, axis=1)
    if ((again[:, 1:] == again[:, :-1]) & (again[:, 1:] >= 0)).any():
        for r in out:
            _, first = np.unique(r, return_index=True)
            drop = np.ones(len(r), bool)
            drop[first] = False
            r[drop] = -1
    return out


class Graph:
    """Levels of flat neighbour arrays over n vectors; levels[l][i] are node i's links, -1 none."""

    def __init__(self, x: np.ndarray):
        self.x = x
        n = len(x)
        rng = np.random.default_rng(n)
        height = np.floor(-np.log(1 - rng.random(n)) / math.log(UPPER)).astype(int)
        order = rng.permutation(n)
        top = int(height.max()) if n else 0
        self.entry = int(order[height[order].argmax()]) if n else -1
        # the entry comes first, so that every walk starts at the top
        order = np.concatenate([[self.entry], order[order != self.entry]]).astype(int) if n else order
        self.levels = [np.full((n, GROUND if level == 0 else UPPER), -1, np.int32) for level in range(top + 1)]
        done = 0
        while done < n:
            batch = order[done : done + max(1, min(BATCH, done))]
            self._insert(batch, height[batch], done)
            done += len(batch)
        if n:
            self._reach()

    def _reach(self) -> None:
        """Gives nodes that no walk on the ground level comes to a link from one of their own neighbours, in columns of their own."""
        while True:
            links = self.levels[0]
            seen = np.zeros(len(self.x), bool)
            seen[self.entry] = True
            front = np.array([self.entry])
            while len(front):
                near = np.unique(links[front])
                front = near[(near >= 0) & ~seen[np.maximum(near, 0)]]
                seen[front] = True
            lost = np.flatnonzero(~seen)
            if not len(lost):
                return
            near = links[lost]
            known = (near >= 0) & seen[np.maximum(near, 0)]
            source = np.where(known.any(axis=1), near[np.arange(len(lost)), known.argmax(axis=1)], self.entry)
            # one new link a source and round
            source, one = np.unique(source, return_index=True)
            more = np.full((len(links), 1), -1, links.dtype)
            more[source, 0] = lost[one]
            self.levels[0] = np.concatenate([links, more], axis=1)

    def _insert(self, nodes: np.ndarray, height: np.ndarray, before: int) -> None:
        if not before:
            return
        q = self.x[nodes]
        entry = np.full(len(nodes), self.entry)
        for level in range(len(self.levels) - 1, -1, -1):
            links = self.levels[level]
            ids, dist = _beam(self.x, links, q, entry, BUILD_BEAM)
            entry = ids[np.arange(len(nodes)), dist.argmin(axis=1)]
            here = np.flatnonzero(height >= level)
            if not len(here):
                continue
            own = nodes[here]
            mates = np.tile(own, (len(own), 1))
            d = _distances(self.x, q[here], mates)
            k = min(len(own), links.shape[1])
            close = np.argsort(d, axis=1)[:, :k]
            ids = np.concatenate([ids[here], np.take_along_axis(mates, close, 1)], axis=1)
            d = np.concatenate([dist[here], np.take_along_axis(d, close, 1)], axis=1)
            links[own] = _diverse(self.x, own, ids, d, links.shape[1])
            self._link_back(links, own)

    def _link_back(self, links: np.ndarray, nodes: np.ndarray) -> None:
        """Nodes become candidates of those they link to, which choose anew."""
        source = np.repeat(nodes, links.shape[1])
        target = links[nodes].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        at, first, n = np.unique(target, return_index=True, return_counts=True)
        for lo in range(0, len(at), 1024):
            t, f, k = at[lo : lo + 1024], first[lo : lo + 1024], n[lo : lo + 1024]
            new = np.full((len(t), int(k.max())), -1)
            row = np.repeat(np.arange(len(t)), k)
            col = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            new[row, col] = source[np.repeat(f, k) + col]
            ids = np.concatenate([links[t], new], axis=1)
            d = np.where(ids >= 0, _distances(self.x, self.x[t], np.maximum(ids, 0)), np.inf)
            links[t] = _diverse(self.x, t, ids, d, links.shape[1])

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        """Ids of the width nearest nodes found for each query; -1 fills up.  A beam as wide as the graph holds all of it."""
        if len(self.x) <= width:
            return np.tile(np.arange(len(self.x)), (len(queries), 1))
        entry = np.full(len(queries), self.entry)
        for level in range(len(self.levels) - 1, 0, -1):
            ids, dist = _beam(self.x, self.levels[level], queries, entry, 4)
            entry = ids[np.arange(len(queries)), dist.argmin(axis=1)]
        return _beam(self.x, self.levels[0], queries, entry, width)[0]


INDEX = "shard int, dim int, magnitude int, entry int, vectors binary, first binary, ids binary, links array<binary>"


def _scaled(x: np.ndarray, magnitude: int) -> np.ndarray:
    """Components of a magnitude taken, by a power of two, to where their squares are in range."""
    return np.ldexp(x, -MAGNITUDES * magnitude) if magnitude else x


def _build(key: tuple, table: pa.Table) -> pa.Table:
    ids = table.column("vec_id").to_numpy()
    vectors = table.column("v").combine_chunks()
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    nodes, member = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((ids, member.ravel()))
    first = np.searchsorted(member.ravel()[order], np.arange(len(nodes) + 1))
    magnitude = key[2].as_py()
    g = Graph(_scaled(nodes, magnitude))
    return pa.table(
        [pa.array([key[0].as_py()], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([magnitude], pa.int32()), pa.array([g.entry], pa.int32()), pa.array([nodes.tobytes()], pa.binary()), pa.array([first.astype(np.int64).tobytes()], pa.binary()), pa.array([ids[order].astype(np.int64).tobytes()], pa.binary()), pa.array([[a.tobytes() for a in g.levels]], pa.list_(pa.binary()))],
        names=["shard", "dim", "magnitude", "entry", "vectors", "first", "ids", "links"],
    )


QUERIES = "block int, dim int, magnitude int, rows binary, own binary, points binary"


def _packed(key: tuple, table: pa.Table) -> pa.Table:
    """A block of query rows, as one row."""
    block, dim, magnitude = (k.as_py() for k in key)
    rows, own = (table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("row", "vec_id"))
    points = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).tobytes()
    return pa.table([pa.array([v], t) for v, t in ((block, pa.int32()), (dim, pa.int32()), (magnitude, pa.int32()), (rows, pa.binary()), (own, pa.binary()), (points, pa.binary()))], names=["block", "dim", "magnitude", "rows", "own", "points"])


FOUND = "row long, query_id long, vec_id long, score double"


def _search(k: int):
    """Each (shard, block of queries): the queries' k nearest found in the shard."""

    def one(r: dict) -> Iterator[pa.RecordBatch]:
        nodes = np.frombuffer(r["vectors"], np.float64).reshape(-1, r["dim"])
        magnitude = max(r["magnitude"], r["magnitude_q"])
        g = Graph.__new__(Graph)
        g.x, g.entry = _scaled(nodes, magnitude), r["entry"]
        g.levels = [np.frombuffer(b, np.int32).reshape(len(nodes), -1) for b in r["links"]]
        first, ids = np.frombuffer(r["first"], np.int64), np.frombuffer(r["ids"], np.int64)
        rows, own = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["own"], np.int64)
        points = np.frombuffer(r["points"], np.float64).reshape(len(rows), -1)
        q = _scaled(points, magnitude)
        for lo in range(0, len(rows), BATCH):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for i, near in enumerate(g.search(q[lo : lo + BATCH], max(SEARCH_BEAM, 4 * k)), lo):
                near = near[near >= 0]
                d = _scaled(np.sqrt(((g.x[near] - q[i]) ** 2).sum(axis=1)), -magnitude)
                # by distance, then smallest id: no later node can have one of the k + 1 best
                near, d = (c[np.lexsort((ids[first[near]], d))[: k + 1]] for c in (near, d))
                each = [ids[first[m] : first[m + 1]][: k + 2] for m in near]
                for j, e in enumerate(each):
                    mine = np.flatnonzero(e == own[i])
                    if len(mine) and (nodes[near[j]] == points[i]).all():  # the row itself, once
                        each[j] = np.delete(e, mine[0])
                got, dist = np.concatenate(each), np.repeat(d, [len(e) for e in each])
                best = np.lexsort((got, dist))[:k]
                for c, v in zip(out, (np.full(len(best), rows[i]), np.full(len(best), own[i]), got[best], dist[best])):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["row", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                yield from one(r)
        release()

    return run


def sound_vectors(table: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part."""
    v = F.col(column).cast("array<double>")
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(math.inf)))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda e: e != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int | None = None) -> DataFrame:
    """The k nearest found of each query row: row (its number), query_id, rank, vec_id, score (Euclidean distance).

    Both sides: vec_id long, v array<double>.  Queries are rows of vectors.
    """
    spark = vectors.sparkSession
    n, cores = vectors.count(), spark.sparkContext.defaultParallelism
    shards = math.ceil(n / shard_rows) if shard_rows else max(math.ceil(n / SHARD_ROWS), min(math.ceil(n / LEAST_ROWS), cores))
    shards = max(1, shards)
    largest = F.array_max(F.transform("v", F.abs))
    magnitude = F.round(F.log2(largest) / F.lit(MAGNITUDES)).cast("int").alias("magnitude")
    dealt = vectors.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("dim"), magnitude)
    # a shard a partition: graphs are the work
    index = shared_checkpoint(dealt.repartition(shards, "shard", "dim", "magnitude").groupBy("shard", "dim", "magnitude").applyInArrow(_build, INDEX))
    # query rows are numbered once and written, so the numbers stay
    asked = shared_checkpoint(queries.select("vec_id", "v", F.size("v").alias("dim"), magnitude, F.monotonically_increasing_id().alias("row")))
    size = asked.agg(F.sum(F.lit(8) * F.col("dim"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    packed = shared_checkpoint(asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).groupBy("block", "dim", "magnitude").applyInArrow(_packed, QUERIES))
    names = ["shard", "dim", "magnitude", "entry", "vectors", "first", "ids", "links", "magnitude_q", "rows", "own", "points"]
    found = None
    for at in range(blocks):
        part = F.broadcast(packed.where(F.col("block") == at).select("dim", F.col("magnitude").alias("magnitude_q"), "rows", "own", "points"))
        some = index.join(part, "dim").select(*names).mapInArrow(_search(k), FOUND)
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("row", "query_id", "rank", "vec_id", "score")

"""Exact Jaccard self-join on word shingles by universe partition.

A document is the set of its hashed 5-word shingles.  Sets of sizes b..2b and
their possible partners share a scheme: the hash universe is cut into a number
of segments that depends on b alone.  A set's subset in a segment is one
signature.  Two sets with Jaccard >= t differ in at most
tau = (|x| + |y|) (1 - t) / (1 + t) tokens, so at most tau of a set's
(non-empty) segments differ from the partner's.

Cost-based allocation: a set probes tau + 1 of its segments, those whose
signatures the fewest sets have, and leaves the costly ones out; as both sides
rank signatures alike, two similar sets still meet in one (prefix argument).
Signatures that only one set has count as probed and go nowhere, and only shared
ones move on from where they are counted.

A set with at most tau non-empty segments (tiny or lopsided) cannot afford that.
If its partner is as poor, they meet by one-deletion neighbourhoods: each indexes
its segments' subsets, and those subsets less one token, so a segment of two
tokens or more stands for two differences, one of a single token for one.  Of
these units a pair needs tau + 1 again; a set that has not even those indexes its
tokens one by one, the finest partition.  A neighbourhood costs an entry a token,
so the rule takes it only where subsets alone can't do.

A signature that many sets share is not brought together: a map flush that holds
HOT of its sets answers them itself and sends one mark on.  All such signatures
cost the same, so both sides still rank alike.  Sets that must probe one stay rows,
and get the group's centre by a join.

Small signature groups give all their pairs; a large one gives a star around
its most central member (whose signatures the most sets share).  A star edge
that fails verification leaves its member open.  Relative to the centre c, a
member y lacks m_y of c's tokens and has s_y tokens that no other member has;
so two members differ in at least s_x + s_y + |m_x - m_y| tokens.  An open member
whose bound exceeds what a link allows for every fellow is closed, and so is one
that other links already put into the centre's component.  The others first try
the few linked members with the best bounds, as one link is enough to join the
centre's component; then those left get a new centre from among them, as long as
that joins most of them.  What is then left is compared by its differences from
the centre: two members link only if their differences overlap, more so the more
they have, so they share one of the rarest of their differing tokens (prefix
argument).  Members meet by those tokens, and a pair goes on if the bound, the
triangle inequality and the sets' parity sketches allow a link.  So every link is
verified exactly or joins what verified links join, a group of near copies costs
a few pairs a member, and no group is paired with itself.

Texts with equal sets are one class throughout and never expand into pairs.

Defined results: no words or null text: no shingles, linked with nothing (its
component is its own doc_id).  Under five words the whole sequence is one
shingle.  Rows that repeat a doc_id are separate rows of one id.  A null doc_id
takes part and gets its component's smallest non-null doc_id, null if none.
Extra columns are ignored.  Sets are told apart by a 64-bit hash; signatures by
their bucket and 32 bits, as a chance match only adds a candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.shared import free_shuffles, shared_checkpoint
from .components import connected
from .dealing import BLOCK, MOST_BUCKETS, Outbox, aside, by_bucket, deal, groups, join_hot, numbered_buckets, opened, parts, release, repeated, small_batches
from .vectext import Words, chunks, mix, windows

#: Group size up to which all pairs are candidates.
SMALL = 3

#: role: 0, 1 as in _schemes(), FINE, or MANY (of this signature a flush had HOT sets).  A signature is its bucket and sig.
ENTRY = [("sig", "<u4"), ("id", "<u8"), ("role", "<u1")]
FINE, MANY = 2, 3
#: Sets of a signature up to which they are counted.
HOT = 256
#: at: the signature's bucket; n: how many sets share it.  A set's header has n = 0, its size and lack in the others.
SHARED = [("sig", "<u4"), ("at", "<u4"), ("id", "<u8"), ("role", "<u1"), ("n", "<u4")]
#: rank: the lower, the more central.
MEMBER = [("sig", "<u4"), ("id", "<u8"), ("size", "<u4"), ("rank", "<u4")]
HOT_MEMBER = [("at", "<u4"), *MEMBER]


class Sets:
    """Distinct shingle hashes of each row of a slice, ascending; first: rows + 1 offsets."""

    def __init__(self, texts: pa.Array, shingle: int = 5):
        w = Words(texts)
        words, row, place = w.hashes(lower=True), w.row_of_word(), w.place()
        n = w.counts[row]
        at = np.flatnonzero(place + shingle <= n)
        h, of = windows(words, at, shingle) if len(at) else np.zeros(0, np.uint64), row[at]
        for size in range(1, shingle):  # shorter rows: one sequence each
            short = np.flatnonzero((n == size) & (place == 0))
            if len(short):
                h = np.concatenate([h, mix(windows(words, short, size) + np.uint64(size))])
                of = np.concatenate([of, row[short]])
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        at, _ = groups(of, h)
        self.tokens, self.row, self.rows = h[at], of[at], w.rows
        self.first = np.searchsorted(self.row, np.arange(w.rows + 1))
        self.sizes = np.diff(self.first)
        total = np.append(np.uint64(0), np.cumsum(mix(self.tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5))))
        self.ids = mix(total[self.first[1:]] - total[self.first[:-1]] + self.sizes.astype(np.uint64))

    def of(self, row: int) -> np.ndarray:
        return self.tokens[self.first[row] : self.first[row + 1]]


def _id_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (ids % np.uint64(buckets)).astype(np.int32)


INFO = "doc_id long, n_shingles long, set_id long, lack0 int, lack1 int"


def _info(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                s = Sets(part.column(1), shingle)
                lack = np.zeros((2, s.rows), np.int32)
                for role, _, tau, _, row, _, at in _schemes(s, percent):
                    filled = np.bincount(row[at], minlength=s.rows)
                    lack[role] = np.minimum(tau + 1, filled) - filled
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.sizes.astype(np.int64)), pa.array(s.ids.view(np.int64), mask=s.sizes == 0), pa.array(lack[0]), pa.array(lack[1])], names=["doc_id", "n_shingles", "set_id", "lack0", "lack1"])
        release()

    return run


def segments_of(band: np.ndarray) -> np.ndarray:
    """Segments of the scheme for sizes from 2**band on: finer for small sets, where chance is rougher."""
    return (1 << band) * np.where(band <= 4, 4, np.where(band <= 6, 2, 1))


def _schemes(s: Sets, percent: int) -> Iterator[tuple]:
    """The scheme of each set's own band (role 0), and of the band below (role 1) where partners may be.

    (role, each row's band and tau, tokens, their rows and segments, each filled segment's first token).
    """
    sizes = s.sizes
    own = np.frexp(np.maximum(sizes, 1))[1] - 1
    limit = 1 << own.astype(np.int64)
    for role in (0, 1):
        band = np.maximum(own - role, 0)
        if role:
            takes = (sizes > 0) & (own > 0) & (sizes * percent <= (limit - 1) * 100)
            partner = np.minimum(sizes - 1, limit - 1)
        else:
            takes = sizes > 0
            partner = sizes * 100 // percent
        tau = (sizes + partner) * (100 - percent) // (100 + percent)
        pick = takes[s.row]
        tokens, row = s.tokens[pick], s.row[pick]
        if len(tokens):
            m = segments_of(band.astype(np.int64))[row].astype(np.uint64)
            seg = ((tokens >> np.uint64(32)) * m) >> np.uint64(32)  # ascending within a row, as tokens are
            at, _ = groups(row, seg)
            yield role, band, tau, tokens, row, seg, at


def _signatures(s: Sets, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(signatures, their rows, role) of the slice's sets."""
    for role, band, tau, tokens, row, seg, at in _schemes(s, percent):
        mixed = mix(tokens ^ np.uint64(0x6A09E667F3BCC908))
        subset = np.add.reduceat(mixed, at)
        of = row[at]
        key = lambda seg, rows, kind: seg * np.uint64(0x9E3779B97F4A7C15) + (band[rows].astype(np.uint64) + np.uint64(kind)) * np.uint64(0xC2B2AE3D27D4EB4F)
        yield mix(subset + key(seg[at], of, 0)), of, role
        filled = np.bincount(of, minlength=s.rows)
        poor = filled <= tau
        if not poor[of].any():
            continue
        # one-deletion neighbourhoods: subsets, and subsets less each token
        n = np.diff(np.append(at, len(tokens)))
        p = poor[of]
        yield mix(subset[p] + key(seg[at][p], of[p], 64)), of[p], FINE
        p = np.repeat(p & (n > 1), n)
        yield mix(np.repeat(subset, n)[p] - mixed[p] + key(seg[p], row[p], 64)), row[p], FINE
        units = filled + np.bincount(of[n > 1], minlength=s.rows)
        p = (poor & (units <= tau))[row]
        if p.any():
            yield mix(tokens[p] + key(np.uint64(0), row[p], 128)), row[p], FINE


def _place(sig: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A signature's bucket, and the bits that tell it apart there."""
    return ((sig & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int32), (sig >> np.uint64(32)).astype(np.uint32)


def _entries(shingle: int, percent: int, buckets: int):
    def combine(keys: np.ndarray, cols: list[np.ndarray]) -> list[tuple]:
        """Entries for the signatures' buckets; of signatures with HOT sets a mark there, and the sets' answers."""
        sig, ids, role = cols
        which = (keys.astype(np.uint64) << np.uint64(32)) | sig
        some = repeated(which, HOT)
        if not len(some):
            return [(keys, cols)]
        some = some[np.lexsort((role[some], ids[some], which[some]))]
        some = some[groups(which[some], ids[some], role[some])[0]]  # equal sets of several slices once
        at, n = groups(which[some])
        frequent, marks, some = which[some][at[n >= HOT]], some[at[n >= HOT]], some[np.repeat(n >= HOT, n)]
        many = np.isin(which, frequent)
        known = [sig[some], keys[some].astype(np.uint32), ids[some], role[some], np.full(len(some), HOT, np.uint32)]
        entries = [np.concatenate([c[~many], c[marks]]) for c in (sig, ids)]
        entries.append(np.concatenate([role[~many], np.full(len(marks), MANY, np.uint8)]))
        return [(-1 - _id_bucket(ids[some], buckets), known), (np.concatenate([keys[~many], keys[marks]]), entries)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Outbox(ENTRY, buckets, 1 << 19, combine)
        for batch in batches:
            for part in chunks(batch):
                s = Sets(part.column(0), shingle)
                _, one = np.unique(s.ids, return_index=True)  # equal sets once a slice
                once = np.zeros(s.rows, bool)
                once[one] = True
                for sig, row, role in _signatures(s, percent):
                    k = once[row]
                    at, sig = _place(sig[k], buckets)
                    yield from out.add(at, sig, s.ids[row[k]], np.full(len(sig), role))
        yield from out.flush()
        release()

    return run


def _headers(buckets: int):
    """Each set's size and lacks, as rows of SHARED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Outbox(SHARED, buckets)
        for b in batches:
            ids = b.column(0).to_numpy().view(np.uint64)
            size, *lacks = (b.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3))
            for role, lack in enumerate((*lacks, np.zeros(len(ids), np.int64))):
                yield from out.add(_id_bucket(ids, buckets), size, lack.astype(np.int32).view(np.uint32), ids, np.full(len(ids), role), np.zeros(len(ids)))
        yield from out.flush()

    return run


def _shared(buckets: int):
    """Entries whose signature several sets have, with their number (HOT at most), back to the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, passed = Outbox(SHARED, buckets), []
        for bucket, x in numbered_buckets(aside(batches, passed), ENTRY):
            yield from passed
            passed.clear()
            order = np.argsort(x["sig"], kind="stable")
            at, n = groups(x["sig"][order])
            order = order[np.repeat(n > 1, n)]
            order = order[np.lexsort((x["role"][order], x["id"][order], x["sig"][order]))]
            sig, ids = x["sig"][order], x["id"][order]
            at, _ = groups(sig, ids, x["role"][order])  # equal sets of other slices once
            order, sig = order[at], sig[at]
            mark = x["role"][order] == MANY
            at, n = groups(sig)
            marked = np.add.reduceat(mark, at) > 0 if len(at) else n > 0
            n = np.where(marked, HOT, np.minimum(n, HOT))
            n = np.repeat(n, np.diff(np.append(at, len(sig))))
            keep = (n > 1) & ~mark
            order, n = order[keep], n[keep]
            ids = x["id"][order]
            yield from out.add(_id_bucket(ids, buckets), x["sig"][order], np.full(len(order), bucket), ids, x["role"][order], n)
        yield from passed
        yield from out.flush()

    return run


def _allocate(buckets: int):
    """The signatures that each set probes: the rarest, after those it has alone.  Those of HOT signatures go to bucket -1, as HOT_MEMBER."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, hot = Outbox(MEMBER, buckets), Outbox(HOT_MEMBER, buckets)
        for x in by_bucket(batches, SHARED):
            order = np.lexsort((x["sig"], x["at"], x["n"], x["role"], x["id"]))  # a header comes first
            x = {k: v[order] for k, v in x.items()}
            at, _ = groups(x["id"], x["role"], x["n"], x["at"], x["sig"])  # equal sets of other flushes once
            x = {k: v[at] for k, v in x.items()}
            head, n = groups(x["id"], x["role"])
            size, lack = np.repeat(x["sig"][head], n), x["at"][head].view(np.int32).astype(np.int64)
            place = np.arange(len(size)) - np.repeat(head, n)
            keep = (place > 0) & (place <= np.repeat(n - 1 + lack, n))
            shared = np.add.reduceat(x["n"].astype(np.int64), head) if len(head) else head
            rank = np.repeat((1 << 32) - 1 - np.minimum(shared, (1 << 32) - 1), n)
            k = keep & (x["n"] < HOT)
            yield from out.add(x["at"][k].astype(np.int32), x["sig"][k], x["id"][k], size[k], rank[k])
            k = keep & (x["n"] >= HOT)
            yield from hot.add(np.full(int(k.sum()), -1), x["at"][k], x["sig"][k], x["id"][k], size[k], rank[k])
        yield from out.flush()
        yield from hot.flush()

    return run


def _hot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, rank) of blocks of HOT_MEMBER."""
    for b in batches:
        x = opened(list(b.column(1)), HOT_MEMBER)
        key = (x["at"].astype(np.int64) << 32) | x["sig"].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(x["id"].view(np.int64)), pa.array(x["rank"].astype(np.int64))], names=["key", "id", "rank"])


def hot_stars(hot: DataFrame) -> DataFrame:
    """(centre, member) pairs of the groups of rows (key, id, rank)."""
    heads = shared_checkpoint(hot.groupBy("key").agg(F.min(F.struct("rank", "id")).alias("head"), F.count("*").alias("n")).select("key", F.col("head.id").alias("x"), "n"))
    rows = heads.agg(F.sum("n")).first()[0] or 0
    return join_hot(hot, heads, ["key"], "n", rows).where(F.col("id") != F.col("x")).select("x", F.col("id").alias("y"))


def _members(x: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Members in order of signature, rank and id, each group's start and length."""
    order = np.lexsort((x["id"], x["rank"], x["sig"]))
    sig, ids, size = x["sig"][order], x["id"][order], x["size"][order].astype(np.int64)
    at, n = groups(sig)
    return sig, ids, size, at, n


def _star_pairs(percent: int):
    """Candidate pairs: all of small groups, (centre, member) of large ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in by_bucket(batches, MEMBER):
            _, ids, size, at, n = _members(x)
            found = []
            for first in range(SMALL):  # from the first member: all groups; from later ones: small groups
                for step in range(1, SMALL):
                    groups_in = (n > first + step) & (n <= SMALL)
                    a = at[groups_in] + first
                    found.append((a, a + step))
            small_pairs = sum(len(c[0]) for c in found)
            big = n > SMALL
            center = np.repeat(at[big], n[big])
            other = np.arange(len(center)) - np.repeat(np.cumsum(n[big]) - n[big], n[big]) + center
            found.append((center[other > center], other[other > center]))
            a, b = (np.concatenate(c) for c in zip(*found))
            # in a large group every member gets its place relative to the centre
            fits = (np.minimum(size[a], size[b]) * 100 >= np.maximum(size[a], size[b]) * percent) | (np.arange(len(a)) >= small_pairs)
            pair = np.unique(np.stack([ids[a[fits]], ids[b[fits]]], axis=1), axis=0) if fits.any() else np.zeros((0, 2), np.uint64)
            if len(pair):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, i]).view(np.int64)) for i in (0, 1)], names=["x", "y"])

    return run


def _homes(shingle: int, buckets: int):
    """(bucket, set_id, text): each set's text once a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                s = Sets(part.column(0), shingle)
                ids, one = np.unique(s.ids, return_index=True)
                one = one[s.sizes[one] > 0]
                yield pa.RecordBatch.from_arrays([pa.array(_id_bucket(s.ids[one], buckets)), pa.array(s.ids[one].view(np.int64)), part.column(0).take(pa.array(one))], names=["bucket", "set_id", "text"])

    return run


def _texts_wanted(home: pa.Table, wanted: np.ndarray, shingle: int) -> dict[int, np.ndarray]:
    """Sets by id, of the wanted ids that a bucket holds."""
    ids = home.column("set_id").to_numpy().view(np.uint64)
    found, one = np.unique(ids, return_index=True)
    one = one[np.isin(found, wanted)]
    sets: dict[int, np.ndarray] = {}
    if len(one):
        rows = home.select(["text"]).take(pa.array(one)).combine_chunks()
        at = ids[one]
        i = 0
        for batch in rows.to_batches():
            for part in chunks(batch):
                s = Sets(part.column(0), shingle)
                for r in range(s.rows):
                    sets[int(at[i])] = s.of(r)
                    i += 1
    return sets


MESSAGE = "bucket int, x long, ys binary, tokens binary"
#: Words of a set's parity sketch: bit i says whether an odd number of tokens falls to it, so two sets differ in as many tokens at least as their sketches in bits.
SKETCH = 8
VERIFIED = "x long, y long, common long, size_x long, size_y long, extras binary, lost binary, " + ", ".join(f"p{i} long" for i in range(SKETCH))


WANT = [("x", "<u8"), ("to", "<i4")]


def _wants(buckets: int):
    """(x, bucket) where x has candidates, once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, to = b.column(0).to_numpy(), _id_bucket(b.column(1).to_numpy().view(np.uint64), buckets)
            order = np.lexsort((to, x))
            at, _ = groups(x[order], to[order])
            yield pa.RecordBatch.from_arrays([pa.array(x[order][at]), pa.array(to[order][at], pa.int32())], names=["x", "to"])

    return run


def _want_blocks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Outbox(WANT, buckets)
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            yield from out.add(_id_bucket(x, buckets), x, b.column(1).to_numpy())
        yield from out.flush()

    return run


def _pair_messages(buckets: int):
    """The candidates (x, y) in y's bucket: a row for each x of a batch there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            to = _id_bucket(y, buckets)
            order = np.lexsort((x, to))
            x, y, to = x[order], y[order], to[order]
            at, n = groups(to, x)
            ys = [y[a : a + k].tobytes() for a, k in zip(at.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(to[at], pa.int32()), pa.array(x[at].view(np.int64)), pa.array(ys, pa.binary()), pa.array([None] * len(at), pa.binary())], names=["bucket", "x", "ys", "tokens"])

    return run


def _send(shingle: int):
    """The set of x to each bucket where it has candidates, once."""

    def run(home: pa.Table, blocks: pa.Table) -> pa.Table:
        want = opened(list(blocks.column("payload").combine_chunks()) if blocks.num_rows else [], WANT)
        sets = _texts_wanted(home, want["x"], shingle) if len(want["x"]) else {}
        tokens = [sets[x].tobytes() for x in want["x"].tolist()]
        return pa.table([pa.array(want["to"], pa.int32()), pa.array(want["x"].view(np.int64)), pa.array([None] * len(tokens), pa.binary()), pa.array(tokens, pa.binary())], names=["bucket", "x", "ys", "tokens"])

    return run


def parity(tokens: np.ndarray) -> list[int]:
    odd = np.bincount((tokens & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _verify(shingle: int):
    """Exact common tokens of each pair whose y lives in the bucket; extras, lost: 32 bits of each token that only y, only x has."""

    def run(home: pa.Table, messages: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if messages.num_rows:
            xs, ys, tokens_of = messages.column("x").to_pylist(), messages.column("ys").combine_chunks(), messages.column("tokens").combine_chunks()
            there = {x: t for x, t in zip(xs, tokens_of) if t.is_valid}
            asked = [(x, np.frombuffer(v.as_buffer(), np.uint64)) for x, v in zip(xs, ys) if v.is_valid]
            sets = _texts_wanted(home, np.concatenate([y for _, y in asked]), shingle) if asked else {}
            for x, mine in asked:
                tokens = there[x]
                a = np.frombuffer(tokens.as_buffer(), np.uint64)
                for y in mine:
                    b = sets[int(y)]
                    place = np.minimum(np.searchsorted(a, b), len(a) - 1)
                    both = a[place] == b
                    alone = np.ones(len(a), bool)
                    alone[place[both]] = False
                    rows.append((x, int(y.view(np.int64)), int(both.sum()), len(a), len(b), b[~both].astype(np.uint32).tobytes(), a[alone].astype(np.uint32).tobytes(), *parity(b)))
        cols = list(zip(*rows)) or [[]] * (7 + SKETCH)
        release()
        return pa.table([pa.array(c, pa.binary() if i in (5, 6) else pa.int64()) for i, c in enumerate(cols)], names=["x", "y", "common", "size_x", "size_y", "extras", "lost", *(f"p{i}" for i in range(SKETCH))])

    return run


#: Sets up to which the texts to verify are picked by a broadcast bitmap of their ids (8 bytes each).
BROADCAST_SETS = 4_000_000
#: Bits of that bitmap a key, and at least: of the other rows, 1 in 64 passes at most.
KEY_BITS, LEAST_BITS = 64, 1 << 22
#: Bits of a row of it, as bitmap_construct_agg() has them.
ROW_BITS = 32768
#: MB of tokens that a bucket verifies.
VERIFY_MB = 14


def picked(rows: DataFrame, keys: DataFrame, columns: list[str], n: int, how: str = "left_semi") -> DataFrame:
    """The rows whose values in some columns are among the n rows of keys, nulls too, and a few others; rows don't move.

    how: left_anti gives the other rows instead, none of which is among the keys.
    The driver gets a bitmap of hashes, not the keys and a hashed relation of them.
    """
    bits = -(-max(LEAST_BITS, KEY_BITS * n) // ROW_BITS) * ROW_BITS
    at = F.pmod(F.xxhash64(*columns), F.lit(bits)).alias("_at")
    maps = keys.select(at).withColumn("_part", F.bitmap_bucket_number("_at")).repartition("_part").groupBy("_part").agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    place = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = (F.bitmap_bucket_number("_at") == F.col("_part")) & (F.getbit(byte, (place % 8).cast("int")) == 1)
    return rows.select("*", at).join(F.broadcast(maps), there, how).drop("_at")


def verify_buckets(sets: int, tokens: int, pairs: int) -> int:
    """Buckets so that each holds about VERIFY_MB of the sets to verify (with so many tokens in all) and of what is sent to them.

    A set goes to every bucket where it has candidates: the fewer buckets, the fewer copies.
    """
    size = 8 * tokens + pairs * (512 + 8 * tokens // max(sets, 1))
    return max(1, min(MOST_BUCKETS, -(-size // (VERIFY_MB << 20)))) | 1


def verify_pairs(docs: DataFrame, sets: DataFrame, pairs: DataFrame, most: int, shingle: int) -> DataFrame:
    """Exact overlap of candidate pairs (x, y), as VERIFIED.

    Only texts that stand for a wanted set move, if a bitmap of their ids fits a
    broadcast; else every set's text moves once, to most buckets at least.
    """
    wanted = pairs.select(F.col("x").alias("set_id")).union(pairs.select("y")).distinct()
    reps = shared_checkpoint(sets.join(wanted, "set_id", "left_semi").select(F.col("smallest").alias("doc_id"), "n_shingles"))
    n_sets, tokens = reps.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    n = verify_buckets(n_sets, tokens, pairs.count())
    if n_sets <= BROADCAST_SETS:
        docs = picked(docs, reps, ["doc_id"], n_sets)
    else:
        n = max(n, most)
    home = docs.select("text").mapInArrow(_homes(shingle, n), "bucket int, set_id long, text string").repartition(n, "bucket")
    pairs = pairs.select("x", "y")
    wants = pairs.mapInArrow(_wants(n), "x long, to int").distinct().mapInArrow(_want_blocks(n), BLOCK).repartition(n, "bucket")
    sent = home.groupBy("bucket").cogroup(wants.groupBy("bucket")).applyInArrow(_send(shingle), MESSAGE)
    messages = sent.unionByName(pairs.mapInArrow(_pair_messages(n), MESSAGE)).repartition(n, "bucket")
    return shared_checkpoint(home.groupBy("bucket").cogroup(messages.groupBy("bucket")).applyInArrow(_verify(shingle), VERIFIED))


TOKENS = "center long, id long, token long, own int"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each token of (center, id, extras, and lost tokens if there is such a column), and how many the member has."""
    for b in batches:
        found = []
        for i in range(b.num_rows):
            kinds = [np.frombuffer(b.column(c)[i].as_buffer(), np.uint32).astype(np.int64) + ((c - 2) << 32) for c in range(2, b.num_columns)]
            found.append(np.unique(np.concatenate(kinds)))
        n = np.array([len(f) for f in found], np.int64)
        if n.sum():
            center, ids, own = (np.repeat(c, n) for c in (b.column(0).to_numpy(), b.column(1).to_numpy(), n))
            yield pa.RecordBatch.from_arrays([pa.array(center), pa.array(ids), pa.array(np.concatenate(found)), pa.array(own.astype(np.int32))], names=["center", "id", "token", "own"])


#: Linked members that an open member tries first.
TRIES = 8


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows of (center, id, ..) with the root of either one's component, as far as it is known."""
    for c in ("center", "id"):
        rows = rows.drop(f"root_{c}").join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
    return rows


def open_links(verified: DataFrame, linked: Column, percent: int, verify: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """Links (x, y) that connect members of large groups which do not link with the centre; None if there are none."""
    links = verified.where(linked).select("x", "y")
    stars = verified.select(F.col("x").alias("center"), F.col("y").alias("id"), F.col("size_y").alias("size"), F.col("size_x").alias("center_size"), (F.col("size_x") - F.col("common")).alias("lacks"), (F.col("size_y") - F.col("common")).alias("extra"), (1 - F.col("common") / (F.col("size_x") + F.col("size_y") - F.col("common"))).alias("d"), linked.alias("linked"))
    # the lists of tokens stay where they are: only numbers move through the joins with roots
    stars = shared_checkpoint(with_roots(stars, connected(links)))
    apart = F.col("root_center") != F.col("root_id")
    centers = shared_checkpoint(stars.where(apart).select("center").distinct())
    if centers.isEmpty():
        return None
    # a member is linked, from here on, if it is in the centre's component
    stars = stars.join(centers, "center", "left_semi").withColumn("linked", ~apart)
    # extra tokens that one member alone has; a hash that collides only makes them fewer
    differences = verified.select(F.col("x").alias("center"), F.col("y").alias("id"), "extras", "lost", *(f"p{i}" for i in range(SKETCH)))
    alone = picked(differences.select("center", "id", "extras"), centers, ["center"], centers.count()).mapInArrow(_tokens, TOKENS).groupBy("center", "token").agg(F.count("*").alias("n"), F.min("id").alias("id")).where(F.col("n") == 1)
    alone = alone.groupBy("center", "id").agg(F.count("*").alias("alone"))
    allowed = (100 - percent) / (100 + percent)
    members = stars.join(alone, ["center", "id"], "left").withColumn("cost", F.coalesce("alone", F.lit(0)) - allowed * F.col("size")).drop("alone")
    members = shared_checkpoint(members)
    free_shuffles(members.sparkSession)
    # the least cost for each number of lacking tokens (at most the centre's size of them), then a member's best fellows
    least = members.groupBy("center", "lacks", "linked").agg(F.min(F.struct("cost", "id")).alias("best"))
    # written, so that the join below stands on exchanges alone and a frequent centre can be split at run time
    profile = shared_checkpoint(least.groupBy("center").agg(F.collect_list(F.struct("lacks", "linked", F.col("best.cost").alias("cost"), F.col("best.id").alias("id"))).alias("profile")))
    fellows = F.array_sort(F.transform("profile", lambda p: F.struct((p["cost"] + F.abs(p["lacks"] - F.col("lacks"))).alias("cost"), p["id"].alias("id"), p["linked"].alias("linked"))))
    # what members with as many lacking tokens have in common is worked out once
    lacking = members.where(~F.col("linked")).select("center", "lacks").distinct().join(profile, "center").withColumn("fellows", fellows)
    tries = F.transform(F.slice(F.filter("fellows", lambda f: f["linked"]), 1, TRIES), lambda f: f["id"])
    lacking = shared_checkpoint(lacking.select("center", "lacks", F.col("fellows")[0]["cost"].alias("least"), tries.alias("tries")))
    is_open = shared_checkpoint(members.where(~F.col("linked")).join(lacking, ["center", "lacks"]).where(F.col("cost") + F.col("least") <= 1e-6).drop("least"))
    if is_open.isEmpty():
        return None
    joins = verify(shared_checkpoint(is_open.select(F.explode("tries").alias("x"), F.col("id").alias("y")).distinct())).where(linked).select("x", "y")
    is_open = is_open.drop("tries")
    roots = connected(links.unionByName(joins))
    is_open = shared_checkpoint(with_roots(is_open, roots))
    joins, is_open = recentred(is_open, joins, linked, verify)
    left = is_open.where(apart)
    if left.isEmpty():
        return joins
    fellows = with_roots(members.where("linked").join(left.select("center").distinct(), "center", "left_semi"), roots)
    every = shared_checkpoint(fellows.unionByName(is_open.join(left.select("center").distinct(), "center", "left_semi")).withColumn("left", apart))
    pairs = shared_checkpoint(by_differences(every, differences, percent))
    return joins if pairs.isEmpty() else joins.unionByName(verify(pairs).where(linked).select("x", "y"))


#: New centres that a group tries one after the other, as long as each joins half of what is left.
CENTERS = 6


def recentred(is_open: DataFrame, joins: DataFrame, linked: Column, verify: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """joins and the open members' roots after stars around new centres among the members that are left."""
    left = is_open.where(F.col("root_center") != F.col("root_id"))
    n = left.count()
    for _ in range(CENTERS):
        if n < 2:
            break
        # the nearest to the old centre
        heads = shared_checkpoint(left.groupBy("center").agg(F.min(F.struct("d", "id")).alias("head")).select("center", F.col("head.id").alias("x")))
        pairs = left.join(heads, "center").where(F.col("id") != F.col("x")).select("x", F.col("id").alias("y")).distinct()
        found = verify(shared_checkpoint(pairs)).where(linked).select("x", "y")
        joins = joins.unionByName(found)
        known = left.select("id", F.col("root_id").alias("root")).distinct()
        ends = found.join(known.toDF("x", "a"), "x").join(known.toDF("y", "b"), "y")
        moved = connected(ends.select(F.col("a").alias("x"), F.col("b").alias("y")))
        for c in ("root_center", "root_id"):
            is_open = is_open.join(moved.select(F.col("node").alias(c), F.col("root").alias("_new")), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
        # a member that shares its head's root needs no head of its own
        is_open = shared_checkpoint(is_open)
        heads_of = is_open.join(heads, (is_open["center"] == heads["center"]) & (is_open["id"] == heads["x"]), "left_semi").select("center", F.col("root_id").alias("_head_root"))
        done = left.select("center", "id").join(is_open.select("center", "id", "root_id"), ["center", "id"]).join(heads_of, "center").where(F.col("root_id") == F.col("_head_root"))
        left = shared_checkpoint(is_open.where(F.col("root_center") != F.col("root_id")).join(left.select("center", "id"), ["center", "id"], "left_semi").join(done.select("center", "id"), ["center", "id"], "left_anti"))
        now = left.count()
        if 2 * now > n:
            break
        n = now
    return joins, is_open


def by_differences(every: DataFrame, differences: DataFrame, percent: int) -> DataFrame:
    """Candidates (x, y): members left with fellows that share one of both sides' rarest differences from the centre.

    With D the number of a member's differences, tau the most that a link allows
    and r = tau / (size + size): a partner of x shares at least D_x - tau of its
    differences.  As x does not link with the centre c, D_x > r (|x| + |c|), so a
    partner y of any x shares over (D_y + r (|c| - |y|)) / 2 of its own.  A pair that
    meets also has to pass the other bounds on how many tokens differ.
    """
    r = (100 - percent) / (100 + percent)
    d = F.col("lacks") + F.col("extra")
    tau = F.floor((F.col("size") + F.floor(F.col("size") * 100 / percent)) * (100 - percent) / (100 + percent))
    shared_x = F.greatest(F.lit(1), d - tau)
    shared_y = F.greatest(F.lit(1), F.floor((d + r * (F.col("center_size") - F.col("size"))) / 2 - 1e-6) + 1)
    parities = [f"p{i}" for i in range(SKETCH)]
    traits = ["id", "root_id", "size", "lacks", "cost", "d", *parities]
    keys = every.select("center", "id")
    differences = shared_checkpoint(picked(differences, keys, ["center", "id"], keys.count()).join(keys, ["center", "id"], "left_semi"))
    prefixes = every.join(differences.select("center", "id", *parities), ["center", "id"]).select("center", *traits, "left", (d - shared_x + 1).alias("prefix_x"), (d - shared_y + 1).alias("prefix_y"))
    tokens = differences.select("center", "id", "extras", "lost").mapInArrow(_tokens, TOKENS)
    tokens = shared_checkpoint(tokens)
    counts = shared_checkpoint(tokens.groupBy("center", "token").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    member = Window.partitionBy("center", "id")
    ranked = tokens.join(counts, ["center", "token"]).withColumns({"rank": F.row_number().over(member.orderBy("n", "token")), "common": F.count("*").over(member)})
    # tokens that a member has alone come first, and meet nobody
    ranked = ranked.select("center", "id", "token", (F.col("own") - F.col("common") + F.col("rank")).alias("rank")).join(prefixes, ["center", "id"])
    ranked = shared_checkpoint(ranked.where(F.col("rank") <= F.greatest("prefix_x", "prefix_y")))
    free_shuffles(ranked.sparkSession)
    # both sides have the same rows and columns, so that these move once; which side a row may be on is told by bits
    sides = (F.col("left") & (F.col("rank") <= F.col("prefix_x"))).cast("int") + 2 * (F.col("rank") <= F.col("prefix_y")).cast("int") + 4 * F.col("left").cast("int")
    ranked = ranked.withColumn("sides", sides).where(F.col("sides").bitwiseAND(3) != 0)
    x, y = (ranked.select(*[F.col(c).alias(f"{c}_{e}") for c in ("center", "token", "sides", *traits)]) for e in "xy")
    roles = F.col("sides_x").bitwiseAND(F.shiftright("sides_y", 1)).bitwiseAND(1) == 1
    once = F.when(F.col("sides_y") >= 4, F.col("id_x") < F.col("id_y")).otherwise(F.col("id_x") != F.col("id_y"))
    bound = F.col("cost_x") + F.col("cost_y") + F.abs(F.col("lacks_x") - F.col("lacks_y")) <= 1e-6
    triangle = F.abs(F.col("d_x") - F.col("d_y")) <= 1 - percent / 100 + 1e-9
    bits = sum((F.bit_count(F.col(f"p{i}_x").bitwiseXOR(F.col(f"p{i}_y"))) for i in range(SKETCH)), F.lit(0))
    sketch = bits * (100 + percent) <= (F.col("size_x") + F.col("size_y")) * (100 - percent)
    fits = F.least("size_x", "size_y") * 100 >= F.greatest("size_x", "size_y") * percent
    met = x.join(y, (F.col("center_x") == F.col("center_y")) & (F.col("token_x") == F.col("token_y")) & roles & once & bound & triangle & sketch & fits & (F.col("root_id_x") != F.col("root_id_y")))
    return met.select(F.col("id_x").alias("x"), F.col("id_y").alias("y")).distinct()


def similar_components(docs: DataFrame, percent: int = 75, shingle: int = 5) -> DataFrame:
    """Components of the links with 100 * intersection >= percent * union.

    docs: doc_id long, text string.  Returns doc_id, n_shingles, set_id (equal
    sets share one; null without words), root (the same in all of a component;
    null without words) and component_id for each row.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100: below, partners may be two bands apart")
    small_batches(docs)
    n = parts(docs, 7)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    info = shared_checkpoint(docs.mapInArrow(_info(shingle, percent), INFO))
    firsts = [F.max(c).alias(c) for c in ("n_shingles", "lack0", "lack1")]
    sets = shared_checkpoint(info.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("copies"), *firsts))
    entries = deal(docs.select("text").mapInArrow(_entries(shingle, percent, n), BLOCK), n)
    headers = sets.select("set_id", "n_shingles", "lack0", "lack1").mapInArrow(_headers(n), BLOCK)
    shared = deal(entries.mapInArrow(_shared(n), BLOCK).unionByName(headers), n)
    probes = shared_checkpoint(shared.mapInArrow(_allocate(n), BLOCK))
    free_shuffles(docs.sparkSession)
    hot = probes.where(F.col("bucket") < 0).mapInArrow(_hot_rows, "key long, id long, rank long")
    stars = deal(probes.where(F.col("bucket") >= 0), n).mapInArrow(_star_pairs(percent), "x long, y long")
    stars = shared_checkpoint(stars.unionByName(hot_stars(hot)).distinct())
    verify = lambda pairs: verify_pairs(docs, sets, pairs, n, shingle)
    linked = F.col("common") * 100 >= (F.col("size_x") + F.col("size_y") - F.col("common")) * percent
    verified = verify(stars)
    free_shuffles(docs.sparkSession)
    links = verified.where(linked).select("x", "y")
    more = open_links(verified, linked, percent, verify)
    links = links if more is None else links.unionByName(more)
    roots = connected(links)
    rooted = sets.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    rooted = shared_checkpoint(rooted.select("set_id", "root", "smallest", "copies"))
    # a component may hold a third of all sets: large ones by a bounded broadcast
    smallest = shared_checkpoint(rooted.groupBy("root").agg(F.min("smallest").alias("component_id"), F.count("*").alias("members")))
    named = shared_checkpoint(join_hot(rooted, smallest, ["root"], "members", rooted.count()).select("set_id", "root", "component_id", "copies"))
    with_words = join_hot(info.where(F.col("set_id").isNotNull()), named, ["set_id"], "copies", info.count())
    without = info.where(F.col("set_id").isNull())
    columns = ("doc_id", "n_shingles", "set_id", "root", "component_id")
    return with_words.select(*columns).unionByName(without.withColumn("component_id", F.col("doc_id")).withColumn("root", F.col("set_id")).select(*columns))


def _with_sets(shingle: int, at: int):
    """Rows with the id of their set behind them, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                s = Sets(part.column(at), shingle)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s.ids.view(np.int64), mask=s.sizes == 0)], names=[*part.schema.names, "_set"])

    return run


def keep_one_of_each(docs: DataFrame, percent: int = 75, shingle: int = 5) -> DataFrame:
    """docs with all their columns, and of each component one document: the smallest doc_id's rows.

    A row without doc_id goes if its component has a named document; of a
    component without any, one row stays.  Rows whose ids can't be among those
    that go, by a bitmap, don't move.
    """
    members = shared_checkpoint(similar_components(docs, percent, shingle))
    named, names = docs.where(F.col("doc_id").isNotNull()), docs.columns
    first = F.max(F.col("doc_id") == F.col("component_id"))
    gone = members.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(first.alias("first")).where(~F.col("first")).select(F.col("doc_id").alias("_gone"))
    gone = shared_checkpoint(gone)
    left = lambda rows: rows.join(gone, rows["doc_id"].cast("long") == gone["_gone"], "left_anti").select(*names)
    if (n := gone.count()) <= BROADCAST_SETS:
        known = named.withColumn("_gone", F.col("doc_id").cast("long"))
        kept = picked(known, gone, ["_gone"], n, "left_anti").select(*names).unionByName(left(picked(known, gone, ["_gone"], n).select(*names)))
    else:
        kept = left(named)
    schema = StructType([*docs.schema.fields, StructField("_set", LongType())])
    nameless = docs.where(F.col("doc_id").isNull()).mapInArrow(_with_sets(shingle, names.index("text")), schema)
    one_set = members.where(F.col("component_id").isNull() & F.col("set_id").isNotNull()).groupBy("root").agg(F.min("set_id").alias("_set")).select("_set")
    one_row = nameless.join(one_set, "_set", "left_semi").groupBy("_set").agg(F.min_by(F.struct(*names), F.xxhash64("text")).alias("row")).select("row.*")
    return kept.unionByName(one_row).unionByName(nameless.where(F.col("_set").isNull()).select(*names))

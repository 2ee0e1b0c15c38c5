"""Connected components of a link table, by spanning forests, hooking and contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.shared import shared_checkpoint

#: Links up to which one task finishes the components (some 100 bytes each there).
ONE_TASK = 2_000_000
#: Links of a partition that are reduced to their spanning forest at a time.
HELD = 1 << 20

LINK, LABEL = "x long, y long", "node long, root long"


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, ascending, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # a root hooks to its smallest neighbour, if that is smaller
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect what a partition's links connect: one a node at most, of HELD links at a time."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            node, root = forest(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(root[node != root]), pa.array(node[node != root])], names=["x", "y"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= HELD:
            yield from flush()
    yield from flush()


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node's root, of all links at once."""
    held = list(batches)
    if held:
        node, root = forest(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (x, y): root is one node of its component.

    Every partition's links become a spanning forest; where few are left, one task
    finishes them, so that most calls are a few jobs.  Else every node hooks to its
    smallest neighbour, pointers jump, and the links between roots become the next,
    smaller table.  A frequent node costs a partial aggregate, never a list of its
    neighbours; joins stand on written tables, so that Spark can split a frequent
    key's rows at run time.
    """
    edges = shared_checkpoint(links.where(F.col("x") != F.col("y")).select("x", "y").mapInArrow(_forests, LINK))
    labels = None
    while edges.count() > ONE_TASK:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        hook = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("root")).withColumn("root", F.least("node", "root"))
        hook = shared_checkpoint(hook)
        # only a root that hooks elsewhere moves its nodes
        up = hook.where(F.col("node") != F.col("root")).select(F.col("node").alias("root"), F.col("root").alias("up"))
        hook = shared_checkpoint(hook.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        labels = hook if labels is None else _moved(labels, hook)
        ends = edges.join(hook.select(F.col("node").alias("x"), F.col("root").alias("a")), "x").join(hook.select(F.col("node").alias("y"), F.col("root").alias("b")), "y")
        edges = shared_checkpoint(ends.where(F.col("a") != F.col("b")).select(F.col("a").alias("x"), F.col("b").alias("y")).mapInArrow(_forests, LINK))
    last = shared_checkpoint(edges.coalesce(1).mapInArrow(_labels, LABEL))
    return last if labels is None else _moved(labels, last)


def _moved(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """labels whose roots have moved to those of roots."""
    up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
    return shared_checkpoint(labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")))

"""Selections: sets of drilled-into paths, and how toggle events change them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

SELECTION = "root_id string, key string"


def toggled(selected: frozenset[str], key: str) -> frozenset[str]:
    """The selection after one toggle of a path: removal takes descendants along; adding needs the parent."""
    if key in selected:
        return frozenset(k for k in selected if k != key and not k.startswith(f"{key}-"))
    parent = key.rpartition("-")[0]
    return selected | {key} if not parent or parent in selected else selected


def first_path(selected: frozenset[str]) -> list[str]:
    """Down from the root, always the first child in id order."""
    order = lambda s: (0, int(s), s) if s.isdigit() else (1, 0, s)
    path: list[str] = []
    while True:
        lead = "".join(f"{p}-" for p in path)
        below = [k[len(lead) :] for k in selected if k.startswith(lead)]
        below = [k for k in below if k and "-" not in k]
        if not below:
            return path
        path.append(min(below, key=order))


def selection_frame(spark: SparkSession, root_ids: list[str], keys: list[str]) -> DataFrame:
    return spark.createDataFrame([(r, k) for r in root_ids for k in sorted(keys)], SELECTION)


def selection_of(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The same paths selected under every root of a node table."""
    roots = nodes.where(F.col("level") == 0).select("root_id")
    return roots.withColumn("key", F.explode(F.array(*map(F.lit, sorted(keys)))))


class Selected:
    """A selection that changes in place: each change costs what it adds or removes."""

    def __init__(self):
        self.below: dict[str, set[str]] = {}
        self.keys: set[str] = set()

    def toggle(self, key: str) -> None:
        parent = key.rpartition("-")[0]
        if key in self.keys:
            todo = [key]
            while todo:
                k = todo.pop()
                self.keys.discard(k)
                todo += self.below.pop(k, ())
            self.below.get(parent, set()).discard(key)
        elif not parent or parent in self.keys:
            self.keys.add(key)
            self.below.setdefault(parent, set()).add(key)


def fold_toggles(events: DataFrame, session: str = "session", order: str = "seq", key: str = "key") -> DataFrame:
    """Each session's selection after its toggle events: session and key of every selected path.

    A fold that depends on its whole past is no built-in aggregate, so Spark sorts
    each session's events (and spills as it needs), and a pass over them holds one
    session's selected paths, never its events.  Null keys change nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, started = None, Selected(), False
        for pdf in batches:
            done: list[tuple] = []
            for who, k in zip(pdf["session"], pdf["key"]):
                if not started or who != now:
                    done += [(now, x) for x in sorted(state.keys)]
                    now, state, started = who, Selected(), True
                if k is not None:
                    state.toggle(k)
            if done:
                yield pd.DataFrame(done, columns=["session", "key"])
        if state.keys:
            yield pd.DataFrame([(now, x) for x in sorted(state.keys)], columns=["session", "key"])

    rows = events.select(F.col(session).cast("string").alias("session"), F.col(order).alias("_order"), F.col(key).alias("key"))
    ordered = rows.repartition("session").sortWithinPartitions("session", "_order", "key").select("session", "key")
    return ordered.mapInPandas(run, "session string, key string").select(F.col("session").alias(session), "key")


def last_highlight(events: DataFrame, session: str = "session", order: str = "seq", key: str = "key") -> DataFrame:
    """The path that each session points at last."""
    return events.groupBy(session).agg(F.max_by(key, order).alias("key"))


def first_paths(selection: DataFrame) -> DataFrame:
    """Each root's first path, one step per level down: root_id and key of its end.

    Going down the smallest ids ends at the selection's leaf whose list of
    numeric ids is the smallest, so this is one anti-join and one minimum.
    """
    steps = F.split("key", "-")
    rows = selection.withColumn("_ids", F.transform(steps, lambda s: s.try_cast("long")))
    # every key's proper ancestors are no leaves; a key has as many as it has steps
    up = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "-"))
    inner = selection.where(F.contains("key", F.lit("-"))).select("root_id", F.explode(up).alias("key")).distinct()
    leaf = rows.join(inner, ["root_id", "key"], "left_anti")
    return leaf.groupBy("root_id").agg(F.min_by("key", "_ids").alias("key"))

"""Point, label and as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..model import IGNORED_BASELINES, UNKNOWN, QuerySpec


def node_at(nodes: DataFrame, root_id: str, path: list[str]) -> DataFrame:
    """The node at a path, no row if a step is missing."""
    return nodes.where((F.col("root_id") == root_id) & (F.col("level") == len(path)) & (F.array_join("path", "-") == "-".join(path)))


def by_name(labels: DataFrame, kind: str, name: str) -> DataFrame:
    """The first entity of a kind, in id order, with exactly this name."""
    found = labels.where((F.col("entity_type") == kind) & (F.col("name") == name))
    return found.orderBy(F.col("id").try_cast("long").asc_nulls_last(), "id").limit(1)


def with_names(rows: DataFrame, labels: DataFrame, kind: str | Column, id_column: str = "child_id") -> DataFrame:
    """rows with the label's name, Unknown where there is none."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    names = labels.select(F.col("entity_type").alias("_kind"), F.col("id").alias("_id"), "name")
    return rows.join(names, (names["_id"] == rows[id_column]) & (names["_kind"] == kind), "left").drop("_kind", "_id").withColumn("name", F.coalesce("name", F.lit(UNKNOWN)))


#: Frames that an as-of lookup takes: they travel as one array with every task.
MOST_FRAMES = 10_000


def next_frame(points: DataFrame, frames: DataFrame, at: str = "i") -> DataFrame:
    """Each point with the first frame at or after it, else the last frame.

    frames (frame, payload) is a short list by nature, and counted before use: it
    becomes one array, and every point is a projection over it, without a join on
    ranges.  More than MOST_FRAMES are refused.
    """
    if frames.limit(MOST_FRAMES + 1).count() > MOST_FRAMES:
        raise ValueError(f"over {MOST_FRAMES} frames")
    held = frames.agg(F.array_sort(F.collect_list(F.struct("frame", "payload"))).alias("_frames"))
    rows = points.crossJoin(F.broadcast(held))
    first = F.get(F.filter("_frames", lambda f: f["frame"] >= F.col(at)), F.lit(0))
    return rows.withColumn("_f", F.coalesce(first, F.element_at("_frames", -1))).select(*points.columns, "_f.frame", "_f.payload")


def available_baselines(catalog: DataFrame, spec: QuerySpec, level: int, ignored: tuple[str, ...] = IGNORED_BASELINES) -> DataFrame:
    """Catalog rows whose target is the level's kind, with their stored name, without ignored ones."""
    named = catalog.withColumn("name", F.concat_ws("-", F.lower(F.substring("root_type", 1, 1)), "target", "basis", "hierarchy"))
    kept = named.where(F.col("target") == spec.kind_of(level))
    return kept.where(~F.col("name").isin(*ignored)) if ignored else kept


def collapsed_filters(spec: QuerySpec, length: int) -> list[int]:
    """Levels of a path that name a filter: the last of each run of one resolver."""
    ids = [x.resolver_id for x in spec.levels[:length]]
    return [i + 1 for i in range(length) if i + 1 == length or ids[i] != ids[i + 1]]

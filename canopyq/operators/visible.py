"""The visible part of a tree: balanced top-N by level, then ranks, offsets and scales.

All roots in the input are derived at once; root_id is part of every key, so
nothing here runs on one partition only because one query asks for one root.
With a selection, each level (at most limit_n rows a root) is written to the
shared folder before the next one reads it, so the plan stays short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..model import UNKNOWN, Control, QuerySpec
from ..sources.shared import shared_checkpoint
from .rollup import keyed


def quotas(counts: Column, parents: Column, remaining: Column) -> Column:
    """Fill quotas of a root's parents 1, 2, ..: unused quota flows on to later parents.

    counts: array of (ord, n) of the parents that have candidates; the others
    have none but take their turn.  A root shows at most limit_n parents, so the
    recurrence is one aggregate() over a tiny list.
    """

    def step(a: Column, k: Column) -> Column:
        own = F.coalesce(F.get(F.filter(counts, lambda c: c["ord"] == k), F.lit(0))["n"], F.lit(0))
        quota = F.floor(a["rem"] / (parents - k + 1) + F.lit(0.5)).cast("long")
        return F.struct((a["rem"] - F.least(quota, own.cast("long"))).alias("rem"), F.concat(a["out"], F.array(quota)).alias("out"))

    start = F.struct(remaining.cast("long").alias("rem"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), parents), start, step, lambda a: a["out"])


def visible_level(rows: DataFrame, control: Control, keys: DataFrame | None) -> DataFrame:
    """The candidates of one level that are shown, with is_selected.

    rows: children of the chosen parents, with root_id, key, child_id, id_num,
    ord and parents (the parent's place from 1, and how many there are) and
    derived (the size to rank by).  keys: root_id and key of selected nodes.
    Excluded ids never show; then selected children, then included ones, then
    each parent's best others.  After the cut to limit_n a parent, at most
    parents * limit_n rows a root go on.
    """
    if keys is not None:
        rows = rows.join(keys.select("root_id", "key", F.lit(True).alias("is_selected")), ["root_id", "key"], "left").withColumn("is_selected", F.coalesce("is_selected", F.lit(False)))
    else:
        rows = rows.withColumn("is_selected", F.lit(False))
    if control.limit_n <= 0:
        return rows.where(F.lit(False)).drop("ord", "parents")
    if control.exclude:
        rows = rows.where(~F.col("child_id").isin(*control.exclude))
    place = F.array_position(F.array(*map(F.lit, control.include)).cast("array<string>"), F.col("child_id"))
    rows = rows.withColumn("_block", F.when(F.col("is_selected"), 0).when(place > 0, 1).otherwise(2)).withColumn("_forced", F.col("_block") < 2)
    by_id = [F.col("id_num").asc_nulls_last(), F.col("child_id")]
    size = F.col("derived").desc() if control.show_top else F.col("derived").asc()
    best = Window.partitionBy("root_id", "ord").orderBy(size, *by_id)
    first = Window.partitionBy("root_id").orderBy("_block", F.when(F.col("_block") == 1, place).otherwise(F.lit(0)), "ord", *by_id)
    # each side's filter is on its rank alone, so Spark cuts every group before it is shuffled
    free = (rows.where(~F.col("_forced")) if keys is not None or control.include else rows).withColumn("_best", F.row_number().over(best)).where(F.col("_best") <= control.limit_n)
    if keys is not None or control.include:
        forced = rows.where("_forced").withColumn("_first", F.row_number().over(first)).where(F.col("_first") <= control.limit_n).drop("_first")
        rows = free.unionByName(forced.withColumn("_best", F.lit(0)))
    else:
        rows = free
    root, parent = Window.partitionBy("root_id"), Window.partitionBy("root_id", "ord")
    rows = rows.withColumn("_n", F.count(F.when(~F.col("_forced"), 1)).over(parent))
    rows = rows.withColumn("_counts", F.collect_set(F.struct("ord", F.col("_n").alias("n"))).over(root)).withColumn("_taken", F.count(F.when(F.col("_forced"), 1)).over(root))
    quota = F.get(quotas(F.col("_counts"), F.col("parents"), F.lit(control.limit_n) - F.col("_taken")), F.col("ord") - 1)
    return rows.where(F.col("_forced") | (F.col("_best") <= quota)).drop("_block", "_forced", "_best", "_n", "_counts", "_taken", "ord", "parents")


def embed_level(shown: DataFrame) -> DataFrame:
    """Ranks, running offsets and interval scales of a level's shown nodes, which carry their parent's rank and scale.

    Order: parents' rank, then derived size ascending (top or bottom alike),
    then child id descending as text.
    """
    size = [F.col("derived").asc(), F.col("child_id").desc()]
    level, siblings = Window.partitionBy("root_id").orderBy("_rank", *size), Window.partitionBy("root_id", "parent_key").orderBy(*size)
    before = lambda w: F.coalesce(F.sum("derived").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = shown.withColumns({"level_rank": F.row_number().over(level) - 1, "level_offset": before(level), "sibling_rank": F.row_number().over(siblings) - 1, "sibling_offset": before(siblings), "_n": F.count("*").over(Window.partitionBy("root_id", "parent_key"))})
    step = (F.col("_max") - F.col("_min")) / F.col("_n")
    rows = rows.withColumn("scale_min", F.col("_min") + F.col("sibling_rank") * step).withColumn("scale_max", F.col("_min") + (F.col("sibling_rank") + 1) * step)
    return rows.withColumn("scale_mid", (F.col("scale_min") + F.col("scale_max")) / 2).drop("_rank", "_min", "_max", "_n")


OUT = ("root_id", "level", "key", "parent_key", "child_id", "name", "weight", "children_sum_weight", "level_rank", "level_offset", "sibling_rank", "sibling_offset", "is_selected", "scale_min", "scale_max", "scale_mid", "spec_raw", "spec_norm")


def visible_tree(nodes: DataFrame, spec: QuerySpec, controls: list[Control], selection: DataFrame | None = None, labels: DataFrame | None = None, sizes: dict[int, DataFrame] | None = None) -> DataFrame:
    """Every visible node of each root with its layout attributes, root included.

    selection: root_id and key (path ids joined by '-') of drilled-into nodes,
    prefix-closed.  sizes: by level, root_id, key and spec_metric, for levels
    whose control sizes by specialization.  A level shows only under selected
    nodes that are themselves visible.
    """
    nodes = keyed(nodes).withColumn("weight", F.col("weight").cast("double")).select("root_id", "level", "key", "parent_key", "child_id", "id_num", "path", "weight")
    if selection is not None or controls[0].include:
        # the node table is read again: from the shared folder, not from the facts
        nodes = shared_checkpoint(nodes)
    zero = F.lit(0.0)
    root = nodes.where(F.col("level") == 0).withColumns({"derived": F.col("weight"), "is_selected": F.lit(True), "level_rank": F.lit(0), "level_offset": zero, "sibling_rank": F.lit(0), "sibling_offset": zero, "scale_min": zero, "scale_max": F.lit(1.0), "scale_mid": F.lit(0.5), "spec_raw": zero, "name": F.lit("")})
    columns = [c for c in OUT if c not in ("children_sum_weight", "spec_norm")] + ["path", "derived"]
    levels = [root.select(columns)]
    keys = None if selection is None else selection.select("root_id", "key")
    for i, control in enumerate(controls):
        by_ids = Window.partitionBy("root_id").orderBy(F.transform("path", lambda s: s.try_cast("long")), "path")
        parents = levels[-1].where("is_selected").select("root_id", F.col("key").alias("parent_key"), F.row_number().over(by_ids).alias("ord"), F.count("*").over(Window.partitionBy("root_id")).cast("int").alias("parents"), F.col("level_rank").alias("_rank"), F.col("scale_min").alias("_min"), F.col("scale_max").alias("_max"))
        rows = nodes.where(F.col("level") == i + 1).join(parents, ["root_id", "parent_key"])
        if control.size_base == "specialization":
            rows = rows.join(sizes[i + 1].select("root_id", "key", F.col("spec_metric").alias("derived")), ["root_id", "key"]).withColumn("spec_raw", F.col("weight"))
        else:
            rows = rows.withColumn("derived", F.col("weight")).withColumn("spec_raw", zero)
        rows = embed_level(visible_level(rows, control, keys))
        if labels is None:
            rows = rows.withColumn("name", F.lit(UNKNOWN))
        else:
            names = labels.where(F.col("entity_type") == spec.kinds[i]).select(F.col("id").alias("child_id"), "name")
            rows = rows.join(names, "child_id", "left").withColumn("name", F.coalesce("name", F.lit(UNKNOWN)))
        rows = rows.select(columns)
        levels.append(shared_checkpoint(rows) if selection is not None and i + 1 < len(controls) else rows)
        if selection is None:
            break
    out = levels[0]
    for rows in levels[1:]:
        out = out.unionByName(rows)
    below = out.where(F.col("level") > 0).groupBy("root_id", F.col("parent_key").alias("key")).agg(F.sum("derived").alias("children_sum_weight"))
    out = out.join(below, ["root_id", "key"], "left")
    return out.withColumns({"weight": F.col("derived"), "spec_norm": zero, "children_sum_weight": F.coalesce("children_sum_weight", zero)}).select(*OUT)


def level_meta(visible: DataFrame) -> DataFrame:
    """Total weight and number of nodes of each visible level."""
    return visible.groupBy("root_id", "level").agg(F.sum("weight").alias("total_weight"), F.count("*").alias("total_nodes"))

"""Geometry as projections: bands, offsets, ribbons, shares, series and the treemap."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

TILE = "parent string, child_id string, x double, y double, width double, height double"


def level_bands(levels: DataFrame, height: float, expanded: int | None = None) -> DataFrame:
    """level, total_size and top_offset of each level: equal steps, or half steps and one wide level.

    levels: level (0 to n - 1).
    """
    rows = levels.withColumn("_n", F.count("*").over(Window.partitionBy()))
    step = F.lit(float(height)) / F.col("_n")
    if expanded is None:
        size = step
    else:
        size = F.when(F.col("level") == expanded, F.lit(height / 2) + step / 2).otherwise(step / 2)
    rows = rows.withColumn("total_size", size)
    before = Window.partitionBy().orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("top_offset", F.coalesce(F.sum("total_size").over(before), F.lit(0.0))).drop("_n")


def offset_and_width(base: float, divisible: float, margin: float, start: Column, rank: Column, before: Column, weight: Column, total: Column) -> tuple[Column, Column]:
    """Left edge and width of a node: a fixed base each, the rest by weight."""
    width = F.lit(base) + F.lit(divisible) * weight / total
    return start + rank * F.lit(base + margin) + F.lit(divisible) * before / total, width


def ribbon_path(x0: Column, x1: Column, w0: Column, w1: Column, y0: Column, y1: Column) -> Column:
    """A flow ribbon between two horizontal edges as path text."""
    mid = (y0 + y1) / 2
    point = lambda x, y: F.concat(F.format_string("%.2f", x), F.lit(","), F.format_string("%.2f", y))
    curve = lambda a, b, c, d: F.concat(F.lit(" C"), point(a, mid), F.lit(" "), point(c, mid), F.lit(" "), point(c, d))
    return F.concat(F.lit("M"), point(x0, y0), curve(x0, y0, x1, y1), F.lit(" L"), point(x1 + w1, y1), curve(x1 + w1, y1, x0 + w0, y0), F.lit(" Z"))


def link_budget(width: Column, margin: float, surface: float, children: Column) -> tuple[Column, Column, Column]:
    """What a node's links to its children divide: the width inside the margins, the gap between links, a link's least width."""
    inside = width - F.lit(2.0 * margin)
    gap = inside * F.lit(1 - surface) / F.greatest(children - 1, F.lit(1))
    return inside, gap, inside * F.lit(surface) / (children * F.lit(1.8))


def child_links(rows: DataFrame, tree: dict[str, float], sizes: dict[str, float]) -> DataFrame:
    """Each child's place on its level, its link's place on the parent, and the ribbon between them.

    rows: a level's visible nodes with parent_x, parent_width, children (siblings),
    level_nodes, level_weight, siblings_weight beside visible_tree()'s columns.
    tree: x, width, base (a child's least width), margin (between children).
    sizes: side (the parent's margin), surface (share of its width that links take),
    top and bottom (the ribbon's ends).
    """
    inside, gap, least = link_budget(F.col("parent_width"), sizes["side"], sizes["surface"], F.col("children"))
    divisible = F.lit(tree["width"]) - F.lit(tree["base"]) * F.col("level_nodes") - F.lit(tree["margin"]) * (F.col("level_nodes") - 1)
    share = lambda part, whole: part / F.when(whole == 0, F.lit(1.0)).otherwise(whole)
    x = F.lit(tree["x"]) + F.col("level_rank") * F.lit(tree["base"] + tree["margin"]) + divisible * share(F.col("level_offset"), F.col("level_weight"))
    width = F.lit(tree["base"]) + divisible * share(F.col("weight"), F.col("level_weight"))
    room = inside * F.when(F.col("children") > 1, F.lit(sizes["surface"])).otherwise(F.lit(1.0)) - least * F.col("children")
    link_x = F.col("parent_x") + F.lit(sizes["side"]) + F.col("sibling_rank") * (least + gap) + room * share(F.col("sibling_offset"), F.col("siblings_weight"))
    link_width = least + room * share(F.col("weight"), F.col("siblings_weight"))
    rows = rows.withColumns({"x": x, "width": width, "link_x": link_x, "link_width": link_width})
    ribbon = ribbon_path(F.col("link_x"), F.col("x"), F.col("link_width"), F.col("width"), F.lit(sizes["top"]), F.lit(sizes["bottom"]))
    return rows.withColumn("link_path", ribbon)


def shares(rows: DataFrame, by: list[str], weight: str = "weight") -> DataFrame:
    """Each row's share of its group's weight and the shares before it, in id order."""
    group = Window.partitionBy(*by)
    order = group.orderBy(F.col("child_id").try_cast("long"), "child_id").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(weight).over(group)
    return rows.withColumn("share", F.col(weight) / total).withColumn("share_before", F.coalesce(F.sum(weight).over(order), F.lit(0)) / total)


def series_points(rows: DataFrame, values: str) -> DataFrame:
    """An array of values as points (i / n, 1 - value / largest) of a polyline."""
    top = F.array_max(values)
    n = F.size(values)
    return rows.withColumn("points", F.transform(values, lambda v, i: F.struct((i / n).alias("x"), (1 - v / top).alias("y"))))


def treemap(ids: list[str], weights: list[float], width: float, height: float, pad: float = 0.0) -> list[tuple[str, float, float, float, float]]:
    """(id, x, y, width, height) of tiles by binary splits on alternating axes; tiles without area are left out.

    The first part takes children until it holds over half of the weight, two
    at least if there are three or more, and leaves one at least.
    """
    tiles = []
    todo = [(0, len(ids), 0.0, 0.0, width, height, True)]
    while todo:
        lo, hi, x, y, w, h, along = todo.pop()
        if hi - lo == 1:
            if min(w - pad, h - pad) > 0:
                tiles.append((ids[lo], x + pad, y + pad, w - pad, h - pad))
            continue
        if hi == lo:
            continue
        total = sum(weights[lo:hi])
        cut, held = lo + 1, weights[lo]
        while cut < hi - 1:
            held += weights[cut]
            cut += 1
            if held > total / 2:
                break
        part = held / total if total else 0.0
        if along:
            todo += [(cut, hi, x + w * part, y, w - w * part, h, False), (lo, cut, x, y, w * part, h, False)]
        else:
            todo += [(cut, hi, x, y + h * part, w, h - h * part, True), (lo, cut, x, y, w, h * part, True)]
    return tiles


def treemap_tiles(rows: DataFrame, width: float = 100.0, height: float = 100.0, pad: float = 0.0) -> DataFrame:
    """Tiles of each parent's children (parent, child_id, weight), laid out in id order; sequential within one parent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_n=pd.to_numeric(pdf["child_id"], errors="coerce")).sort_values(["_n", "child_id"])
        tiles = treemap(pdf["child_id"].tolist(), pdf["weight"].astype(float).tolist(), width, height, pad)
        return pd.DataFrame([(pdf["parent"].iloc[0], *t) for t in tiles], columns=["parent", "child_id", "x", "y", "width", "height"])

    return rows.select("parent", "child_id", "weight").groupBy("parent").applyInPandas(run, TILE)


def frame_grid(spark: SparkSession, frames: list[int], names: list[str]) -> DataFrame:
    """Every frame with every name and the stage that the frame shows: two short constant lists."""
    left = spark.createDataFrame([(f,) for f in frames], "frame int")
    right = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, name string")
    stage = F.when(F.col("frame") < 3, "title").when(F.col("frame") < 8, F.concat(F.lit("row "), F.col("place").cast("string"))).otherwise("end")
    return left.crossJoin(right).withColumn("stage", stage)

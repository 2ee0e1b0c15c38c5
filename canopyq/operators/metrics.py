"""Smoothed revealed comparative advantage, volume reports and their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..model import GLOBAL, Basis, QuerySpec, basis_field
from .rollup import keyed


def spec_metric(nodes: DataFrame, spec: QuerySpec, level: int, basis: Basis = Basis(), baseline: DataFrame | None = None, root_meta: DataFrame | None = None) -> DataFrame:
    """Nodes of a level with node_rate, node_divisor, baseline_rate and spec_metric.

    baseline: the long table's rows of this target, basis and hierarchy; None:
    the table is missing, so the node's own rate is its baseline and the metric
    1.  root_meta: root_id and meta (a map), needed unless basis is Global.  A
    key that the baseline lacks has rate 0.  Smoothing adds one over the number
    of siblings in the complete tree to both rates.

    Ancestors are found by level, which a spec fixes, so there is no recursion
    and one join at most for the divisor.
    """
    nodes = keyed(nodes)
    here = nodes.where(F.col("level") == level).withColumn("siblings", F.count("*").over(Window.partitionBy("root_id", "parent_key")))
    above = None
    # a missing table leaves the divisor at the root
    if baseline is not None:
        above = spec.hierarchy_level(basis.hierarchy, level) if basis.hierarchy != GLOBAL else None
    divisor_level = 0 if baseline is None else above if above is not None else spec.divisor_level(level) if basis.hierarchy == GLOBAL else 0
    wholes = nodes.where(F.col("level") == divisor_level).select("root_id", F.col("key").alias("_whole"), F.col("weight").alias("node_divisor"))
    if divisor_level:
        here = here.withColumn("_whole", F.array_join(F.slice("path", 1, divisor_level), "-")).join(wholes, ["root_id", "_whole"]).drop("_whole")
    else:
        here = here.join(wholes.drop("_whole"), "root_id")
    rate = F.coalesce(F.col("weight"), F.lit(0)).cast("double") / F.col("node_divisor")
    here = here.withColumn("node_rate", rate)
    if baseline is None:
        return here.withColumns({"baseline_rate": F.col("node_rate"), "spec_metric": F.lit(1.0)})
    rates = baseline.select(F.col("basis_id").alias("_b"), F.col("parent_id").alias("_p"), F.col("child_id").alias("_c"), F.col("rate").alias("_rate"))
    same = here["child_id"] == rates["_c"]
    if basis.basis != GLOBAL:
        roots = root_meta.select("root_id", F.col("meta")[basis_field(basis.basis)].alias("_basis_id"))
        here = here.join(roots, "root_id", "left")
        same = (here["child_id"] == rates["_c"]) & here["_basis_id"].eqNullSafe(rates["_b"])
    if above:
        here = here.withColumn("_parent_id", F.get("path", above - 1))
        same = same & here["_parent_id"].eqNullSafe(rates["_p"])
    met = here.join(rates, same, "left")
    eps = 1 / F.col("siblings")
    met = met.withColumn("baseline_rate", F.coalesce("_rate", F.lit(0.0)))
    return met.withColumn("spec_metric", (F.col("node_rate") + eps) / (F.col("baseline_rate") + eps)).drop("_basis_id", "_parent_id", "_b", "_p", "_c", "_rate")


def level_word(rate: Column) -> Column:
    """High above 1.2, Low below 0.75, else Average."""
    return F.when(rate > 1.2, "High").when(rate < 0.75, "Low").otherwise("Average")


def volume_report(nodes: DataFrame, level: int) -> DataFrame:
    """Each node's weight against its parent's weight over the number of its children in the complete tree."""
    nodes = keyed(nodes)
    parent = nodes.where(F.col("level") == level - 1).select("root_id", F.col("key").alias("parent_key"), F.col("weight").alias("parent_weight"))
    here = nodes.where(F.col("level") == level).withColumn("siblings", F.count("*").over(Window.partitionBy("root_id", "parent_key")))
    here = here.join(parent, ["root_id", "parent_key"])
    here = here.withColumn("comparison", F.try_divide(F.col("parent_weight").cast("double"), F.col("siblings")))
    here = here.withColumn("rate", F.try_divide(F.col("weight").cast("double"), F.col("comparison")))
    return here.withColumn("description", level_word(F.col("rate")))

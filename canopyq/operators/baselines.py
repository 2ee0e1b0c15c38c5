"""Reference-group baselines in their four shapes, as one long table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..model import GLOBAL, Basis, QuerySpec


def build_baseline(nodes: DataFrame, spec: QuerySpec, level: int, basis: Basis, root_basis: DataFrame | None = None) -> DataFrame:
    """Rates of the level's ids: root_type, target, basis, hierarchy, basis_id, parent_id, child_id, rate.

    nodes: all roots' nodes.  root_basis: root_id and basis_id, needed unless
    basis is Global.  A rate is the ids' weight over that of the whole
    (hierarchy Global) or of the ancestor of the hierarchy's kind.
    """
    above = 0
    if basis.hierarchy != GLOBAL:
        above = spec.hierarchy_level(basis.hierarchy, level)
        if above is None:
            raise ValueError(f"no {basis.hierarchy} above level {level} of {spec.spec_id}")
    if basis.basis != GLOBAL:
        nodes = nodes.join(root_basis.select("root_id", "basis_id"), "root_id")
    else:
        nodes = nodes.withColumn("basis_id", F.lit(None).cast("string"))
    parent = F.get("path", above - 1) if above else F.lit(None).cast("string")
    two = nodes.where(F.col("level").isin(level, above))
    # the parts and their wholes in one aggregation each, then one join on the wholes' few keys
    part = two.where(F.col("level") == level).groupBy("basis_id", parent.alias("parent_id"), "child_id").agg(F.sum("weight").alias("w"))
    wholes, total = two.where(F.col("level") == above), F.sum("weight").alias("t")
    keys = [k for k, varies in (("basis_id", basis.basis != GLOBAL), ("parent_id", above > 0)) if varies]
    if keys:
        whole = wholes.groupBy(F.col("basis_id").alias("_basis_id"), parent.alias("_parent_id")).agg(total)
        same = [part[k].eqNullSafe(whole[f"_{k}"]) for k in keys]
        met = part.join(whole, same[0] if len(same) == 1 else same[0] & same[1])
    else:
        met = part.crossJoin(F.broadcast(wholes.agg(total)))  # one row, always
    lit = lambda v, n: F.lit(v).alias(n)
    return met.select(lit(spec.root_kind, "root_type"), lit(spec.kinds[level - 1], "target"), lit(basis.basis, "basis"), lit(basis.hierarchy, "hierarchy"), "basis_id", "parent_id", "child_id", (F.col("w") / F.col("t")).alias("rate"))

"""The entry points: the explorer's view, the path profile and the root search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import GLOBAL, Basis, QuerySpec
from ..operators import lookup, metrics, rollup, search, selection, visible
from .commands import State, replay, start


def derive(spark: SparkSession, nodes: DataFrame, state: State, root_ids: list[str] | None = None, labels: DataFrame | None = None, baselines: DataFrame | None = None) -> DataFrame:
    """The visible tree of each root (all, if none are named) under a view's state; nodes: the spec's node table."""
    own = nodes if root_ids is None else nodes.where(F.col("root_id").isin(*root_ids))
    sizes = {}
    for i, control in enumerate(state.controls):
        if control.size_base == "specialization":
            sizes[i + 1] = metrics.spec_metric(own, state.spec, i + 1, Basis(), _of(baselines, state.spec, i + 1, Basis()))
    chosen = None
    if state.selection:
        chosen = selection.selection_of(own, list(state.selection)) if root_ids is None else selection.selection_frame(spark, root_ids, list(state.selection))
    return visible.visible_tree(own, state.spec, list(state.controls), chosen, labels, sizes)


def _of(baselines: DataFrame | None, spec: QuerySpec, level: int, basis: Basis) -> DataFrame | None:
    if baselines is None:
        return None
    same = (F.col("root_type") == spec.root_kind) & (F.col("target") == spec.kind_of(level)) & (F.col("basis") == basis.basis) & (F.col("hierarchy") == basis.hierarchy)
    return baselines.where(same)


def view(spark: SparkSession, nodes_of: dict[str, DataFrame], specs: dict[str, QuerySpec], spec_id: str, root_id: str, commands: str = "", labels: DataFrame | None = None, baselines: DataFrame | None = None) -> DataFrame:
    """The explorer: load a spec and a root, replay commands, derive."""
    state = replay(start(specs[spec_id]), commands, specs)
    return derive(spark, nodes_of[state.spec.spec_id], state, [root_id], labels, baselines)


def profile(nodes: DataFrame, spec: QuerySpec, root_id: str, path: list[str], labels: DataFrame, baselines: DataFrame | None = None, root_meta: DataFrame | None = None, bases: list[Basis] | None = None) -> dict[str, DataFrame]:
    """The path profile: nodes on the path, volume report, every basis's metric, and the path's filters."""
    level = len(path)
    spec.kind_of(level)
    own = nodes.where(F.col("root_id") == root_id)
    on_path = None
    for i in range(1, level + 1):
        step = lookup.with_names(lookup.node_at(own, root_id, path[:i]), labels, spec.kinds[i - 1])
        on_path = step if on_path is None else on_path.unionByName(step)
    this = F.array_join("path", "-") == "-".join(path)
    out = {"nodes": on_path, "volume": metrics.volume_report(own, level).where(this), "filters": on_path.where(F.col("level").isin(*lookup.collapsed_filters(spec, level)))}
    rows = None
    for basis in bases or [Basis()]:
        got = metrics.spec_metric(own, spec, level, basis, _of(baselines, spec, level, basis), root_meta).where(this)
        got = got.select(F.lit(basis.basis).alias("basis"), F.lit(basis.hierarchy).alias("hierarchy"), "root_id", "key", "node_rate", "node_divisor", "baseline_rate", "spec_metric", metrics.level_word(F.col("spec_metric")).alias("description"))
        rows = got if rows is None else rows.unionByName(got)
    return out | {"metrics": rows}


def find_roots(roots: DataFrame, term: str) -> DataFrame:
    """The landing page's search."""
    return search.search_roots(roots, term, 6)


__all__ = ["GLOBAL", "derive", "find_roots", "profile", "rollup", "view"]

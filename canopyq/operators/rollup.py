"""Prefix roll-ups of flow facts: the node table of a spec."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..model import QuerySpec


def build_nodes(facts: DataFrame, spec: QuerySpec, distinct: str | None = None) -> DataFrame:
    """spec_id, root_id, level, path, parent_path, child_id, id_num, weight.

    Facts are counted by leaf first, so the roll-up expands leaves, not facts.
    With distinct, weights count that column's distinct values, which do not add up.
    """
    cols = list(spec.columns)
    if distinct is None:
        leaves = facts.groupBy("root", *cols).agg(F.count("*").alias("n"))
        weight = F.sum("n")
    else:
        leaves = facts.select("root", *cols, distinct).distinct()
        weight = F.count_distinct(distinct)
    # grouping_id has a 1 bit for each rolled-up column: 2**(k - level) - 1
    rolled = leaves.rollup("root", *cols).agg(weight.cast("long").alias("weight"), F.grouping_id().alias("g"))
    level = F.lit(len(cols)) - F.bit_count("g").cast("int")
    steps = F.array(*[F.col(c).cast("string") for c in cols])
    nodes = rolled.withColumn("level", level).where(F.col("level") >= 0).withColumn("path", F.slice(steps, 1, F.col("level")))
    return nodes.select(
        F.lit(spec.spec_id).alias("spec_id"),
        F.col("root").cast("string").alias("root_id"),
        "level",
        "path",
        F.when(F.col("level") > 0, F.slice("path", 1, F.greatest(F.col("level") - 1, F.lit(0)))).alias("parent_path"),
        F.when(F.col("level") > 0, F.element_at("path", -1)).alias("child_id"),
        "weight",
    ).withColumn("id_num", F.col("child_id").try_cast("long"))


def keyed(nodes: DataFrame) -> DataFrame:
    """Nodes with text keys of their path and parent path: '-' between ids, '' for the root."""
    return nodes.withColumn("key", F.array_join("path", "-")).withColumn("parent_key", F.when(F.col("level") > 0, F.array_join("parent_path", "-")))


def corpus_stats(facts: DataFrame) -> DataFrame:
    """Counts of works, roots, citations and attribute values, in one pass."""
    return facts.agg(
        F.count_distinct("order_id").alias("works"), F.count_distinct("root").alias("roots"), F.count("*").alias("citations"),
        F.count_distinct("nation").alias("countries"), F.count_distinct("brand").alias("sub_concepts"), F.count_distinct("type").alias("concepts"),
    )


def frequent_roots(facts: DataFrame, least: int, since: int, priorities: tuple[str, ...]) -> DataFrame:
    """Roots with at least so many distinct works among the admitted facts; a work counts once a root."""
    kept = facts.where((F.col("year") >= since) & F.col("priority").isin(*priorities))
    works = kept.select("root", "order_id").distinct()
    return works.groupBy("root").agg(F.count("*").alias("works")).where(F.col("works") >= least)

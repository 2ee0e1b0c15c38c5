"""Substring search over attributes and over roots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import holds_all, plain, plain_text, terms


def search_attributes(labels: DataFrame, term: str, limit: int = 4, show_all: bool = False) -> DataFrame:
    """The first entities, in id order, whose name holds every term; an empty term finds none unless show_all."""
    rows = labels.select("id", "name").withColumn("id_num", F.col("id").try_cast("long"))
    if not term and not show_all:
        return rows.limit(0)
    found = rows.where(holds_all(F.lower("name"), terms(term.lower())))
    return found.orderBy(F.col("id_num").asc_nulls_last(), "id").limit(limit)


def search_roots(roots: DataFrame, term: str, limit: int = 6) -> DataFrame:
    """The most cited roots whose plain name holds every plain term; missing counts are 0; ties by id."""
    meta = F.from_json("meta", "papers bigint, citations bigint")
    rows = roots.select("id", "name", F.coalesce(meta["papers"], F.lit(0)).alias("papers"), F.coalesce(meta["citations"], F.lit(0)).alias("citations"))
    found = rows.where(holds_all(plain(F.col("name")), terms(plain_text(term))))
    return found.orderBy(F.desc("citations"), F.col("id").try_cast("long").asc_nulls_last(), "id").limit(limit)

"""What plans must and must not hold."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from canopyq import queries
from canopyq.functions import text
from canopyq.operators import lookup, selection


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["path_profile_all_bases", "visible_by_specialization", "rca_global", "rca_basis_hierarchy", "baseline_gg", "baseline_bh"])
def test_no_cartesian_product(spark, small, name):
    assert "CartesianProduct" not in plan(queries.QUERIES[name](spark, small))


@pytest.mark.parametrize("name", ["path_profile_all_bases", "visible_by_specialization", "rca_basis_hierarchy"])
def test_facts_are_scanned_once(spark, small, name):
    """The node table is written once; what follows reads it."""
    assert "l_suppkey" not in plan(queries.QUERIES[name](spark, small))


@pytest.mark.parametrize("name", ["visible_l1_top", "visible_l1_bottom", "visible_all_roots"])
def test_levels_are_cut_before_the_shuffle(spark, small, name):
    assert "WindowGroupLimit" in plan(queries.QUERIES[name](spark, small))


def test_lines_read_four_columns(spark, small):
    read = [s for s in plan(queries.rollup_nodes_q1(spark, small)).split("ReadSchema: ")[1:] if "l_orderkey" in s.split(chr(10))[0]]
    assert read and all(s.split(chr(10))[0].count(":") <= 4 for s in read)


def test_folds_are_those_of_single_toggles(spark):
    rng = random.Random(4)
    keys = [str(a) for a in range(3)] + [f"{a}-{b}" for a in range(3) for b in range(3)] + [f"{a}-{b}-{c}" for a in range(3) for b in range(2) for c in range(2)]
    events = [(f"s{i % 5}", i, rng.choice(keys)) for i in range(1200)] + [(None, 1, "1"), ("s1", 5000, None)]
    want = {}
    for who, _, key in sorted((e for e in events if e[2]), key=lambda e: e[1]):
        want[who] = selection.toggled(want.get(who, frozenset()), key)
    got = {}
    for r in selection.fold_toggles(spark.createDataFrame(events, "session string, seq long, key string")).collect():
        got.setdefault(r["session"], set()).add(r["key"])
    assert got == {k: set(v) for k, v in want.items() if v}
    chosen = spark.createDataFrame([(k, x) for k, v in got.items() if k for x in v], "root_id string, key string")
    assert {r["root_id"]: r["key"] for r in selection.first_paths(chosen).collect()} == {k: "-".join(selection.first_path(frozenset(v))) for k, v in got.items() if k}


def test_too_many_frames_are_refused(spark, monkeypatch):
    monkeypatch.setattr(lookup, "MOST_FRAMES", 3)
    points, frames = spark.range(2).withColumnRenamed("id", "i"), spark.range(4).select(F.col("id").alias("frame"), F.lit("x").alias("payload"))
    with pytest.raises(ValueError):
        lookup.next_frame(points, frames)


@pytest.mark.parametrize(("name", "want"), [("Московский университет", "moskovskii universitet"), ("Žižkov Ødegård", "zizkov odegard"), ("Ελλάδα", "ellada"), ("Αθήνα", "athena"), ("서울", "seoul"), ("とうきょう", "toukiyou"), ("Щука", "shchuka"), ("Ёж", "iozh"), ("Ünïversität Straße", "universitat strasse")])
def test_names_in_latin_letters(name, want):
    assert text.plain_text(name) == want


def test_fills_any_characters(spark):
    rows = spark.createDataFrame([("a$1", "x {pc_id}{PC_ID}"), ("b\\c", "{Pc_Id}"), ("$", "no")], "id string, t string")
    assert [r[0] for r in rows.select(text.filled(F.col("t"), F.col("id"))).collect()] == ["x a$1a$1", "b\\c", "no"]

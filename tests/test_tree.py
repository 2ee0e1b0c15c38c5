from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from canopyq.model import Basis, Control, Level, QuerySpec, baseline_name, fill_placeholder
from canopyq.operators import lookup, metrics, selection, visible

from .model import visible as model

SPEC = QuerySpec("t", "Institution", (Level("Country", "a"), Level("Concept", "a"), Level("SubConcept", "b")))
TREE = {(): 100, ("1",): 60, ("2",): 30, ("3",): 10, ("1", "11"): 30, ("1", "12"): 20, ("1", "13"): 10, ("2", "11"): 15, ("2", "14"): 15}


def frame(spark, tree, root="r"):
    rows = [("t", root, len(p), list(p), list(p[:-1]) if p else None, p[-1] if p else None, int(w), int(p[-1]) if p else None) for p, w in tree.items()]
    return spark.createDataFrame(rows, "spec_id string, root_id string, level int, path array<string>, parent_path array<string>, child_id string, weight long, id_num long")


def derive(spark, tree, controls, selected=()):
    keys = selection.selection_frame(spark, ["r"], ["-".join(p) for p in selected]) if selected else None
    rows = visible.visible_tree(frame(spark, tree), SPEC, controls, keys).collect()
    levels = {}
    for r in sorted(rows, key=lambda r: (r["level"], r["level_rank"])):
        levels.setdefault(r["level"], []).append(r)
    return levels


def keys(rows):
    return [r["key"] for r in rows]


@pytest.mark.parametrize(
    ("control", "want", "offsets"),
    [
        (Control(limit_n=2), ["2", "1"], [0, 30]),
        (Control(limit_n=2, show_top=False), ["3", "2"], [0, 10]),
        (Control(limit_n=2, exclude=("1",)), ["3", "2"], [0, 10]),
        (Control(limit_n=2, include=("3",)), ["3", "1"], [0, 10]),
        (Control(limit_n=1, include=("3",), exclude=("3",)), ["1"], [0]),
        (Control(limit_n=0), [], []),
    ],
)
def test_first_level(spark, control, want, offsets):
    got = derive(spark, TREE, [control]).get(1, [])
    assert keys(got) == want and [r["level_offset"] for r in got] == offsets


def test_two_selected(spark):
    got = derive(spark, TREE, [Control(limit_n=3), Control(limit_n=3)], [("1",), ("2",)])
    assert keys(got[1]) == ["3", "2", "1"] and [r["level_offset"] for r in got[1]] == [0, 10, 40]
    assert keys(got[2]) == ["2-11", "1-12", "1-11"] and [r["level_offset"] for r in got[2]] == [0, 15, 35]
    assert [(round(r["scale_min"], 6), round(r["scale_max"], 6)) for r in got[2]] == [(0.333333, 0.666667), (0.666667, 0.833333), (0.833333, 1.0)]
    assert got[1][2]["children_sum_weight"] == 50 and got[1][2]["is_selected"]


def test_budget_hit_by_selection(spark):
    got = derive(spark, TREE, [Control(limit_n=1), Control(limit_n=3)], [("1",), ("2",)])
    assert keys(got[1]) == ["1"] and keys(got[2]) == ["1-13", "1-12", "1-11"]


def test_leaf_selected(spark):
    assert 2 not in derive(spark, TREE, [Control(limit_n=3), Control(limit_n=3)], [("3",)])


@pytest.mark.parametrize(("counts", "left", "want"), [((1, 20, 20), 10, [3, 5, 4]), ((3, 2), 3, [2, 1]), ((0, 5), 4, [2, 4])])
def test_quotas_carry_over(spark, counts, left, want):
    given = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("n")) for i, n in enumerate(counts, 1) if n])
    assert spark.range(1).select(visible.quotas(given, F.lit(len(counts)), F.lit(left)).alias("q")).first()["q"] == want


@pytest.mark.parametrize("seed", range(6))
def test_random_trees(spark, seed):
    rng = random.Random(seed)
    tree = {(): 1000}
    for a in rng.sample(range(1, 40), 6):
        tree[(str(a),)] = rng.randint(1, 300)
        for b in rng.sample(range(1, 40), rng.randint(0, 8)):
            tree[str(a), str(b)] = rng.randint(1, 10**6)
            for c in rng.sample(range(1, 40), rng.randint(0, 4)):
                tree[str(a), str(b), str(c)] = rng.randint(1, 10**6)
    paths = [p for p in tree if p]
    picked = {q[:i] for q in rng.sample(paths, 5) for i in range(1, len(q) + 1)}
    every = sorted({p[-1] for p in paths})
    controls = [Control(limit_n=rng.randint(1, 8), show_top=rng.random() < 0.5, include=tuple(rng.sample(every, 2)), exclude=tuple(rng.sample(every, 2))) for _ in range(3)]
    want, got = model(tree, controls, picked), derive(spark, tree, controls, picked)
    for i, rows in enumerate(want[1:], 1):
        mine = got.get(i, [])
        assert keys(mine) == ["-".join(p) for p, _ in rows]
        for r, (_, w) in zip(mine, rows):
            assert (r["level_rank"], r["sibling_rank"]) == (w["rank"], w["sibling_rank"])
            assert (r["level_offset"], r["sibling_offset"]) == pytest.approx((w["offset"], w["sibling_offset"]))
            assert (r["scale_min"], r["scale_max"]) == pytest.approx((w["min"], w["max"]))
        assert len(mine) <= controls[i - 1].limit_n and not {r["child_id"] for r in mine} & set(controls[i - 1].exclude)


def metric(spark, basis, rates, tree=TREE, spec=SPEC, level=2, meta=None):
    base = None if rates is None else spark.createDataFrame(rates, "basis_id string, parent_id string, child_id string, rate double")
    rows = metrics.spec_metric(frame(spark, tree), spec, level, basis, base, meta).collect()
    return {r["key"]: r for r in rows}


def test_advantage(spark):
    r = metric(spark, Basis(), [(None, None, "11", 0.4)])["1-11"]
    assert r["node_rate"] == pytest.approx(0.3) and r["spec_metric"] == pytest.approx(19 / 22)
    assert metric(spark, Basis(), [(None, None, "99", 0.4)])["1-11"]["spec_metric"] == pytest.approx(1.9)
    r = metric(spark, Basis(), None)["1-11"]
    assert (r["node_rate"], r["baseline_rate"], r["spec_metric"]) == pytest.approx((0.3, 0.3, 1.0))
    r = metric(spark, Basis("Global", "Country"), [(None, "1", "11", 0.5)])["1-11"]
    assert (r["node_divisor"], r["spec_metric"]) == pytest.approx((60, 1.0))
    meta = spark.createDataFrame([("r", {"country__id": "7"})], "root_id string, meta map<string,string>")
    assert metric(spark, Basis("Country", "Global"), [("7", None, "11", 0.3), ("8", None, "11", 0.9)], meta=meta)["1-11"]["spec_metric"] == pytest.approx(1.0)


def test_divisor_of_the_roots_kind():
    inner = QuerySpec("x", "K", (Level("A", "a"), Level("K", "a"), Level("B", "b")))
    outer = QuerySpec("y", "K", (Level("K", "a"), Level("B", "b")))
    assert inner.divisor_level(3) == 2 and outer.divisor_level(2) == 0


def test_volume(spark):
    r = next(r for r in metrics.volume_report(frame(spark, TREE), 2).collect() if r["key"] == "1-11")
    assert (r["comparison"], r["rate"], r["description"]) == (20, 1.5, "High")


def test_collapsed_filters():
    spec = QuerySpec("z", "K", (Level("A", "r"), Level("B", "r"), Level("C", "s")))
    assert [lookup.collapsed_filters(spec, n) for n in (1, 2, 3)] == [[1], [2], [2, 3]]


def test_names_and_controls():
    assert baseline_name("Institution", "Concept", Basis("Country", "Global")) == "i-Concept-Country-Global"
    assert fill_placeholder("a {PC_ID} {pc_id}", "$1") == "a $1 $1"
    assert Control.merged('{"limit_n": 3, "include": [1, "2"], "odd": 1}') == Control(include=("1", "2"), limit_n=3)
    assert Control.merged("not json") == Control.merged(None) == Control()
    assert Control(include=("1", "2")).with_filter("include", "2").include == ("2", "1")
    assert Control(exclude=("1", "2")).without_filter("exclude", "2").exclude == ("1",)
    with pytest.raises(ValueError):
        SPEC.kind_of(4)

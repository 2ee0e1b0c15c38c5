from __future__ import annotations

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from canopyq.functions import numbers, text
from canopyq.model import Control
from canopyq.operators import layout, lookup, search, selection
from canopyq.plans import commands, explore
from canopyq.sources import star, store
from canopyq.sources.star import SPECS


@pytest.mark.parametrize(("x", "want"), [(0, "0.00"), (0.5, "0.50"), (1, "1.0"), (9.94, "9.9"), (10, "10"), (1000, "1000"), (1001, "1.0k"), (1150, "1.1k"), (1250, "1.3k"), (1000000, "1000.0k"), (18835495, "18.8M"), (-5, "-5.00"), (2.25, "2.3"), (None, None), (float("nan"), None)])
def test_short_number(x, want):
    assert numbers.short_number(x) == want


@pytest.mark.parametrize(("x", "digits", "want"), [(1.005, 2, "1.00"), (1.45, 1, "1.4"), (2.25, 1, "2.3"), (0.25, 1, "0.3"), (2.5, 0, "3")])
def test_fixed_text(x, digits, want):
    assert numbers.fixed_text(x, digits) == want


def test_columns(spark):
    c = F.col("v")
    r = spark.createDataFrame([(2.5, "a+b+c", 3)], "v double, s string, n int").select(
        numbers.half_up(c).alias("h"), numbers.half_up(-c).alias("m"), numbers.clamp(c, 0.0, 1.0).alias("c"), numbers.unit(c, 0.0, 5.0).alias("u"), numbers.color_text(F.lit(0.5)).alias("rgb"),
        text.first_replaced(F.col("s"), "+", "%2B").alias("r"), numbers.plural(F.col("n"), "citation").alias("p"), numbers.plural(F.lit(0), "citation").alias("p0"), text.text_path(F.lit("")).alias("e"), text.text_path(text.path_text(F.array(F.lit("1"), F.lit("2")))).alias("t"), numbers.short_number_udf(c * 1000).alias("k"), numbers.percent(F.lit(0.12345)).alias("pc"),
    ).first()
    assert tuple(r) == (3, -2, 1.0, 0.5, "rgb(125,0,130)", "a%2Bb+c", "citations", "citation", [""], ["1", "2"], "2.5k", 12.35)


def test_attribute_search(spark):
    labels = spark.createDataFrame([("10", "Uni Oxford"), ("9", "University of OX"), ("x", "Uni Ox"), ("2", "Oxen")], "id string, name string")
    ids = lambda *a: [r["id"] for r in search.search_attributes(labels, *a).collect()]
    assert ids("uni ox") == ["9", "10", "x"] and ids("uni  ox", 2) == ["9", "10"] and ids("") == [] and len(ids("", 4, True)) == 4


def test_root_search(spark):
    roots = spark.createDataFrame([("1", "Åbo Straße", '{"papers":1,"citations":5}'), ("2", "B", '{"citations":9}'), ("3", "Łódź", '{"citations":7}'), ("4", "D", None), ("5", "E", "{bad")], "id string, name string, meta string")
    got = [(r["id"], r["papers"], r["citations"]) for r in search.search_roots(roots, "", 5).collect()]
    assert got == [("2", 0, 9), ("3", 0, 7), ("1", 1, 5), ("4", 0, 0), ("5", 0, 0)]
    assert [r["id"] for r in search.search_roots(roots, "LODZ").collect()] == ["3"]
    assert [r["id"] for r in search.search_roots(roots, "abo strasse").collect()] == ["1"]


def test_as_of(spark):
    points = spark.createDataFrame([(i,) for i in (-2, 0, 1, 3, 6, 11)], "i int")
    frames = spark.createDataFrame([(f, str(f)) for f in (0, 3, 5, 8, 10)], "frame int, payload string")
    assert {r["i"]: r["frame"] for r in lookup.next_frame(points, frames).collect()} == {-2: 0, 0: 0, 1: 3, 3: 3, 6: 8, 11: 10}


def test_treemap():
    assert sorted(layout.treemap(["a", "b", "c"], [1, 1, 2], 100, 100)) == [("a", 0, 0, 50, 50), ("b", 0, 50, 50, 50), ("c", 50, 0, 50, 100)]
    assert layout.treemap([], [], 1, 1) == [] and layout.treemap(["a"], [1], 10, 10, 10) == []
    rng = random.Random(0)
    weights = [rng.randint(1, 50) for _ in range(17)]
    tiles = layout.treemap([str(i) for i in range(17)], weights, 30, 20)
    assert {t[0]: pytest.approx(t[3] * t[4]) for t in tiles} == {str(i): w * 600 / sum(weights) for i, w in enumerate(weights)}


def test_toggles():
    fold = lambda *ks: __import__("functools").reduce(selection.toggled, ks, frozenset())
    assert fold("1", "1-11", "1") == frozenset() and fold("1-11") == frozenset() and fold("1", "2", "2") == {"1"}
    assert fold("1", "1-2", "1-2-3", "1-2") == {"1"} and fold("1", "11", "1") == {"11"}
    assert selection.first_path(frozenset({"2", "10", "2-10", "2-9"})) == ["2", "9"]


def test_toggle_fold_columns(spark):
    rng = random.Random(1)
    events = [(str(rng.randint(0, 5)), i, rng.choice(["1", "2", "1-1", "1-2", "2-1", "1-1-1", "11"])) for i in range(400)]
    want = {}
    for s, _, k in events:
        want[s] = selection.toggled(want.get(s, frozenset()), k)
    rng.shuffle(events)
    got = {}
    for r in selection.fold_toggles(spark.createDataFrame(events, "session string, seq long, key string")).collect():
        got.setdefault(r["session"], set()).add(r["key"])
    assert got == {s: set(v) for s, v in want.items() if v}


def test_toggle_stream(spark, tmp_path):
    from canopyq.streaming.selection_stream import follow_toggles

    for i, part in enumerate(([("a", 1, "1"), ("a", 2, "1-2"), ("b", 3, "1-2")], [("a", 5, "3"), ("a", 4, "1")])):
        spark.createDataFrame(part, "session string, seq long, key string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    events = spark.readStream.schema("session string, seq long, key string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = follow_toggles(events).writeStream.outputMode("update").format("memory").queryName("picked").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("picked").collect()
    assert ["3"] in [r["keys"] for r in rows if r["session"] == "a"] or ["1", "1-2", "3"] in [r["keys"] for r in rows if r["session"] == "a"]
    assert all(r["keys"] == [] for r in rows if r["session"] == "b")


def test_commands():
    s = commands.replay(commands.start(SPECS["q1"]), "se1;se1-6;sp1;sp9;mi04,2;mixx;ce2;ce2;ce1;sl3;??;qcnone", SPECS)
    assert s.selection == {"1", "1-6"} and s.expanded == 1
    assert s.controls == (Control(include=("4", "2")), Control(size_base="specialization"), Control())
    assert commands.replay(s, "qcq3", SPECS).controls[0].limit_n == 7 and commands.start(SPECS["q1"]).controls[0] == Control()
    assert commands.leading_int("3abc") == 3 and commands.leading_int("x") is None


def write(path, value, zipped=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    data = value if isinstance(value, str) else json.dumps(value)
    (gzip.open(path, "wt") if zipped else open(path, "w")).write(data)


def test_store(spark, tmp_path):
    base = tmp_path / "store"
    write(base / "attribute-statics.json.gz", {"Country": {"1": {"name": "A", "meta": '{"x":"y"}'}, "2": {"name": "B", "meta": "{bad"}}, "Concept": {"11": {"name": "C"}}}, True)
    spec = {"title": "T", "description": "D", "root_entity_type": "Institution", "bifurcations": [{"attribute_kind": "Country", "resolver_id": "r", "control_format_str": '{"limit_n": 4}', "description": ""}]}
    write(base / "qc-specs.json", {"s1": spec})
    write(base / "available-rca-baselines.json", {"baselines": [["i", "Country", "Global", "Global"], ["i", "Country", "Country", "Global"], ["i", "Country", "Global", "Continent"]]})
    write(base / "rca-baselines/i-Country-Global-Global.json.gz", {"1": 0.25}, True)
    write(base / "rca-baselines/i-Country-Country-Global.json", {"7": {"1": 0.5}})
    write(base / "rca-baselines/i-Country-Global-Continent.json", {"9": {"2": 0.75}})
    write(base / "root-descriptions.json", {"Institution": [{"id": "5", "name": "I", "meta": '{"papers":1}'}], "Country": [{"id": "1", "name": "A"}]})
    write(base / "qc-builds/s1/5.json.gz", {"weight": 10, "children": {"1": {"weight": 7, "children": {"3": {"weight": 2}}}, "2": {"weight": 3}}}, True)
    write(base / "qc-builds/s1/6.json", {"weight": 4, "children": [{"name": "1", "weight": 4}]})
    write(base / "qc-builds/s1/7.json", "{broken")
    labels = store.with_parsed_meta(store.read_labels(spark, str(base)))
    assert {(r["entity_type"], r["id"], r["name"], tuple(r["meta"].items())) for r in labels.collect()} == {("Country", "1", "A", (("x", "y"),)), ("Country", "2", "B", ()), ("Concept", "11", "C", ())}
    specs = store.read_specs(spark, str(base))
    assert specs["s1"].kinds == ["Country"] and specs["s1"].controls()[0].limit_n == 4
    rates = {(r["basis_id"], r["parent_id"], r["child_id"], r["rate"]) for r in store.read_baselines(spark, str(base)).collect()}
    assert rates == {(None, None, "1", 0.25), ("7", None, "1", 0.5), (None, "9", "2", 0.75)}
    assert store.read_baselines(spark, str(base), ("i-Country-Global-Global",)).count() == 2
    assert [r["id"] for r in store.read_root_descriptions(spark, str(base), "Institution").collect()] == ["5"]
    nodes = store.read_trees(spark, str(base), "s1")
    assert {("/".join(r["path"]), r["root_id"], r["weight"]) for r in nodes.collect()} == {("", "5", 10), ("1", "5", 7), ("1/3", "5", 2), ("2", "5", 3), ("", "6", 4), ("1", "6", 4)}
    store.write_nodes(nodes, str(tmp_path / "nodes"))
    assert store.read_nodes(spark, str(tmp_path / "nodes"), "s1", "5").count() == 4
    store.write_baselines(store.read_baselines(spark, str(base)), str(tmp_path / "baselines"))
    assert spark.read.parquet(str(tmp_path / "baselines")).count() == 3


def test_view_and_profile(spark, small):
    facts = star.flow(spark, small)
    from canopyq.operators import rollup

    nodes = rollup.build_nodes(facts, SPECS["q1"]).cache()
    labels = star.attribute_labels(spark, small)
    rows = explore.view(spark, {"q1": nodes}, SPECS, "q1", "3", "se1;sp1", labels).collect()
    assert {r["level"] for r in rows} == {0, 1, 2} and all(r["name"] != "Unknown" for r in rows)
    got = explore.profile(nodes, SPECS["q1"], "3", ["1"], labels)
    assert got["nodes"].count() == got["volume"].count() == got["metrics"].count() == got["filters"].count() == 1
    assert explore.find_roots(star.root_descriptions(spark, small), "nation").count() == 6


def broken(words, most):
    lines, used = [], 0
    for w in words:
        used += len(w) + 1
        if not lines or used > most:
            lines.append([])
            used = len(w) + 1
        lines[-1].append(w)
    return lines


def fit(words, width, height, tall, wide):
    lines, count, size = [words], 1, 0.0
    for _ in range(7):
        size = min(width / (max(len(" ".join(x)) for x in lines) * wide), height / (1 + (count - 1) * tall))
        if len(lines) == len(words) or size >= height / (1 + count * tall):
            break
        lines = broken(words, len(" ".join(words)) / (count + 1) * 1.25)
        if len(lines) == count:
            break
        count = len(lines)
    return lines, size


def test_words_in_a_box(spark):
    rng = random.Random(3)
    names = [["x" * rng.randint(1, 12) for _ in range(rng.randint(1, 9))] for _ in range(60)]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(names)], "i int, w array<string>")
    c = F.col("w")
    got = rows.select("i", text.wrapped(c, F.lit(14)).alias("lines"), *[text.fitted(c, w, h, 1.2, 0.6).alias(f"f{k}") for k, (w, h) in enumerate(((60.0, 40.0), (10.0, 90.0), (200.0, 5.0)))]).collect()
    for r in got:
        words = names[r["i"]]
        assert r["lines"] == broken(words, 14)
        for k, (w, h) in enumerate(((60.0, 40.0), (10.0, 90.0), (200.0, 5.0))):
            lines, size = fit(words, w, h, 1.2, 0.6)
            assert r[f"f{k}"]["lines"] == lines and r[f"f{k}"]["size"] == pytest.approx(size)
    places = spark.createDataFrame([([["ab", "c"], ["def"]],)], "l array<array<string>>").select(text.word_places(F.col("l"), 1.0, 0.5, 10.0).alias("p"), text.word_places(F.col("l"), 1.0, 0.5, 10.0, left=True).alias("q")).first()
    assert [tuple(x) for x in places["p"]] == [("ab", -10.0, -10.0), ("c", 5.0, -10.0), ("def", -7.5, 0.0)]
    assert [tuple(x) for x in places["q"]] == [("ab", 0.0, -10.0), ("c", 15.0, -10.0), ("def", 0.0, 0.0)]

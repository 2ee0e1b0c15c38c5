"""What the n-gram join costs beyond its comparisons: jobs, broadcasts, copies sent, disk."""

from __future__ import annotations

import random

import numpy as np

from canopyq.llm import components, ngram_join
from canopyq.sources.shared import shared_checkpoint

from ..test_shared import shuffle_files


def plain_roots(links):
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for x, y in links:
        a, b = find(x), find(y)
        root[max(a, b)] = min(a, b)
    return {a: find(a) for a in root}


def some_links(seed, n=300):
    r = random.Random(seed)
    return [(r.randrange(-n, n), r.randrange(-n, n)) for _ in range(n)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(60)]


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    for most, held in ((components.ONE_TASK, components.HELD), (20, 7), (0, 1)):
        monkeypatch.setattr(components, "ONE_TASK", most)
        monkeypatch.setattr(components, "HELD", held)
        links = some_links(most)
        got = components.connected(spark.createDataFrame(links, "x long, y long").repartition(3)).collect()
        want = plain_roots(p for p in links if p[0] != p[1])
        assert len(got) == len(want) and {g.node for g in got} == set(want)
        pairs = {(g.root, want[g.node]) for g in got}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert not components.connected(spark.createDataFrame([], "x long, y long")).collect()


def test_components_take_few_jobs(spark):
    context = spark.sparkContext
    links = shared_checkpoint(spark.createDataFrame(some_links(1), "x long, y long"))
    context.setJobGroup("few jobs", "components")
    try:
        components.connected(links).count()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("few jobs")) <= 8


def test_picked_rows_hold_all_wanted(spark):
    rows = spark.createDataFrame([(None if i == 7 else i, i % 5) for i in range(3000)], "doc_id long, k long")
    for keys, columns in ((rows.where("k = 2"), ["doc_id"]), (rows.where("doc_id % 9 = 1 or doc_id is null"), ["doc_id", "k"])):
        want = {tuple(r) for r in keys.collect()}
        got = [tuple(r) for r in ngram_join.picked(rows, keys, columns, len(want)).collect()]
        assert want <= set(got) and len(got) <= len(want) + 100


def test_buckets_follow_what_is_verified():
    assert ngram_join.verify_buckets(0, 0, 0) == 1
    assert ngram_join.verify_buckets(1000, 500_000, 2000) == 1
    assert 20 <= ngram_join.verify_buckets(30_000, 16_000_000, 70_000) <= 60  # some 0.5 GB of Parquet: 123 by all its text


def test_forest_of_a_long_chain():
    x = np.arange(20_000, dtype=np.int64)
    order = np.random.default_rng(1).permutation(len(x))
    node, root = components.forest(order.astype(np.int64)[:-1], order.astype(np.int64)[1:])
    assert len(node) == len(x) and not root.any()


def some_copies(n=400, words=300):
    r = random.Random(3)
    texts = [" ".join(f"{r.getrandbits(40):x}" for _ in range(words)) for _ in range(n)]
    return [*enumerate(texts), *((n + i, texts[i]) for i in range(0, n, 40)), (5, texts[5]), (None, texts[7]), (n + 1, None), (None, None)]


def test_texts_of_what_stays_do_not_move(spark, make_docs, monkeypatch):
    pairs = some_copies()
    docs = shared_checkpoint(make_docs(pairs).repartition(4))
    want = sorted((p for p in pairs if p[1] is None or p[0] is not None and p[0] < 400), key=repr)
    moved = []
    for most in (ngram_join.BROADCAST_SETS, 0):
        monkeypatch.setattr(ngram_join, "BROADCAST_SETS", most)
        out, before = ngram_join.keep_one_of_each(docs), shuffle_files(spark)
        assert out.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == want
        moved.append(sum(size for at, size in shuffle_files(spark).items() if at not in before))
    assert 10 * moved[0] < moved[1]


def test_members_left_move_once(make_docs, monkeypatch):
    """Both sides of the join on differences read one exchange."""
    for name, value in (("TRIES", 0), ("HOT", 6), ("CENTERS", 0)):
        monkeypatch.setattr(ngram_join, name, value)
    plans = []
    whole = ngram_join.by_differences

    def by_differences(*args):
        out = whole(*args)
        out.collect()
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(ngram_join, "by_differences", by_differences)
    r, pairs = random.Random(100), []
    for i in range(70):
        w = [f"b{k}" for k in range(120)]
        if v := r.randint(0, 3):
            w[20 * v : 20 * v + 12] = [f"v{v}x{k}" for k in range(12)]
        w[r.randrange(len(w))] = f"n{r.randint(0, 9)}"
        pairs.append((i, " ".join(w)))
    ngram_join.similar_components(make_docs(pairs)).collect()
    assert plans and "ReusedExchange" in plans[0]

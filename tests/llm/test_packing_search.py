from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from canopyq.llm import hnsw, packing, quality, queries

from .conftest import lower
from .test_dedup import brute_components, brute_lines
from .test_filters import brute_leaks


def check_pieces(rows, texts, size, full, encoder):
    """Exact round trip, gapless offsets, nothing over a window."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for doc, want in texts.items():
        streams = sorted(by_doc[doc], key=lambda r: r["start"])
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in streams])
        assert sorted(ids.tolist()) == sorted(i for t in want for i in [*encoder.encode(t or "", add_special_tokens=False).ids, 0])
        if len(want) == 1:
            assert ids.tolist() == [*encoder.encode(want[0] or "", add_special_tokens=False).ids, 0]
            assert all(r["doc_tokens"] == len(ids) for r in streams)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] == len(r["ids"]) // 4 > 0
            at += r["length"]
        assert at <= size
    used = [sum(r["length"] for r in s) for s in by_seq.values()]
    padded = [n if n & (n - 1) == 0 else size for n in used]
    return (sum(padded) - sum(used)) / max(1, sum(padded))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_packing_odd(make_docs, odd_pairs, tokenizer):
    pairs = [*odd_pairs, (70, "<|endoftext|> inside <|endoftext|>"), (71, "it's  a\n\n test\t 12ab \u00a0x"), (72, "😀🏽 汉字 עברית")]
    texts = {}
    for d, t in pairs:
        texts.setdefault(d, []).append(t)
    rows = packing.pack_documents(make_docs(pairs), queries.tokenizer_path()).collect()
    check_pieces(rows, texts, 1024, True, tokenizer)
    assert packing.pack_documents(make_docs([]), queries.tokenizer_path()).count() == 0


def test_packing_real(spark, small, tokenizer):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.pack_documents(docs.coalesce(1), queries.tokenizer_path(), pool_size=50).collect()
    texts = {r["doc_id"]: [r["text"]] for r in docs.collect()}
    assert check_pieces(rows, texts, 1024, True, tokenizer) == 0
    crcs = {(r["doc_id"], r["start"], r["length"]): zlib.crc32(r["ids"]) for r in packing.pack_documents(docs, queries.tokenizer_path()).collect()}
    assert {(r["doc_id"], r["start"], r["length"]): r["ids_crc32"] for r in queries.op3_packing(spark, small).collect()} == crcs


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(0)
    for _ in range(30):
        size = rng.choice([10, 64, 100])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 80))]
        opened = []
        got = packing.best_fit(lengths, size, opened)
        room = []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [c for c in room if c >= lengths[i]]
            if not fits:
                room.append(size)
            best = min(fits, default=size)
            room.remove(best)
            room.append(best - lengths[i])
        assert sorted(room) == sorted(opened)
        for w in range(len(opened)):
            assert sum(n for n, p in zip(lengths, got) if p == w) == size - opened[w]


def brute_nearest(rows, queries_, k):
    out = {}
    for q, v in queries_:
        d = sorted((math.dist(v, w), i) for i, w in rows if i != q)
        out[q] = d[:k]
    return out


def test_nearest_odd(spark):
    rng = random.Random(3)
    good = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    same = [(1000 + i, good[5][1]) for i in range(40)] + [(2, good[2][1])]
    bad = [(5000, None), (5001, []), (5002, [0.0] * 8), (5003, [1.0, None] + [0.0] * 6), (5004, [float("nan")] * 8), (5005, [float("inf")] * 8), (None, [1.0] * 8)]
    table = spark.createDataFrame([(*r, 1, 2) for r in good + same + bad], "vec_id long, embedding array<float>, shard int, v int")
    v = hnsw.sound_vectors(table)
    assert v.count() == len(good) + len(same)
    q = v.where(F.col("vec_id") % 100 == 0)
    got = hnsw.nearest(v, q, 10, shard_rows=128).collect()
    f32 = lambda x: [float(np.float32(e)) for e in x]
    rows = [(i, f32(w)) for i, w in good + same]
    want = brute_nearest(rows, [(i, w) for i, w in rows if i % 100 == 0], 10)
    hits = 0
    for qid, near in want.items():
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == qid)
        assert [m[0] for m in mine] == list(range(1, 11)) and [m[2] for m in mine] == sorted(m[2] for m in mine)
        hits += len({m[1] for m in mine} & {i for _, i in near})
        exact = {i: d for d, i in brute_nearest(rows, [(qid, dict(rows)[qid])], len(rows))[qid]}
        assert all(m[2] == pytest.approx(exact[m[1]], abs=1e-12) for m in mine)
    assert hits >= 0.95 * 10 * len(want)
    few = v.where(F.col("vec_id") < 4)
    assert hnsw.nearest(few, few.where(F.col("vec_id") == 0), 10).count() == 4
    assert hnsw.nearest(v.limit(0), v.limit(0), 10).count() == 0


def exact(rows, qid, v, k):
    """All rows but one of this id and vector, by distance, then id."""
    others = list(rows)
    others.remove((qid, v))
    return [(i, d) for d, i in sorted((math.dist(v, w), i) for i, w in others if len(w) == len(v))[:k]]


def test_nearest_ties_and_repeats(spark):
    """Equal distances at the boundary, repeated query rows, rows of one id, other lengths, huge and tiny components."""
    unit = lambda i, x=1.0: [x if k == i else 0.0 for k in range(64)]
    rows = [(i, unit(i)) for i in range(1, 64)] + [(0, [0.125] * 64), (200, unit(70 - 7, 2.0)), (200, unit(5, 2.0)), (200, unit(5, 2.0)), (300, unit(5, 2.0)), (400, [1.0, 2.0]), (401, [1.0, 2.5])]
    rows += [(500, unit(3, 1e200)), (501, unit(3, 1.1e200)), (502, unit(4, 1e200)), (600, unit(3, 1e-200)), (601, unit(3, 3e-200))]
    v = hnsw.sound_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    asked = [r for r in rows if r[0] % 100 == 0]
    got = {}
    for r in hnsw.nearest(v, v.where(F.col("vec_id") % 100 == 0), 10, shard_rows=1000).collect():
        got.setdefault(r["row"], []).append((r["query_id"], r["rank"], r["vec_id"], r["score"]))
    assert len(got) == len(asked)
    lists = sorted((q, [(i, d) for _, _, i, d in sorted(near, key=lambda x: x[1])]) for near in got.values() for q in {near[0][0]})
    want = sorted((q, exact(rows, q, w, 10)) for q, w in asked)
    for (q, near), (p, best) in zip(lists, want):
        assert q == p and [i for i, _ in near] == [i for i, _ in best]
        assert [d for _, d in near] == pytest.approx([d for _, d in best])
    assert [i for i, _ in dict(lists)[0]] == [600, 601, *range(1, 9)]


@pytest.mark.parametrize("n", [500, 3000, 9000])
def test_nearest_recall_at_sizes(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 16))
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, v array<double>")
    got = hnsw.nearest(v, v.where(F.col("vec_id") % 100 == 0), 10, shard_rows=max(400, n // 3)).collect()
    hits = 0
    for q in range(0, n, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits >= 0.9 * 10 * len(range(0, n, 100))


def test_nearest_recall(spark, medium):
    got = queries.op5_nearest(spark, medium).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{medium}/embeddings.parquet").collect()]
    want = brute_nearest(rows, [r for r in rows if r[0] % 100 == 0], 10)
    hits = sum(r["vec_id"] in {i for _, i in want[r["query_id"]]} for r in got)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_pipeline(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = quality.train_quality(docs, spark.read.parquet(f"{small}/labels.parquet"))
    score = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    pairs = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect() if score[r["doc_id"]] >= 0.3]
    pairs = [(d, k) for d, _, _, k in brute_lines(pairs)]
    stays = {d for d, _, c in brute_components(pairs) if d == c}
    pairs = [p for p in pairs if p[0] in stays]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    texts = {d: t for d, t in pairs}
    low = {i: " ".join(t.lower().split()) for i, t in items}
    leaked = {d for d, t in texts.items() if any(f" {x} " in f" {' '.join(t.lower().split())} " for x in low.values())}
    got = corpus_pipeline.run(spark, small).collect()
    kept = {r["doc_id"] for r in got}
    assert kept <= set(texts) - leaked
    for d in set(texts) - leaked - kept:  # near copies of an item
        assert brute_leaks([(d, texts[d])], items)
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(queries.tokenizer_path())
    check_pieces(got, {d: [texts[d]] for d in kept}, 1024, 0, tokens)
    stage = docs
    for name, f in corpus_pipeline.STAGES:
        stage = f(spark, stage, small)
        stage.write.parquet(f"{tmp_path}/{name}")
        stage = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "packing" or stage.columns == docs.columns
    assert {r["doc_id"] for r in stage.select("doc_id").distinct().collect()} == kept


def test_near_duplicates_of_rows_without_an_id(spark, make_docs):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    pairs = [(1, text("a")), (None, text("a")), (None, text("a") + " more"), (None, text("b")), (None, text("b")), (None, text("b").upper()), (None, text("c")), (None, None), (None, ""), (None, ""), (7, text("d")), (9, text("d") + " x"), (7, text("e")), (8, text("e")), (5, ""), (6, None)]
    out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, make_docs(pairs), "")
    got = sorted(((r["doc_id"], lower(r["text"]) if r["text"] else r["text"]) for r in out.collect()), key=repr)
    assert got == sorted([(1, text("a")), (None, text("b")), (None, text("c")), (None, None), (None, ""), (None, ""), (7, text("d")), (7, text("e")), (5, ""), (6, None)], key=repr)


def test_pipeline_odd(spark, make_docs, odd_pairs, small):
    for pairs in ([], odd_pairs):
        docs = make_docs(pairs)
        for name, f in corpus_pipeline.STAGES:
            if name == "quality" and not pairs:
                assert f(spark, docs, small).count() == 0
                continue
            out = f(spark, docs, small)
            assert name == "packing" or out.columns == docs.columns
            out.count()

from __future__ import annotations

import random

import pytest

from canopyq.llm import line_dedup, ngram_join, substring_dedup

from .conftest import BLANKS, lower, words


def brute_substrings(pairs, window):
    first = {}
    for doc, text in pairs:
        w = words(text)
        for p in range(len(w) - window + 1):
            if doc is not None:
                k = tuple(w[p : p + window])
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in pairs:
        w = words(text)
        gone = set()
        for p in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[p : p + window])] < doc:
                gone |= set(range(p, p + window))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def brute_lines(pairs, least_chars=40, least_docs=5):
    holders = {}
    key = lambda s: lower(s.strip(BLANKS))
    for doc, text in pairs:
        for s in (text or "").split("\n"):
            if doc is not None and len(key(s)) >= least_chars:
                holders.setdefault(key(s), set()).add(doc)
    bad = {k: max(v) for k, v in holders.items() if len(v) >= least_docs}
    out = []
    for doc, text in pairs:
        lines = (text or "").split("\n")
        kept = [s for s in lines if doc is None or bad.get(key(s), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def shingles(text):
    w = words(lower(text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(pairs, percent=75):
    sets = [shingles(t) for _, t in pairs]
    parent = list(range(len(pairs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(pairs):
        fellows = [pairs[j][0] for j in range(len(pairs)) if find(j) == find(i) and pairs[j][0] is not None] if sets[i] else [doc]
        out.append((doc, len(sets[i]), min(fellows, default=None)))
    return sorted(out, key=repr)


def rows(df, *cols):
    return sorted((tuple(bytes(v).decode() if isinstance(v, (bytes, bytearray)) else v for v in r) for r in df.select(*cols).collect()), key=repr)


def test_substrings_odd(make_docs, odd_pairs):
    got = rows(substring_dedup.dedup_substrings(make_docs(odd_pairs)), "doc_id", "n_words", "n_removed", "kept")
    assert got == brute_substrings(odd_pairs, 50)


@pytest.mark.parametrize("seed", range(3))
def test_substrings_random(make_docs, seed):
    rng = random.Random(seed)
    pool = [f"v{i}" for i in range(30)]
    passages = [[rng.choice(pool) for _ in range(n)] for n in (49, 50, 51, 90, 200)]
    pairs = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 5)
            text += [rng.choice(pool) for _ in range(rng.randint(0, 40))] + p[a : len(p) - rng.randint(0, 5)]
        pairs.append((rng.randint(0, 50), rng.choice([" ", "\n", "  "]).join(text)))
    assert rows(substring_dedup.dedup_substrings(make_docs(pairs)), "doc_id", "n_words", "n_removed", "kept") == brute_substrings(pairs, 50)


def test_cover_meets_every_alignment():
    for i in range(substring_dedup.PERIOD):
        for j in range(substring_dedup.PERIOD):
            assert any((i + s) % substring_dedup.PERIOD in substring_dedup.COVER and (j + s) % substring_dedup.PERIOD in substring_dedup.COVER for s in range(substring_dedup.PERIOD))


def test_lines_odd(make_docs, odd_pairs):
    docs = make_docs(odd_pairs)
    assert rows(line_dedup.dedup_lines(docs), "doc_id", "n_lines", "n_dropped", "kept") == brute_lines(odd_pairs)
    out = line_dedup.rewrite_lines(docs)
    assert out.columns == docs.columns
    want = sorted(((d, None if t is None else k) for (d, t), (_, _, _, k) in zip(sorted(odd_pairs, key=repr), sorted(brute_lines(odd_pairs), key=repr))), key=repr)
    assert len(rows(out, "doc_id", "text")) == len(want)
    assert sorted((t or "") for _, t in rows(out, "doc_id", "text")) == sorted(k for *_, k in brute_lines(odd_pairs))


@pytest.mark.parametrize("seed", range(3))
def test_lines_random(make_docs, seed):
    rng = random.Random(seed)
    pool = [f"line {i} " + "abcdefghij" * rng.randint(2, 6) + rng.choice(["", "É", "ß"]) for i in range(12)]
    change = [lambda s: s, str.upper, lambda s: f"\t{s} ", lambda s: s + "!"]
    pairs = [(rng.randint(0, 60), "\n".join(rng.choice(change)(rng.choice(pool)) for _ in range(rng.randint(0, 6)))) for _ in range(80)]
    assert rows(line_dedup.dedup_lines(make_docs(pairs)), "doc_id", "n_lines", "n_dropped", "kept") == brute_lines(pairs)


def test_bloom_has_what_it_holds():
    import numpy as np

    h = np.arange(1, 5001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = line_dedup.Bloom(len(h))
    b.add(h, h[::-1])
    assert b.has(h, h[::-1]).all()
    assert b.has(h + np.uint64(1), h[::-1]).mean() < 0.03


def test_components_odd(make_docs, odd_pairs):
    assert rows(ngram_join.similar_components(make_docs(odd_pairs)), "doc_id", "n_shingles", "component_id") == brute_components(odd_pairs)


@pytest.mark.parametrize("seed", range(4))
def test_components_random(make_docs, seed, monkeypatch):
    """Large groups of near copies of a few texts, by dropped and changed words, around the threshold."""
    monkeypatch.setattr(ngram_join, "TRIES", 1)
    if seed % 2:
        monkeypatch.setattr(ngram_join, "HOT", 6)
        monkeypatch.setattr(ngram_join, "CENTERS", seed - 1)
    rng = random.Random(seed)
    bases = [[f"b{b}w{rng.randint(0, 400)}" for _ in range(rng.choice([6, 9, 30, 80, 150]))] for b in range(5)]
    common = [f"c{i}" for i in range(40)]
    pairs = []
    for i in range(160):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, max(1, len(w) // 12))):
            at = rng.randrange(len(w))
            w[at : at + 1] = [] if rng.random() < 0.6 else [f"n{rng.randint(0, 5)}"]
        if rng.random() < 0.3:
            w += common
        pairs.append((i, " ".join(w)))
    assert rows(ngram_join.similar_components(make_docs(pairs)), "doc_id", "n_shingles", "component_id") == brute_components(pairs)


def test_components_of_poor_sets(make_docs, monkeypatch):
    """With few segments, tiny sets meet by one-deletion neighbourhoods, or token by token."""
    monkeypatch.setattr(ngram_join, "segments_of", lambda band: (1 << band) // 2 + 1)
    rng = random.Random(12)
    pairs = []
    for i in range(150):
        w = [f"b{i % 12}w{k}" for k in range(5 + i % 12 * 2)]
        w[len(w) - rng.randint(0, 2) :] = [f"n{rng.randint(0, 3)}"] * rng.randint(0, 1)
        pairs.append((i, " ".join(w)))
    assert rows(ngram_join.similar_components(make_docs(pairs)), "doc_id", "n_shingles", "component_id") == brute_components(pairs)
    with pytest.raises(ValueError):
        ngram_join.similar_components(make_docs(pairs), percent=40)


@pytest.mark.parametrize("most", [ngram_join.HOT, 10])
def test_components_of_a_hot_signature(make_docs, monkeypatch, most):
    """A passage that many documents share, most of them alike in nothing else; no bucket gets all of a hot signature's sets."""
    monkeypatch.setattr(ngram_join, "HOT", most)
    rng = random.Random(13)
    hot = [f"hot{i}" for i in range(60)]
    pairs = [(i, " ".join(hot + [f"own{i}x{k}" for k in range(rng.choice([4, 12, 18, 40]))] + ([f"v{i % 5}"] if i % 3 else []))) for i in range(300)]
    assert rows(ngram_join.similar_components(make_docs(pairs)), "doc_id", "n_shingles", "component_id") == brute_components(pairs)


@pytest.mark.parametrize("centers", [0, 3])
def test_components_left_by_their_differences(make_docs, monkeypatch, centers):
    """Variants of one text, near copies of each: members that neither the centre nor a few linked fellows join."""
    for name, value in (("TRIES", 0), ("HOT", 6), ("CENTERS", centers)):
        monkeypatch.setattr(ngram_join, name, value)
    reached = []
    whole = ngram_join.by_differences
    monkeypatch.setattr(ngram_join, "by_differences", lambda every, *more: (reached.append(every.where("left").count()), whole(every, *more))[1])
    rng = random.Random(100)
    pairs = []
    for i in range(70):
        w = [f"b{k}" for k in range(120)]
        v = rng.randint(0, 3)
        if v:
            w[20 * v : 20 * v + 12] = [f"v{v}x{k}" for k in range(12)]
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(w))
            w[at : at + 1] = [] if rng.random() < 0.5 else [f"n{rng.randint(0, 9)}"]
        pairs.append((i, " ".join(w)))
    assert rows(ngram_join.similar_components(make_docs(pairs)), "doc_id", "n_shingles", "component_id") == brute_components(pairs)
    assert centers or (reached and reached[0] > 3)


def test_empty_tables(make_docs):
    docs = make_docs([])
    for df in (substring_dedup.dedup_substrings(docs), line_dedup.dedup_lines(docs), line_dedup.rewrite_lines(docs), ngram_join.similar_components(docs)):
        assert df.count() == 0


def test_a_passage_in_half_of_all_documents(spark, make_docs, monkeypatch):
    """What a frequent passage and null ids cost: no bucket gets over twice the median's rows."""
    rng = random.Random(21)
    hot = [f"h{i}" for i in range(80)]
    pairs = [(i if i % 5 else None, " ".join([f"o{i}x{k}" for k in range(rng.randint(60, 90))] + (hot if i % 2 else []))) for i in range(1500)]
    docs = make_docs(pairs).repartition(6)
    assert rows(substring_dedup.dedup_substrings(docs), "doc_id", "n_words", "n_removed", "kept") == brute_substrings(pairs, 50)
    n, sizes = 9, []
    for fields, stage in ((substring_dedup.ANCHOR, docs.select("doc_id", "text").mapInArrow(substring_dedup._anchors(50, n), substring_dedup.BLOCK)),):
        width = sum({"u": int(k[2]), "i": int(k[2])}[k[1]] for _, k in fields)
        per = {}
        for r in stage.collect():
            if r["bucket"] >= 0:
                per[r["bucket"]] = per.get(r["bucket"], 0) + len(r["payload"]) // width
        sizes.append(sorted(per.values()))
    assert all(s[-1] <= 2 * s[len(s) // 2] for s in sizes)
    dealt = docs.select(substring_dedup.bucket_of("doc_id", n).alias("b")).groupBy("b").count().collect()
    counts = sorted(r["count"] for r in dealt)
    assert len(counts) == n and counts[-1] <= 2 * counts[len(counts) // 2]

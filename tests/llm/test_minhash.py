"""Near-duplicate components against brute force."""

import random

import pytest

from conductrisk.llm import minhash
from conductrisk.llm.components import components


def sets_of(text):
    table = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    w = (text or "").translate(table).encode().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows):
    sets = [sets_of(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            # rows of one id and text are one document
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                group[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, len(sets[i]), least[root(i)], doc == least[root(i)]) for i, (doc, _) in enumerate(rows))


def found(docs):
    return sorted(tuple(r) for r in minhash.near_duplicates(docs).select("row.doc_id", "n_shingles", "component_id", "kept").collect())


def test_equal_to_brute_force(make, texts):
    assert found(make(texts)) == expected(list(enumerate(texts)))


def test_chains_tiny_sets_and_a_large_group(make):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for n in (1, 2, 5, 6, 7, 8, 9, 10, 12, 16, 24, 40, 120, 300):  # sizes around the small-set rules, with chains of edits
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(6):
            texts.append(" ".join(base))
            base = list(base)
            if rng.random() < 0.7:
                base[rng.randrange(len(base))] = rng.choice(words)
            if rng.random() < 0.5:
                base.append(rng.choice(words))
    large = [rng.choice(words) for _ in range(80)]
    for i in range(60):
        copy = list(large)
        copy[rng.randrange(80)] = f"e{i}"
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    assert found(make(texts)) == expected(list(enumerate(texts)))


def test_passage_that_many_share_links_nothing(make):
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [passage + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(60)) for _ in range(80)]
    assert {r[2] == r[0] for r in found(make(texts))} == {True}


def test_odd_rows(make, clashing):
    docs = make([None, "", "same words here", "same words here", "Same Words HERE", "same words here"], [1, 2, 5, 5, 4, None],
                extra=clashing)
    rows = minhash.near_duplicates(docs).select("row.doc_id", "n_shingles", "component_id", "kept", "row.k").collect()
    assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(map(repr, [
        (1, 0, 1, True, "mine"), (2, 0, 2, True, "mine"), (5, 1, None, False, "mine"), (5, 1, None, False, "mine"),
        (4, 1, None, False, "mine"), (None, 1, None, True, "mine")]))
    assert minhash.near_duplicates(make([])).collect() == []


def test_one_row_of_each_group_stays(make, spark):
    """Repeated rows, copies without an id, and different texts of one id."""
    import corpus_pipeline
    long = [f"w{i}" for i in range(60)]
    near = " ".join([*long[:59], "other"])
    texts = ["same words here"] * 30 + [" ".join(long), near, " ".join(long), "other text", "", None]
    ids = [5] * 29 + [6, None, None, None, 5, 7, 8]
    rows = corpus_pipeline.drop_near_duplicates(spark, make(texts, ids), "").collect()
    assert sorted((str(r.doc_id), r.text or "") for r in rows if r.doc_id is not None) == [
        ("5", "other text"), ("5", "same words here"), ("7", ""), ("8", "")]
    assert [r.text in (near, " ".join(long)) for r in rows if r.doc_id is None] == [True]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    labels = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    group = {x: x for e in edges for x in e}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in edges:
        group[root(a)] = root(b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert set(labels) == linked
    assert {(a, b): labels[a] == labels[b] for a in linked for b in linked} == {
        (a, b): root(a) == root(b) for a in linked for b in linked}


def test_families_in_blocks(make, monkeypatch):
    """Copies that are alike but under the threshold, in blocks of a few classes, with some links among them."""
    monkeypatch.setattr(minhash, "FAMILY_ROWS", 7)
    rng = random.Random(11)
    base = [f"b{rng.randrange(10**6)}" for _ in range(150)]
    texts = [" ".join(base)]
    for i in range(40):
        copy = list(base)
        for _ in range(rng.choice([2, 6, 8, 9])):
            copy[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
        if i % 5 == 0:
            copy[rng.randrange(150)] = "again"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    rows = found(make(texts))
    assert rows == expected(list(enumerate(texts))) and len({r[2] for r in rows}) > 5


def test_estimate_of_a_union_sketch_is_near(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    import pyarrow as pa
    common = rng.integers(0, 2**62, 300)
    a, b = (np.sort(np.concatenate([common, rng.integers(0, 2**62, 60)]))[:80] for _ in range(2))
    table = pa.table({"v": [1, 1], "k": [10, 11], "label": [10, 11], "family": [1, 2], "n": [360, 360], "sketch": pa.array([a, b], pa.list_(pa.int64()))})
    assert minhash._list_pairs(table).to_pylist() == [{"a": 10, "b": 11}]
    unlike = rng.integers(0, 2**62, 80)
    table = pa.table({"v": [1, 1], "k": [10, 11], "label": [10, 11], "family": [1, 2], "n": [360, 360],
                      "sketch": pa.array([a, np.sort(unlike)], pa.list_(pa.int64()))})
    assert minhash._list_pairs(table).num_rows == 0

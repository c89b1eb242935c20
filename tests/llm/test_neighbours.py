"""Nearest neighbours against comparing all vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conductrisk.llm import neighbours
from conductrisk.llm.neighbour_queries import op11_nearest_vectors
from conductrisk.llm.vptree import VPTree

SCHEMA = "vec_id long, embedding array<double>"


def plainly(rows, step, k=10):
    """{query: [(id, distance)]} of (id, vector) rows."""
    kept = {}
    for i, v in rows:
        if i is None or v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        kept[i] = min(kept.get(i, list(v)), list(v))
    out = {}
    for q in kept:
        if q % step == 0:
            found = [(math.dist(kept[q], v), i) for i, v in kept.items() if i != q and len(v) == len(kept[q])]
            out[q] = sorted(found)[:k]
    return {q: x for q, x in out.items() if x}


def of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.score, r.id))
    return out


def same(found, want):
    assert set(found) == set(want)
    for q, have in found.items():
        assert [i for _, i in have] == [i for _, i in want[q]], q
        assert np.allclose([d for d, _ in have], [d for d, _ in want[q]], rtol=1e-12, atol=0)


def clustered(rng, n, size=6, centres=12):
    # small whole numbers, so that equal distances are equal as doubles
    c = rng.integers(-40, 40, (centres, size))
    return [(int(i), (c[rng.integers(centres)] + rng.integers(-3, 4, size)).tolist()) for i in rng.permutation(n)]


@pytest.mark.parametrize("shard_bytes", [2_000, 50_000, 10_000_000])
def test_factor_one_is_exact(spark, shard_bytes):
    """Many shards and cells, ties, and one vector that a third of all rows have."""
    rng = np.random.default_rng(3)
    rows = clustered(rng, 900) + [(1000 + i, [5, 5, 5, 5, 5, 5]) for i in range(450)]
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = neighbours.nearest(df, F.col("id") % 20 == 0, factor=1.0, shard_bytes=shard_bytes)
    same(of(found), plainly(rows, 20))


def test_odd_rows(spark):
    """Null ids and vectors, zeros, non-finite parts, repeated rows, ids with several vectors, other lengths, more columns."""
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(size=4).tolist()) for i in range(80)]
    rows += [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, float("nan"), 0.0, 0.0]), (204, [1.0, None, 0.0, 2.0]),
             (206, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 2.0, 3.0, 4.0]), rows[3], rows[3], (5, [9.0, 9.0, 9.0, 9.0]),
             (300, [1.0, 2.0]), (301, [1.0, 2.5]), (302, [4.0, 2.0]), (400, [1.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'mine' as {c}" for c in ("id", "vec", "cell", "part", "rank", "asks", "score")])
    for shard_bytes in (100, 10_000):
        same(of(neighbours.nearest(df, F.col("id") % 2 == 0, factor=1.0, shard_bytes=shard_bytes)), plainly(rows, 2))
    assert of(neighbours.nearest(df, F.lit(None).cast("boolean"))) == {}
    empty = neighbours.nearest(df.limit(0), F.col("id") % 2 == 0)
    assert empty.columns == ["query_id", "rank", "id", "score"] and empty.collect() == []
    with pytest.raises(ValueError):
        neighbours.nearest(df, F.lit(True), factor=0.5)


def test_pruning_skips_rows_and_keeps_recall():
    """With clusters, few leaves are visited; a larger factor visits fewer."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 32)) * 5
    m = np.repeat(centres, 100, axis=0) + rng.normal(size=(6000, 32)) * 0.3
    tree, ids = VPTree.build(m, 32), np.arange(6000)
    who = np.arange(0, 6000, 100)
    visited = {}
    for factor in (1.0, 4.0):
        count = [0]
        inner = tree.visit

        def counting(queries, reach, leaf, inner=inner, count=count):
            return inner(queries, reach, lambda node, w: (count.__setitem__(0, count[0] + len(w)), leaf(node, w)))

        tree.visit = counting
        found, d = tree.nearest(m[who], ids, who, 10, np.full(len(who), np.inf), factor)
        del tree.visit
        visited[factor] = count[0] / len(who) / (tree.left < 0).sum()
        exact = [np.lexsort((ids, np.where(ids == q, np.inf, np.linalg.norm(m - m[q], axis=1))))[:10] for q in who]
        recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found, exact)])
        assert recall == 1.0 if factor == 1 else recall >= 0.9
    assert visited[4.0] <= visited[1.0] < 0.3


def test_recall_of_the_registered_query(spark):
    """On vectors without any structure, with the default factor and many shards."""
    sf = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in e.collect()]
    want = plainly(rows, 100)
    for found in (op11_nearest_vectors(spark, sf).withColumnRenamed("vec_id", "id"),
                  neighbours.nearest(e, F.col("id") % 100 == 0, shard_bytes=100_000)):
        found = of(found)
        assert set(found) == set(want) and all(len(x) == 10 for x in found.values())
        hits = sum(len({i for _, i in want[q]} & {i for _, i in found[q]}) for q in want)
        assert hits >= 0.9 * sum(map(len, want.values()))

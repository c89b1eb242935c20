import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from conductrisk import config as C
from conductrisk.operators import models as M
from conductrisk.operators import sampling as S
from conductrisk.operators import sequences


@pytest.fixture(scope="module")
def daily(spark):
    rng = np.random.default_rng(0)
    rows = []
    for u in range(12):
        for d in range(20):
            bad = u == 5 and d >= 17
            values = rng.normal(5 + 20 * bad, 1, len(C.DAILY_FEATURES))
            rows.append((f"U{u}", ["Admin", "Employee"][u % 2], dt.date(2024, 1, 1) + dt.timedelta(days=d), int(bad), *map(float, values)))
    schema = "user string, role string, day date, label int, " + ", ".join(f"{f} double" for f in C.DAILY_FEATURES)
    return spark.createDataFrame(rows, schema).cache()


def test_sequences_need_ten_days(daily):
    seqs = sequences.sequences(daily)
    assert seqs.count() == 12 * 11
    r = seqs.first()
    assert len(r.sequence) == 10 and len(r.sequence[0]) == 15


def test_row_weight_counts_sequences(daily):
    rows = daily.filter("user = 'U0'").withColumn("w", sequences.sequence_weight()).orderBy("day").collect()
    assert [r.w for r in rows] == [min(i + 1, 10, 11, 20 - i) for i in range(20)]


def test_more_components_reconstruct_better(daily):
    seqs = sequences.sequences(daily)
    errors = [M.SequenceModel.fit(seqs, k, 15).score(seqs).agg(F.avg("error")).first()[0] for k in (0, 4, 32)]
    assert errors[0] > errors[1] > errors[2]
    assert errors[0] == pytest.approx(1.0, rel=0.05)


def test_zero_components_equal_the_sql_error(daily):
    seqs = sequences.sequences(daily)
    plain = {(r.user, r.day): r.global_error for r in sequences.sequence_errors(daily).filter("global_error is not null").collect()}
    model = M.SequenceModel.fit(seqs, 0, 15).score(seqs)
    for r in model.collect():
        assert r.error == pytest.approx(plain[(r.user, r.day)], rel=1e-6)


def test_isolation_forest_isolates_outliers(daily):
    rows = daily.withColumn("key", F.concat_ws(":", "user", "day"))
    forest = M.fit_forest(rows, C.CORE_FEATURES, "key", trees=25, rows=64)
    scored = M.score_forest(rows, forest, C.CORE_FEATURES, 0.02, rows=64)
    flagged = scored.filter("prediction = -1")
    assert flagged.count() >= 3
    assert {r.label for r in scored.orderBy("decision").limit(3).collect()} == {1}


def test_kernel_detector(daily):
    scored = M.kernel_scores(daily, C.CORE_FEATURES, 0.05)
    assert {r.label for r in scored.orderBy("decision").limit(3).collect()} == {1}


def test_classifier_and_attribution_law(daily):
    model = M.fit_forest_classifier(daily, C.CORE_FEATURES, trees=10)
    phi = M.attributions(model, daily, C.CORE_FEATURES, ["user", "day"]).collect()
    assert len(phi) == 240
    for r in phi:
        assert sum(r[f"phi_{f}"] for f in C.CORE_FEATURES) == pytest.approx(r.probability_1 - r.base_probability, abs=1e-9)


def _coalitions(model, x, mean):
    """Shapley values over all coalitions, each scored by the model itself."""
    n = len(x)
    mixed = [[x[i] if s >> i & 1 else mean[i] for i in range(n)] for s in range(2 ** n)]
    p = [float(model.predictProbability(Vectors.dense(m))[1]) for m in mixed]
    phi = [0.0] * n
    for s in range(2 ** n):
        for i in range(n):
            if not s >> i & 1:
                k = bin(s).count("1")
                phi[i] += math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (p[s | 1 << i] - p[s])
    return phi, p[-1], p[0]


def test_path_attributions_equal_all_coalitions(spark):
    rng = np.random.default_rng(5)
    rows = [(str(i), *[float(v) for v in rng.integers(0, 9, 4)]) for i in range(300)]
    rows = [(*r, int(r[1] * r[2] + 3 * r[3] - r[4] > 20)) for r in rows] + [("null", None, 2.0, None, 1.0, 0)]
    names = ["p", "q", "r", "s"]
    df = spark.createDataFrame(rows, "k string, p double, q double, r double, s double, label int")
    model = M.fit_forest_classifier(df, names, trees=6)
    got = {r.k: r for r in M.attributions(model, df, names, ["k"]).collect()}
    mean = list(df.agg(*[F.avg(n) for n in names]).first())
    assert len(got) == 301
    for row in [*rows[::43], rows[-1]]:
        phi, p, base = _coalitions(model, [0.0 if v is None else v for v in row[1:5]], mean)
        assert [got[row[0]][f"phi_{n}"] for n in names] == pytest.approx(phi, abs=1e-12)
        assert (got[row[0]].probability_1, got[row[0]].base_probability) == pytest.approx((p, base), abs=1e-12)


def test_twenty_features_need_no_coalitions(spark):
    rng = np.random.default_rng(6)
    names = [f"f{i}" for i in range(20)]
    x = rng.normal(size=(200, 20))
    df = spark.createDataFrame([(str(i), *[float(v) for v in r], int(r[:5].sum() > 0)) for i, r in enumerate(x)],
                               "k string, " + ", ".join(f"{n} double" for n in names) + ", label int")
    model = M.fit_forest_classifier(df, names, trees=8)
    attributed = M.attributions(model, df, names, ["k"])
    want = {r.k: r.p for r in M.probability(model, df, names, "p").collect()}
    for r in attributed.collect():
        assert r.probability_1 == pytest.approx(want[r.k], abs=1e-12)
        assert sum(r[f"phi_{n}"] for n in names) == pytest.approx(r.probability_1 - r.base_probability, abs=1e-9)
    assert "Exchange" not in attributed._jdf.queryExecution().executedPlan().toString()


def test_boosted_trees_rank_the_threat(daily):
    model = M.fit_boosted(daily, C.CORE_FEATURES, trees=5)
    history = M.risk_history(model, daily, C.CORE_FEATURES)
    assert {r.label for r in history.orderBy(F.desc("risk_score")).limit(3).collect()} == {1}


def test_nearest_neighbours_equal_brute_force_with_many_copies(spark):
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(150, 2))
    pts[50:100] = pts[0]  # a third are copies of one row
    rows = [(0 if i >= 50 else i % 2, i, [float(x) for x in p]) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "label int, id long, vec array<double>")
    got = {}
    for r in S.nearest_in_class(df, 5, block_rows=10).collect():
        got.setdefault(r.id, []).append((r.nth, r.distance, r.neighbour))
    for label, i, v in rows:
        want = sorted(float(np.linalg.norm(np.array(v) - np.array(w))) for l, j, w in rows if l == label and j != i)[:5]
        mine = sorted(got[i])
        assert [m[1] for m in mine] == pytest.approx(want)
        assert i not in [m[2] for m in mine] and len({m[2] for m in mine}) == 5


def _brute_neighbours(rows, k):
    out = {}
    for label, i, v in rows:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for l, j, w in rows if l == label and j != i)
        out[i] = d[:k]
    return out


@pytest.mark.parametrize("budget", [16_000_000, 2_000, 0])
def test_nearest_neighbours_with_many_blocks(spark, budget):
    """Cells, rings and parts: clusters of unequal size, whole numbers for ties, a small third class, and no centres at all."""
    rng = np.random.default_rng(8)
    centres = rng.integers(-60, 60, (6, 3))
    pts = centres[np.minimum(rng.integers(0, 12, 700), 5)] + rng.integers(-6, 7, (700, 3))  # one cluster has more than half
    rows = [(2 if i < 4 else int(i % 5 == 0), i, [float(x) for x in p]) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "label int, id long, vec array<double>").repartition(4)
    got = {}
    for r in S.nearest_in_class(df, 5, block_rows=16, budget=budget).collect():
        got.setdefault(r.id, []).append((r.nth, r.distance, r.neighbour))
    want = _brute_neighbours(rows, 5)
    copies = {}
    for label, i, v in rows:
        copies.setdefault((label, *v), []).append(i)
    for label, i, v in rows:
        mine = sorted(got[i])
        assert [m[0] for m in mine] == list(range(1, len(want[i]) + 1))
        assert [m[1] for m in mine] == pytest.approx([d for d, _ in want[i]])
        if max(len(copies[label, *rows[j][2]]) for _, j in want[i]) <= 5:
            assert [m[2] for m in mine] == [j for _, j in want[i]]


def test_neighbours_compare_few_pairs(spark, monkeypatch):
    """On clustered vectors the rows that are asked of other blocks are a small part of all pairs."""
    rng = np.random.default_rng(9)
    pts = np.repeat(rng.normal(size=(80, 8)) * 40, 100, axis=0) + rng.normal(size=(8000, 8))
    df = spark.createDataFrame([(0, i, p.tolist()) for i, p in enumerate(pts)], "label int, id long, vec array<double>")
    compared, plain, whole = [], S._asked, S._placed
    monkeypatch.setattr(S, "_placed", lambda *a: compared.append(whole(*a)) or compared[-1])
    monkeypatch.setattr(S, "_asked", lambda *a: compared.append(plain(*a)) or compared[-1])
    assert S.nearest_in_class(df, 5, block_rows=200).count() == 5 * 8000
    placed, asked = compared
    sizes = placed.groupBy(*S._BLOCK).agg(F.count("*").alias("m"))
    own = sizes.agg(F.sum(F.col("m") * F.col("m"))).first()[0]
    others = asked.join(sizes, S._BLOCK).agg(F.sum("m")).first()[0] or 0
    assert (own + others) < 0.1 * 8000 ** 2


def test_synthetic_rows_lie_between_their_parents(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i < 12), [float(x) for x in rng.normal(size=3)]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, label int, vec array<double>")
    vec = {r[0]: np.array(r[2]) for r in rows}
    wanted = int(68 * 0.3 / 0.7) - 12
    made = S.synthetic_minority(df.filter("label = 1").select("id", "vec"), S.rows_needed(df, "label", 0.3)).collect()
    assert sorted(r.sample for r in made) == list(range(1, wanted + 1))
    for r in made:
        assert 0 <= r.gap < 1
        assert np.allclose(r.vec, vec[r.base] + r.gap * (vec[r.neighbour] - vec[r.base]))
    assert S.balanced(df).count() == 80 + wanted


def test_user_split_keeps_the_labelled_user_out_of_training(daily):
    rows = S.user_split(daily.select("user"), "U5").distinct().collect()
    assert not [r for r in rows if r.user == "U5" and r.in_train]
    assert sum(r.in_train for r in rows) in (8, 9)


def test_rows_of_trees_are_drawn_in_compiled_code(spark):
    """Each tree has the rows of the smallest hashes; no lambda runs for every row and tree."""
    df = spark.range(500).selectExpr("concat('k', id) AS key", "double(id) AS a", "double(id % 7) AS b")
    found = M.tree_samples(df, ["a", "b"], "key", trees=5, rows=40)
    assert "lambda" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r.tree, {})[r.rn] = (r["__k"], r.a, r.b)
    hashes = df.selectExpr("key", "a", "b", "transform(sequence(0, 4), t -> pmod(xxhash64(key, t), 1000000000)) AS h").collect()
    for tree in range(5):
        want = sorted((r.h[tree], r.key, r.a, r.b) for r in hashes)[:40]
        assert got[tree] == {i + 1: x[1:] for i, x in enumerate(want)}
    assert len(got) == 5


def test_paths_of_leaves_are_those_of_a_walk():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(64, 3)), 1)
    x[5, 1] = np.nan
    for limit in (0, 1, 6):
        tree = np.array(M._grow(np.nan_to_num(x), np.random.default_rng(limit), limit), float)
        feature, cut, left, right, length, depth = M._paths(tree)
        for row in x:
            at, steps = 0, 0
            while tree[at, 0] >= 0:
                at, steps = int(tree[at, 2] if row[int(tree[at, 0])] <= tree[at, 1] else tree[at, 3]), steps + 1
            here = 0
            for _ in range(depth):
                here = left[here] if row[feature[here]] <= cut[here] else right[here]
            assert here == at and length[here] == steps + M._average_path(tree[at, 4]) and steps <= depth

import numpy as np
import pytest
from pyspark.sql import functions as F

from conductrisk.operators import biometrics, entropy, evaluation, featurestore, posterior, thresholds


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(5)
    s = rng.normal(0.2, 0.05, 1000)
    label = (rng.random(1000) < 0.05).astype(int)
    s = np.where(label == 1, s + 0.2, s)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(s, label))], "id long, score double, label int")
    return df.cache(), s, label


def test_threshold_methods(scores):
    df, s, _ = scores
    assert thresholds.by_percentile(df).first().threshold == pytest.approx(np.percentile(s, 99.5))
    q1, q3 = np.percentile(s, [25, 75])
    assert thresholds.by_iqr(df).first().threshold == pytest.approx(q3 + 1.5 * (q3 - q1))
    assert thresholds.by_deviation(df).first().threshold == pytest.approx(s.mean() + 3 * s.std())


def test_too_few_samples_give_the_default(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "score double")
    for method in ("percentile", "iqr", "std"):
        r = thresholds.adaptive_threshold(df, method).first()
        assert (r.method, round(r.threshold, 6), r.confidence) == ("default", 0.52, 0.5)


def test_cost_threshold_is_the_cheapest(scores):
    df, s, label = scores
    best = None
    for t in np.percentile(s, np.linspace(90, 99.9, 100)):
        cost = ((s > t) & (label == 0)).sum() + 10 * ((s <= t) & (label == 1)).sum()
        if best is None or cost < best[0]:
            best = (cost, t)
    r = thresholds.by_cost(df).first()
    assert r.total_cost == best[0] and r.threshold == pytest.approx(best[1])


def test_cost_without_labels_falls_back(scores):
    assert thresholds.adaptive_threshold(scores[0], "cost").first().method == "percentile"
    with pytest.raises(ValueError):
        thresholds.adaptive_threshold(scores[0], "other")


def test_tail_fit_recovers_an_exponential_tail(spark):
    x = np.random.default_rng(2).exponential(1.0, 4000)
    r = thresholds.by_tail(spark.createDataFrame([(float(v),) for v in x], "score double")).first()
    cut = np.percentile(x, 95)
    assert r.method == "evt" and abs(r.shape) < 0.25
    assert r.threshold == pytest.approx(cut + np.log(1000), rel=0.45)
    assert r.ks_statistic < 0.1 and r.confidence > 0.1


def test_tail_with_few_rows_uses_the_percentile(spark):
    df = spark.createDataFrame([(float(v),) for v in range(200)], "score double")
    assert thresholds.by_tail(df).first().method == "percentile"


@pytest.mark.parametrize("test", ["ks", "cvm"])
def test_distribution_drift(spark, test):
    rng = np.random.default_rng(4)
    frame = lambda a: spark.createDataFrame([(i, float(v)) for i, v in enumerate(a)], "id long, score double")
    a, same, moved = rng.normal(0, 1, 400), rng.normal(0, 1, 500), rng.normal(0.6, 1.3, 500)
    quiet = thresholds.distribution_drift(frame(a), frame(same), "score", "id", test).first()
    loud = thresholds.distribution_drift(frame(a), frame(moved), "score", "id", test).first()
    assert not quiet.drift_detected and quiet.sample_size == 400
    assert loud.drift_detected and "mean score rose" in loud.recommendation


def test_kolmogorov_statistic(spark):
    a, b = [1.0, 2.0, 2.0, 3.0], [2.0, 3.0, 3.0, 9.0]
    frame = lambda v: spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, score double")
    r = thresholds.distribution_drift(frame(a), frame(b), "score", "id").first()
    assert r.statistic == pytest.approx(0.5)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1)], "s double, label int")
    assert evaluation.roc_auc(df, "s").first()[0] == pytest.approx((1 + 0.5 + 2) / 4)


def test_confusion(spark):
    df = spark.createDataFrame([(80.0, 1), (80.0, 0), (10.0, 1), (10.0, 0)], "risk_score double, label int")
    r = evaluation.confusion(df).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall) == (1, 1, 1, 1, 0.5, 0.5)


def test_frequency_encoder(spark):
    df = spark.createDataFrame([(c,) for c in "ABACABA"], "c string")
    enc = featurestore.fit_frequency(df, "c")
    assert {r.category: r.share for r in enc.collect()} == pytest.approx({"A": 4 / 7, "B": 2 / 7, "C": 1 / 7})
    coded = featurestore.encode_frequency(spark.createDataFrame([("A",), ("Z",)], "c string"), "c", enc, "code")
    assert [round(r.code, 4) for r in coded.orderBy("c").collect()] == [round(4 / 7, 4), 0.0]


def test_feature_statistics_and_quality(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, None, 5.0)], "x double")
    r = featurestore.statistics(df, ["x"]).first()
    assert (r["count"], r.missing, r.unique, r.min, r.max) == (5, 1, 4, 1.0, 5.0)
    assert r.std == pytest.approx(np.std([1, 2, 3, 5], ddof=1)) and r.q50 == 2.5
    ref = spark.createDataFrame([("x", 100.0, 1.0)], "feature string, mean double, std double")
    kind = spark.createDataFrame([("x", "float64")], "feature string, dtype string")
    q = featurestore.quality(featurestore.statistics(df, ["x"]), ref, kind).first()
    assert not q.valid and len(q.issues) == 2


def test_entropy_bounds(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("c", None)], "u string, k string")
    got = {r.u: r.entropy for r in entropy.normalised_entropy(df, ["u"], "k").collect()}
    assert got == {"a": 1.0, "b": 0.0}


def test_percentile_rank_without_baseline_is_50(spark):
    now = spark.createDataFrame([(0.3,)], "v double")
    assert entropy.percentile_rank(now, now.filter("false"), "v").first().entropy_percentile == 50


def test_velocity_anomaly(spark):
    now = spark.createDataFrame([("a", 100.0), ("b", 2.0)], "u string, v double")
    then = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0)], "u string, v double")
    got = {r.u: r.velocity_score for r in biometrics.velocity_anomaly(now, then, "v", ["u"]).collect()}
    assert got == {"a": 1.0, "b": 0.0}


def test_posterior_ranges(spark):
    rows = [("Admin", "File Copy", 3, 0, 0.5), ("Employee", "Logon", 12, 0, 0.05)]
    df = spark.createDataFrame(rows, "role string, activity string, hour int, day_of_week int, anomaly_score double")
    out = posterior.risk_distribution(df)
    high, low = out.orderBy(F.desc("risk_mean")).collect()
    assert high.role == "Admin" and 0 < low.risk_mean < high.risk_mean <= 100 and low.risk_std > 0
    q = out.select("risk_mean", posterior.posterior_percentiles("alpha", "beta").alias("q")).collect()
    assert all(r.q.p90 < r.q.p95 < r.q.p99 and r.q.p90 > r.risk_mean * 0.9 for r in q)


def test_posterior_percentiles_equal_many_draws(spark):
    import numpy as np
    pairs = [(1.0, 1.0), (2.5, 7.0), (30.0, 4.0), (5.0, 5.0), (1.0, 9.0)]
    got = spark.createDataFrame(pairs, "a double, b double").select(
        "a", "b", posterior.posterior_percentiles("a", "b").alias("q")).collect()
    for r in got:
        want = np.percentile(np.random.default_rng(1).beta(r.a, r.b, 400_000), [90, 95, 99]) * 100
        assert np.allclose([r.q.p90, r.q.p95, r.q.p99], want, atol=0.25)

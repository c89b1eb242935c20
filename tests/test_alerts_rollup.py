import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conductrisk.operators import alerts, rollup

SCHEMA = "user string, date timestamp, id string, risk_score double"


def severity(risk):
    return "CRITICAL" if risk >= 95 else "HIGH" if risk >= 85 else "MEDIUM"


def decide(spark, at, hours, scores):
    rows = [("U1", at(h), f"{i:03d}", float(s)) for i, (h, s) in enumerate(zip(hours, scores))]
    return [(r.should_alert, r.alert_severity) for r in alerts.decide(spark.createDataFrame(rows, SCHEMA)).orderBy("date").collect()]


def test_persistence_then_cooldown_then_critical(spark, at):
    got = decide(spark, at, [0, 5 / 60, 10 / 60, 31 / 60, 32 / 60, 33 / 60], [90, 90, 90, 90, 99, 99])
    assert got == [(False, ""), (True, "HIGH"), (False, ""), (False, ""), (False, ""), (True, "CRITICAL")]


def test_full_fold(spark, at):
    got = decide(spark, at, [1, 2, 3, 10, 11, 40, 41, 42, 43], [90, 90, 90, 99, 99, 90, 50, 90, 90])
    assert [g[0] for g in got] == [False, True, False, False, True, False, False, False, True]


def test_stream_step_is_the_same_rule(spark, at):
    rng = np.random.default_rng(1)
    hours = np.cumsum(rng.exponential(6, 200)).tolist()
    scores = rng.choice([10.0, 72.0, 88.0, 97.0], 200).tolist()
    hits, last, want = 0, None, []
    import pandas as pd
    for h, s in zip(hours, scores):
        hits, last, fired = alerts.alert_step(hits, last, s, pd.Timestamp(at(h)))
        want.append((fired, severity(s) if fired else ""))
    assert decide(spark, at, hours, scores) == want


def test_alert_state_totals(spark, at):
    rows = [("A", at(0), "0", 90.0), ("B", at(0), "0", 90.0), ("B", at(1), "1", 90.0), ("C", at(0), "0", 10.0)]
    assert tuple(alerts.alert_state_stats(spark.createDataFrame(rows, SCHEMA)).first()) == (1, 1)


def series(spark, values):
    rows = [("U", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "user string, day date, daily_risk double")


def test_own_baseline(spark):
    r = rollup.baselines(series(spark, [10, 12, 8, 15, 9, 11, 10, 13, 7, 9])).first()
    assert r.baseline_count == 4 and r.baseline_avg == 11.25
    assert r.baseline_std == pytest.approx(np.std([10, 12, 8, 15]))
    assert r.recent_risk == 13


def test_short_series_has_no_baseline(spark):
    r = rollup.drift(rollup.baselines(series(spark, [10, 90, 10]))).first()
    assert not r.is_drift and r.drift_explanation == "Insufficient baseline data"


@pytest.mark.parametrize("history,probe,expected", [
    ([10, 11, 9, 12, 10, 8, 10, 11, 9, 10], 12, False), ([10, 11, 9, 12, 10, 8, 10, 11, 9, 10], 20, True),
    ([5.0] * 10, 30, True), ([5.0] * 10, 10, False),
])
def test_drift(spark, history, probe, expected):
    r = rollup.drift(rollup.baselines(series(spark, history + [history[-1]] * 5 + [probe]))).first()
    assert r.is_drift is expected


def test_recent_risk_weighs_more(spark, at):
    rows = [("new", at(-h), 50.0) for h in (0, 1, 2)] + [("old", at(-24 * d), 50.0) for d in (10, 11, 12)]
    df = spark.createDataFrame(rows, "user string, date timestamp, risk_score double")
    got = {r.user: r for r in rollup.user_risk(df).collect()}
    assert got["new"].decayed_sum > got["old"].decayed_sum
    assert got["new"].total_risk_score == pytest.approx(50 + 0.1 * got["new"].decayed_sum)


def test_correlated_boost(spark, at):
    rows = [("a", "File Copy"), ("a", "USB"), ("b", "File Copy"), ("b", "Logon"), ("c", "USB")]
    df = spark.createDataFrame(rows, "user string, activity string")
    got = {r.user: r.boost for r in rollup.correlation_boost(df).collect()}
    assert got["a"] == pytest.approx(0.08) and got["b"] == 0 and got["c"] == 0


def test_nonlinear_matches_direct_computation(spark, at):
    scores, ages = np.array([10.0, 90.0, 40.0]), np.array([0.0, 2.0, 5.0])
    rows = [("u", at(-24 * a), "x", float(s)) for s, a in zip(scores, ages)]
    r = rollup.nonlinear_risk(spark.createDataFrame(rows, "user string, date timestamp, activity string, risk_score double")).first()
    w = 0.9 ** ages * np.exp(scores / 50) / np.exp(scores / 50).max()
    assert r.base_risk == pytest.approx((scores * w).sum() / max(w.sum(), 1))


def test_rescale_puts_the_maximum_at_97(spark):
    df = spark.createDataFrame([("a", 146.86), ("b", 70.1)], "user string, total_risk_score double")
    assert [r.scaled_risk for r in rollup.rescaled(df).orderBy("user").collect()] == [97.0, round(70.1 / 146.86 * 97, 2)]

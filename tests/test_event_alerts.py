"""Alerts and scores of events where one user owns a large part of the rows, in one batch and over micro-batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conductrisk.operators import alerts, buffers
from conductrisk.session import fresh_path
from conductrisk.streaming import events as SE
from conductrisk.streaming.state import KeyedState

ROWS = "id string, user string, date timestamp, risk_score double, note string"


def event_rows(at, n=600, seed=3):
    """A third of the rows belong to one user, who has quiet days; times repeat, some scores are missing, some users are null."""
    rng = np.random.default_rng(seed)
    gaps = np.where(rng.random(n) < 0.03, 40.0, rng.choice([0.0, 0.1, 2.0, 9.0], n))
    hours = np.cumsum(gaps).tolist()
    scores = rng.choice([5.0, 20.0, 69.0, 72.0, 88.0, 97.0], n, p=[0.2, 0.2, 0.1, 0.3, 0.1, 0.1])
    users = np.where(rng.random(n) < 1 / 3, "hot", rng.choice(["a", "b", "c", ""], n))
    return [(f"{i:05d}", str(u) or None, at(h), None if i % 50 == 7 else float("nan") if i % 50 == 9 else float(s), f"n{i}")
            for i, (u, h, s) in enumerate(zip(users, hours, scores))]


def plain(rows):
    """The rule over the rows of each user in the given order."""
    state, out = {}, {}
    for id_, user, date, risk, _ in rows:
        hits, last, out[id_] = alerts.alert_step(*state.get(user, (0, None)), risk, date)
        state[user] = (hits, last)
    return out, state


def fired(df):
    return {r.id: r.should_alert for r in df.collect()}


@pytest.mark.parametrize("hot_rows", [20, 5_000_000])
def test_events_in_one_batch(spark, at, hot_rows):
    rows = event_rows(at)
    want, state = plain(sorted(rows, key=lambda r: (r[2], r[0])))
    df = spark.createDataFrame(rows, ROWS)
    decided, closing = alerts.decide_events(df, hot_rows=hot_rows)
    assert fired(decided) == want and sum(want.values()) > 20 and decided.count() == len(rows)
    assert decided.columns == [*df.columns, "should_alert", "alert_severity"]
    assert {r.user: (r.hits, r.last) for r in closing.collect()} == state
    bands = {r.alert_severity for r in decided.filter("should_alert").collect()}
    assert bands == {"MEDIUM", "HIGH", "CRITICAL"} and decided.filter("not should_alert and alert_severity <> ''").count() == 0


def test_a_hot_user_is_cut_and_low_rows_stay_out(spark, at):
    """The folded parts of the hot user are many and small."""
    rows = [(f"{i:05d}", "hot", at(i * 3.0), 90.0 if i % 20 < 2 else 10.0, "") for i in range(1000)]
    seen = {}

    def staged(df, name):
        seen[name] = alerts.stage(df, name)
        return seen[name]

    decided, _ = alerts.decide_events(spark.createDataFrame(rows, ROWS), hot_rows=10, staged=staged)
    assert fired(decided) == plain(rows)[0]
    folded = seen["folded"]
    assert folded.count() <= 200
    assert folded.agg(F.count_distinct("__part")).first()[0] >= 8
    assert folded.groupBy("__part").count().agg(F.max("count")).first()[0] <= 40


def test_a_user_without_quiet_days_stays_whole(spark, at):
    rows = [(f"{i:05d}", "hot", at(i * 0.5), [75.0, 97.0, 88.0][i % 3], "") for i in range(300)]
    decided, _ = alerts.decide_events(spark.createDataFrame(rows, ROWS), hot_rows=10)
    assert fired(decided) == plain(rows)[0]


def test_an_opening_state_reaches_the_first_rows_only(spark, at):
    rows = event_rows(at)
    first, second = rows[:250], rows[250:]
    df = lambda part: spark.createDataFrame(part, ROWS)
    _, opening = alerts.decide_events(df(first), hot_rows=20)
    decided, closing = alerts.decide_events(df(second), opening, hot_rows=20)
    want, state = plain(rows)
    assert fired(decided) == {r[0]: want[r[0]] for r in second}
    assert {r.user: (r.hits, r.last) for r in closing.collect()} == {u: state[u] for u in {r[1] for r in second}}


def test_rows_older_than_the_opening_alert(spark, at):
    """Late rows meet an alert that lies after them."""
    early = [(f"{i}", "u", at(500 + i), 90.0, "") for i in range(3)]
    late = [(f"x{i:03d}", "u", at(i * 15.0), 90.0 if i % 4 < 2 else 1.0, "") for i in range(40)]
    _, opening = alerts.decide_events(spark.createDataFrame(early, ROWS))
    decided, _ = alerts.decide_events(spark.createDataFrame(late, ROWS), opening, hot_rows=5)
    want, _ = plain([*early, *late])
    assert fired(decided) == {r[0]: want[r[0]] for r in late}


def test_no_rows(spark):
    decided, closing = alerts.decide_events(spark.createDataFrame([], ROWS))
    assert decided.count() == 0 and closing.count() == 0


EVENTS = "id string, user string, date timestamp, activity string"


def activity_rows(at, n=400):
    names = ["File Copy", "Logon", "File Open", "File Copy"]
    return [(f"{i:04d}", "hot" if i % 3 == 0 else ["a", "b", None][i % 7 % 3], at(i * 0.4), names[(i // 5) % 4]) for i in range(n)]


def test_micro_batches_equal_one_batch(spark, at):
    rows = activity_rows(at)
    roster = spark.createDataFrame([("hot", "Admin"), ("a", "Contractor")], "user string, role string")
    scores = SE.EventScores(spark, fresh_path(spark, "scores"), roster, hot_rows=15, every=2)
    for n, i in enumerate(range(0, 400, 100)):
        scores(spark.createDataFrame(rows[i:i + 100], EVENTS), n)
    # a repeated batch writes the same again
    scores(spark.createDataFrame(rows[300:], EVENTS), 3)
    got = scores.table()
    whole = buffers.buffered_scores(SE.flagged(spark.createDataFrame(rows, EVENTS), roster)).withColumn(
        "risk_score", buffers.event_risk(F.col("anomaly_score"), F.col("role_factor")))
    decided, closing = alerts.decide_events(whole)
    names = ["id", "user", "window_size", "anomaly_score", "risk_score", "should_alert", "alert_severity"]
    assert got.count() == 400 and got.select(names).exceptAll(decided.select(names)).count() == 0
    assert decided.filter("should_alert").count() > 5
    last = scores.state.before(4)
    assert last.select("user", "hits", "last").exceptAll(closing.select("user", "hits", "last")).count() == 0
    assert last.count() == 4 and last.filter(F.size("tail") != 9).count() == 0


def test_state_is_written_whole_now_and_then(spark):
    state = KeyedState(spark, fresh_path(spark, "state"), "k", every=3)
    want = {}
    for n in range(11):
        touched = {f"k{n % 4}": n, "always": n * 10} | ({None: n} if n == 2 else {})
        assert ({r.k: r.v for r in state.before(n).collect()} if n else {}) == want
        state.write(spark.createDataFrame(list(touched.items()), "k string, v long"), n)
        want |= touched
    left = {int(r.batch_id) for r in spark.read.option("basePath", state.base).parquet(state.base).select("batch_id").distinct().collect()}
    assert min(left) == 6 and {r.k: r.v for r in state.before(11).collect()} == want
    with pytest.raises(RuntimeError, match="batch 12 is missing"):
        state.before(13)

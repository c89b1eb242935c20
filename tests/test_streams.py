from pyspark.sql import functions as F

from conductrisk.operators import alerts, buffers
from conductrisk.session import fresh_path
from conductrisk.streaming import events as SE
from conductrisk.streaming import runner
from conductrisk.streaming import telemetry as ST

ROWS = "id string, user string, date timestamp, risk_score double"


def activity(spark, at, n=60):
    names = ["File Copy", "Logon", "File Open"]
    rows = [(f"{i:04d}", f"U{i % 3}", at(i * 0.7), names[(i // 3) % 3]) for i in range(n)]
    return spark.createDataFrame(rows, "id string, user string, date timestamp, activity string")


def replayed(spark, df, schema, slices=4, ts="date"):
    path = fresh_path(spark, "replay")
    runner.stage_replay(df, path, slices, ts)
    return runner.replay(spark, path, schema, 1)


def test_scored_stream_equals_batch(spark, at):
    act = activity(spark, at)
    roster = spark.createDataFrame([("U0", "Admin"), ("U1", "Employee")], "user string, role string")
    stream = replayed(spark, act, "id string, user string, date timestamp, activity string")
    scores = SE.EventScores(spark, fresh_path(spark, "scored"), roster)
    runner.run_batches(stream, scores)
    got = scores.table()
    batch = buffers.buffered_scores(act).select("id", "window_size", F.round("anomaly_score", 9).alias("a"))
    mine = got.select("id", "window_size", F.round("anomaly_score", 9).alias("a"))
    assert mine.exceptAll(batch).count() == 0 and mine.count() == 60
    assert got.select("batch_id").distinct().count() > 1
    texts = {r.explanation for r in got.filter("risk_score >= 50").collect()}
    assert all(t.startswith("Risk score") for t in texts)


def test_alert_stream_equals_batch(spark, at):
    scores = [90, 20, 97, 75, 88, 99, 10, 71]
    rows = [(f"{i:04d}", f"U{i % 2}", at(i * 5), float(scores[(i * 7) % 8])) for i in range(64)]
    df = spark.createDataFrame(rows, ROWS)
    decisions = SE.AlertDecisions(spark, fresh_path(spark, "alerts"))
    runner.run_batches(replayed(spark, df, ROWS), decisions)
    got = decisions.table().drop("batch_id")
    want = alerts.decide(df).select(got.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == 64


def test_duplicates_are_dropped(spark, at):
    act = activity(spark, at)
    stream = replayed(spark, act.unionByName(act), "id string, user string, date timestamp, activity string")
    assert runner.run_to_table(SE.without_duplicates(stream), "once").count() == 60


def test_late_rows_do_not_change_closed_windows(spark, at):
    schema = "id string, date timestamp, risk_score double, should_alert boolean"
    path = fresh_path(spark, "late")
    early = [(str(i), at(i * 0.5), 60.0, False) for i in range(20)]
    late = [("late", at(0.1), 99.0, True), ("end", at(30), 10.0, False)]
    for part in (early, early[:0] + [("far", at(20), 10.0, False)], late):
        spark.createDataFrame(part, schema).repartition(1).write.mode("append").parquet(path)
    got = runner.run_to_table(SE.running_totals(runner.replay(spark, path, schema, 1)), "totals").collect()
    first = [r for r in got if r.start == at(0)]
    assert len(first) == 1 and first[0].events == 2 and first[0].alerts == 0


def test_update_mode_keeps_the_newest_version(spark, at):
    rows = [("U", at(i * 0.2), float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "user_id string, timestamp timestamp, risk_score double")
    stream = replayed(spark, df, "user_id string, timestamp timestamp, risk_score double", 5, "timestamp")
    table = runner.run_to_table(ST.hourly_heat(stream), "heat", mode="update")
    got = runner.latest_per_key(table, ["user_id", "start"])
    assert {r.start: r.event_count for r in got.collect()} == {at(0): 5, at(1): 5}


def test_replay_limit_keeps_the_first_rows(spark, at):
    path = fresh_path(spark, "limited")
    runner.stage_replay(activity(spark, at), path, 3, limit=7)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [f"{i:04d}" for i in range(7)]


def test_a_second_run_goes_on_where_the_first_stopped(spark, at):
    """With the same checkpoint and table a restart reads only what has come since."""
    schema = "user_id string, timestamp timestamp, risk_score double, productivity_score double, id long"
    path, state, base = (fresh_path(spark, n) for n in ("input", "state", "accounts"))
    first = spark.createDataFrame([("A", at(0), 10.0, 1.0, 1), ("B", at(1), 20.0, 1.0, 2)], schema)
    second = spark.createDataFrame([("A", at(2), 30.0, 0.5, 3), ("C", at(1), 5.0, 1.0, 4)], schema)
    for rows in (first, second):
        rows.repartition(1).write.mode("append").parquet(path)
        runner.run_batches(runner.replay(spark, path, schema, 1), ST.account_writer(spark, base), state=state)
    assert runner.latest_version(spark, base) == 1
    accounts = {r.user_id: r.risk_score for r in spark.read.parquet(f"{base}/v1").collect()}
    assert accounts == {"A": 30.0, "B": 20.0, "C": 5.0}
    assert spark.read.parquet(f"{base}/rows").count() == 4


def test_a_missing_version_is_an_error(spark, at):
    import pytest
    rows = spark.createDataFrame([("A", at(0), 10.0, 1.0, 1)],
                                 "user_id string, timestamp timestamp, risk_score double, productivity_score double, id long")
    with pytest.raises(RuntimeError, match="version 2"):
        ST.account_writer(spark, fresh_path(spark, "lost"))(rows, 3)


def test_duplicates_in_later_batches_are_dropped(spark, at):
    """The copy of a row comes two micro-batches later."""
    schema = "id string, user string, date timestamp, activity string"
    path = fresh_path(spark, "copies")
    rows = [(f"{i:03d}", "U", at(i * 0.1), "Logon") for i in range(12)]
    for part in (rows[:4], rows[4:8], rows[:4], rows[8:]):
        spark.createDataFrame(part, schema).repartition(1).write.mode("append").parquet(path)
    stream = runner.replay(spark, path, schema, 1)
    got = [r.id for r in runner.run_to_table(SE.without_duplicates(stream, "2 hours"), "once").collect()]
    assert sorted(got) == [r[0] for r in rows]


TELEMETRY = ("id long, user_id string, timestamp timestamp, role string, active_app string, productivity_score double, "
             "mouse_velocity_avg double, mouse_velocity_std double, keystroke_flight_avg_ms double, keystroke_flight_std_ms double")


def telemetry_rows(at, n=400):
    """Seventeen days of four users; one of them has more than a third of all rows, some share a second."""
    rows = []
    for i in range(n):
        user = "hot" if i % 5 < 2 else f"U{i % 3}"
        rows.append((i, user, at((i // 2) * 2.05), "Employee", ["excel", "steam", "mail"][i % 3], float(i % 4) / 4,
                     10.0 + (i * 7) % 23, 2.0 + i % 3, 100.0 + (i * 11) % 31, 5.0 + i % 7))
    return rows


def scores_of(df):
    return {r.id: (r.has_baseline, None if r.mv_avg is None else round(r.mv_avg, 9), round(r.risk_score, 9)) for r in df.collect()}


def test_live_baselines_equal_the_batch_path(spark, at):
    from conductrisk.operators import telemetry as ops
    df = spark.createDataFrame(telemetry_rows(at), TELEMETRY)
    want = scores_of(ops.score(ops.with_baseline_as_of(df)))
    assert len({x for x in want.values()}) > 50 and not all(x[0] for x in want.values())
    stream = replayed(spark, df, TELEMETRY, 6, "timestamp")
    live = ST.LiveBaselines(spark, fresh_path(spark, "live"))
    runner.run_batches(stream, live)
    assert scores_of(live.table("scored")) == want
    assert live.table("scored").select("batch_id").distinct().count() >= 5
    fresh = {r.id: (r.n, round(r.mv_avg, 9)) for r in live.table("fresh").collect()}
    assert fresh == {r.id: (r.n, round(r.mv_avg, 9)) for r in ops.refreshed_baselines(df).collect()}
    assert live.table("newest").select("batch_id").distinct().count() == 2


def test_a_repeated_batch_changes_nothing(spark, at):
    rows = telemetry_rows(at, 120)
    parts = [spark.createDataFrame(rows[i:i + 40], TELEMETRY) for i in (0, 40, 80)]
    live = ST.LiveBaselines(spark, fresh_path(spark, "again"))
    for i, part in enumerate(parts):
        live(part, i)
    first = scores_of(live.table("scored"))
    live(parts[2], 2)
    assert scores_of(live.table("scored")) == first and len(first) == 120


def test_no_row_sees_its_future(spark, at):
    """Whatever comes later, the scores of the rows before are the same."""
    rows = telemetry_rows(at, 160)
    changed = [(*r[:6], r[6] * 50, *r[7:]) if r[0] >= 100 else r for r in rows]
    found = []
    for version in (rows, changed):
        live = ST.LiveBaselines(spark, fresh_path(spark, "future"))
        for i in range(0, 160, 50):
            live(spark.createDataFrame(version[i:i + 50], TELEMETRY), i // 50)
        found.append({k: v for k, v in scores_of(live.table("scored")).items() if k < 100})
    assert found[0] == found[1]


def test_late_rows_are_set_aside_and_a_lost_version_is_an_error(spark, at):
    import pytest
    rows = telemetry_rows(at, 60)
    live = ST.LiveBaselines(spark, fresh_path(spark, "late"), lateness="10 HOURS")
    live(spark.createDataFrame(rows[:10] + rows[20:40], TELEMETRY), 0)
    live(spark.createDataFrame(rows[10:20] + rows[40:], TELEMETRY), 1)  # rows 10 to 19 are 20 hours old or more
    late = sorted(r.id for r in live.table("late").collect())
    assert late == [r[0] for r in rows[10:20] if r[2] < rows[39][2] - (at(10) - at(0))] and late
    assert sorted([*late, *(r.id for r in live.table("scored").collect())]) == list(range(60))
    with pytest.raises(RuntimeError, match="version 4"):
        live(spark.createDataFrame(rows, TELEMETRY), 5)
    live(spark.createDataFrame([], TELEMETRY), 2)
    assert live.table("newest").count() > 0

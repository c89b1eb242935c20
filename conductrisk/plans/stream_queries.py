"""Queries over sources, sinks and streams. Streams run over all available input."""

from __future__ import annotations

from pyspark.sql import functions as F

from conductrisk import adapters as A
from conductrisk import schemas
from conductrisk.functions.common import after_hours
from conductrisk.operators import alerts, buffers, rollup
from conductrisk.operators import evaluation as E
from conductrisk.operators import telemetry as L
from conductrisk.operators import timeline
from conductrisk.plans import tables as T0
from conductrisk.plans.oracle import STATIC_Z
from conductrisk.plans.registry import D, R, T, query, rounded, text_time
from conductrisk.session import fresh_path, prepare
from conductrisk.sources import readers, sinks
from conductrisk.streaming import events as SE
from conductrisk.streaming import runner
from conductrisk.streaming import telemetry as ST


# --- sources and sinks -----------------------------------------------------------------
@query("csv_log_scan", f'SELECT id, "user", {T("date")}, pc, activity, concat(\'file_\', k) AS filename FROM act WHERE source = \'File\'')
def csv_log_scan(spark, sf):
    path = fresh_path(prepare(spark), "file-log")
    sinks.write_report(text_time(A.raw_logs(A.activity(spark, sf))["file"], "date"), path)
    rows = readers.read_log(spark, path, "file").select("id", "user", "date", "pc", "activity", "filename")
    return text_time(rows, "date")


@query("parquet_timeline_scan", f'SELECT id, "user", {T("date")}, source FROM act')
def parquet_timeline_scan(spark, sf):
    path = fresh_path(prepare(spark), "timeline")
    sinks.write_timeline(timeline.unify(A.raw_logs(A.activity(spark, sf))), path)
    rows = readers.read_timeline(spark, path).select("id", "user", "date", "source")
    return text_time(rows, "date")


@query("timeline_sink_by_day", f"SELECT {D('day')}, source, count(*) AS rows FROM act GROUP BY day, source")
def timeline_sink_by_day(spark, sf):
    path = fresh_path(prepare(spark), "timeline")
    sinks.write_timeline(timeline.unify(A.raw_logs(A.activity(spark, sf))), path)
    written = spark.read.schema(schemas.TIMELINE + ", day date").parquet(path)
    return text_time(written.groupBy("day", "source").agg(F.count("*").alias("rows")), "day")


@query("featured_or_raw_timeline", "SELECT id, hour, isodow(date) - 1 AS day_of_week, CAST(hour < 7 OR hour >= 20 AS INTEGER) AS is_after_hours, 0 AS usb_count FROM act")
def featured_or_raw_timeline(spark, sf):
    path = fresh_path(prepare(spark), "timeline")
    sinks.write_timeline(timeline.unify(A.raw_logs(A.activity(spark, sf))), path)
    rows = readers.read_featured_or_raw(spark, f"{path}-featured", path)
    return rows.select("id", "hour", "day_of_week", "is_after_hours", "usb_count")


@query("featured_timeline", "SELECT id, hour, isodow(date) - 1 AS day_of_week, CAST(hour < 7 OR hour >= 20 AS INTEGER) AS is_after_hours, CAST(source = 'Device' AND activity = 'Connect' AS INTEGER) AS usb_count FROM act")
def featured_timeline(spark, sf):
    """Where a featured table exists it is read, and the raw timeline is left alone."""
    path = fresh_path(prepare(spark), "timeline")
    rows = timeline.unify(A.raw_logs(A.activity(spark, sf)))
    featured = rows.withColumns({
        "hour": F.hour("date"), "day_of_week": F.weekday("date"), "is_after_hours": after_hours(F.hour("date")).cast("int"),
        "usb_count": ((F.col("source") == "Device") & (F.col("activity") == "Connect")).cast("int")})
    sinks.write_table(featured, f"{path}-featured")
    back = readers.read_featured_or_raw(spark, f"{path}-featured", f"{path}-missing")
    return back.select("id", "hour", "day_of_week", "is_after_hours", "usb_count")


@query("feature_table_sinks", "SELECT format, count(*) AS rows, sum(file_count)::BIGINT AS files FROM daily, (SELECT unnest(['csv', 'parquet']) AS format) GROUP BY 1")
def feature_table_sinks(spark, sf):
    """The feature table as CSV and as Parquet."""
    daily = T0.stage(T0.daily(spark, sf), "daily").select("user", "day", "file_count")
    path = fresh_path(spark, "features")
    sinks.write_report(daily, f"{path}-csv")
    back = {"csv": readers.spark_csv(spark, f"{path}-csv", daily.schema), "parquet": sinks.write_table(daily, f"{path}-parquet")}
    parts = [df.agg(F.count("*").alias("rows"), F.sum("file_count").alias("files")).select(F.lit(n).alias("format"), "rows", "files")
             for n, df in back.items()]
    return parts[0].unionByName(parts[1])


@query("source_sinks", "SELECT source, count(*) AS rows FROM act GROUP BY 1")
def source_sinks(spark, sf):
    """Every cleaned source as a Parquet table of its own."""
    path, out = fresh_path(prepare(spark), "source"), None
    for kind, df in A.raw_logs(A.activity(spark, sf)).items():
        part = sinks.write_table(df, f"{path}-{kind}").agg(F.count("*").alias("rows"))
        part = part.select(F.lit(kind.capitalize()).alias("source"), "rows").filter("rows > 0")
        out = part if out is None else out.unionByName(part)
    return out


@query("report_sinks", """
SELECT 'events' AS report, count(*) AS rows, round(sum(round(risk_score, 6)), 3) + 0.0 AS total FROM scored UNION ALL SELECT 'users', count(*), round(sum(round(total_risk_score, 6)), 3) + 0.0 FROM report
UNION ALL SELECT 'alerts', count(*), coalesce(round(sum(round(risk_score, 6)), 3), 0) + 0.0 FROM alerted WHERE should_alert""")
def report_sinks(spark, sf):
    days = T0.scored_days(spark, sf)
    parts = {
        "events": days.select("user", "day", F.round("risk_score", 6).alias("score")),
        "users": rollup.user_report(days).select("user", F.round("total_risk_score", 6).alias("score")),
        "alerts": alerts.decide(days).filter("should_alert").select("user", "day", F.round("risk_score", 6).alias("score")),
    }
    out = None
    for name, df in parts.items():
        path = fresh_path(spark, name)
        sinks.write_report(df, path)
        back = readers.spark_csv(spark, path, df.schema)
        part = back.agg(F.count("*").alias("rows"), (F.round(F.coalesce(F.sum("score"), F.lit(0.0)), 3) + 0.0).alias("total"))
        part = part.select(F.lit(name).alias("report"), "rows", "total")
        out = part if out is None else out.unionByName(part)
    return out


@query("feedback_appends", """SELECT "user" AS user_id, '2024-01-15' AS day, user_key % 2 = 0 AS is_false_positive FROM roster""")
def feedback_appends(spark, sf):
    path = fresh_path(prepare(spark), "feedback")
    rows = A.roster(spark, sf).select(F.col("user").alias("user_id"), F.lit("2024-01-15").alias("day"), (F.col("user_key") % 2 == 0).alias("is_false_positive"))
    sinks.append_feedback(rows.filter("is_false_positive"), path)
    sinks.append_feedback(rows.filter("not is_false_positive"), path)
    return readers.spark_csv(spark, path, schemas.FEEDBACK)


@query("metrics_sink", f"""
SELECT tp, fp, fn, tn FROM (SELECT count_if(label = 1 AND hit) AS tp, count_if(label = 0 AND hit) AS fp, count_if(label = 1 AND NOT hit) AS fn, count_if(label = 0 AND NOT hit) AS tn FROM (
SELECT risk_score >= 70 AS hit, CAST("user" = 'U5' AND date_diff('day', (SELECT min(date) FROM scored), date) >= 25 AS INTEGER) AS label FROM scored))""")
def metrics_sink(spark, sf):
    path = fresh_path(prepare(spark), "metrics")
    sinks.write_metrics(E.confusion(timeline.with_truth_by_offset(T0.scored_days(spark, sf))), path)
    return spark.read.schema("tp bigint, fp bigint, fn bigint, tn bigint").json(path)


@query("evaluation_sink", f"""
SELECT total_users, threat_user_rank, detected, high_risk_events, users_with_false_positives FROM
 (SELECT count(*) AS total_users, count_if(s > (SELECT s FROM rr WHERE "user" = 'U5')) + 1 AS threat_user_rank FROM rr),
 (SELECT count_if(risk_score >= 70) > 0 AS detected, count_if(risk_score >= 70) AS high_risk_events FROM scored WHERE "user" = 'U5'),
 (SELECT count_if(n > 0) AS users_with_false_positives FROM (SELECT "user", count_if(risk_score >= 70) AS n FROM scored WHERE "user" <> 'U5' GROUP BY 1))""",
       rr='SELECT "user", round(total_risk_score, 6) AS s FROM report')
def evaluation_sink(spark, sf):
    """The whole evaluation result as one JSON document."""
    days = T0.scored_days(spark, sf)
    report = T0.stage(rounded(rollup.user_report(days), "total_risk_score"), "report")
    result = E.summary(timeline.with_truth_by_offset(days), report)
    path = fresh_path(spark, "evaluation")
    sinks.write_metrics(result, path)
    return spark.read.schema(result.schema).json(path).select(
        "total_users", "threat_user_rank", "detection.detected", "detection.high_risk_events",
        "false_positives.users_with_false_positives")


@query("artifact_status")
def artifact_status(spark, sf):
    """Which of the expected tables exist in the data folder."""
    prepare(spark)
    expected = [("events", "events.parquet"), ("customers", "customer.parquet"), ("missing model", "model.bin")]
    return readers.artifact_status(spark, sf, expected)


@query("user_dimension_scan", 'SELECT "user" AS id, role, department AS dept, pc FROM roster')
def user_dimension_scan(spark, sf):
    path = fresh_path(prepare(spark), "users")
    users = A.roster(spark, sf).select(F.col("user").alias("id"), "role", F.col("department").alias("dept"), "pc")
    sinks.write_report(users, path)
    return readers.read_users(spark, path)


# --- event streams ----------------------------------------------------------------------
_BUFFER = """
SELECT a.id, a."user", a.date, r.role, a.activity, count(*) OVER f AS n, count(*) FILTER (WHERE hour < 7 OR hour > 20) OVER f AS odd, count(*) FILTER (WHERE contains(activity, 'Copy')) OVER f AS copies
FROM act a LEFT JOIN roster r ON r."user" = a."user" WINDOW f AS (PARTITION BY a."user" ORDER BY date, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""
_PROXY = """
SELECT *, CASE WHEN n < 2 THEN 0.0::DOUBLE ELSE least(0.3::DOUBLE, n / 30.0::DOUBLE) + 0.2::DOUBLE * (odd / n::DOUBLE) + 0.3::DOUBLE * least(1.0::DOUBLE, copies / 5.0::DOUBLE) END AS score,
  CASE role WHEN 'Admin' THEN 1.5::DOUBLE WHEN 'Contractor' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM buf"""
_EVRISK = """SELECT *, least(100.0::DOUBLE, least(100.0::DOUBLE, greatest(0.0::DOUBLE, score - 0.16::DOUBLE) * 250) * factor) AS risk_score FROM prox"""
_EVFOLD = """SELECT "user", date, risk_score, id, row_number() OVER (PARTITION BY "user" ORDER BY date, id) AS i FROM evrisk"""
_EVALERT = """SELECT r.id, f.fired FROM fold_rows r JOIN fold f ON f."user" = r."user" AND f.i = r.i"""
_EV = {"buf": _BUFFER, "prox": _PROXY, "evrisk": _EVRISK, "fold_rows": _EVFOLD, "evalert": _EVALERT}


@query("last_ten_events_proxy", f"SELECT id, n AS window_size, {R('score', 'anomaly_score')} FROM prox", **_EV)
def last_ten_events_proxy(spark, sf):
    rows = buffers.buffered_scores(A.activity(spark, sf)).select("id", "window_size", "anomaly_score")
    return rounded(rows, "anomaly_score")


def _roster(spark, sf):
    """User and role, written once: every micro-batch joins them, and would work the roster out of all events again."""
    return T0.stage(A.roster(spark, sf).select("user", "role"), "roster")


def _activity_stream(spark, sf):
    """Events as a replayed stream: time-ordered files, several micro-batches."""
    path = fresh_path(prepare(spark), "replay")
    files = runner.stage_replay(A.table(spark, sf, "events"), path, 8, "ts")
    return runner.replay(spark, path, schemas.EVENTS, files_per_trigger=2 * files)


@query("replayed_events", f"SELECT event_id, {T('ts')} FROM events")
def replayed_events(spark, sf):
    return text_time(runner.run_to_table(_activity_stream(spark, sf).select("event_id", "ts"), "replayed").drop("batch_id"), "ts")


def _scored_stream(spark, sf):
    return _scored_events_of(spark, sf, A.as_activity(A.as_events(_activity_stream(spark, sf))))


def _scored_events_of(spark, sf, stream):
    scores = SE.EventScores(spark, fresh_path(spark, "event-scores"), _roster(spark, sf))
    runner.run_batches(stream, scores)
    return scores.table()


@query("stream_scored_events", f"""
SELECT e.id, n AS window_size, {R("score", "anomaly_score")}, {R("risk_score")}, a.fired AS should_alert, CASE WHEN NOT a.fired THEN '' WHEN risk_score >= 95 THEN 'CRITICAL' WHEN risk_score >= 85 THEN 'HIGH' ELSE 'MEDIUM' END AS alert_severity
FROM evrisk e JOIN evalert a ON a.id = e.id""", **_EV)
def stream_scored_events(spark, sf):
    rows = _scored_stream(spark, sf).select("id", "window_size", "anomaly_score", "risk_score", "should_alert", "alert_severity")
    return rounded(rows, "anomaly_score", "risk_score")


@query("event_alert_decisions", f"""
SELECT e.id, a.fired AS should_alert, CASE WHEN NOT a.fired THEN '' WHEN risk_score >= 95 THEN 'CRITICAL' WHEN risk_score >= 85 THEN 'HIGH' ELSE 'MEDIUM' END AS alert_severity
FROM evrisk e JOIN evalert a ON a.id = e.id""", **_EV)
def event_alert_decisions(spark, sf):
    """The alert rule over all events in one batch."""
    rows = SE.flagged(A.activity(prepare(spark), sf), A.roster(spark, sf))
    rows = buffers.buffered_scores(rows).withColumn("risk_score", buffers.event_risk(F.col("anomaly_score"), F.col("role_factor")))
    decided, _ = alerts.decide_events(rows.select("id", "user", "date", "risk_score"))
    return decided.select("id", "should_alert", "alert_severity")


@query("stream_running_totals", f"""
SELECT {T("h", "start")}, count(*) AS events, count_if(risk_score > 50) AS high_risk, count_if(fired) AS alerts FROM (SELECT date_trunc('hour', e.date) AS h, e.risk_score, a.fired FROM evrisk e JOIN evalert a ON a.id = e.id) GROUP BY h""", **_EV)
def stream_running_totals(spark, sf):
    scored = _scored_stream(spark, sf).select("id", "date", "risk_score", "should_alert")
    path = fresh_path(spark, "scored-replay")
    files = runner.stage_replay(scored, path, 4)
    stream = runner.replay(spark, path, "id string, date timestamp, risk_score double, should_alert boolean", files)
    table = runner.run_to_table(SE.running_totals(stream), "totals", mode="update")
    return text_time(runner.latest_per_key(table, ["start"]), "start")


@query("stream_alerts", f'SELECT "user", {D("date", "day")}, should_alert, alert_severity FROM alerted')
def stream_alerts(spark, sf):
    path = fresh_path(prepare(spark), "days")
    days = T0.scored_days(spark, sf).select("id", "user", "date", "risk_score")
    files = runner.stage_replay(days, path, 6)
    stream = runner.replay(spark, path, "id string, user string, date timestamp, risk_score double", files)
    decisions = SE.AlertDecisions(spark, fresh_path(spark, "alerts"))
    runner.run_batches(stream, decisions)
    return text_time(decisions.table().select("user", F.to_date("date").alias("day"), "should_alert", "alert_severity"), "day")


@query("stream_without_duplicates", "SELECT event_id FROM events")
def stream_without_duplicates(spark, sf):
    """Every event is delivered twice; the stream keeps one of each."""
    path = fresh_path(prepare(spark), "twice")
    raw = A.table(spark, sf, "events")
    files = runner.stage_replay(raw.unionByName(raw), path, 6, "ts")
    stream = A.as_activity(A.as_events(runner.replay(spark, path, schemas.EVENTS, 2 * files)))
    rows = runner.run_to_table(SE.without_duplicates(stream).select("id"), "once")
    return rows.select(F.substring("id", 2, 12).cast("bigint").alias("event_id"))


def _delivered_again(spark, sf):
    """Events as a stream in which the copy of each event comes half a day of events after it, so in a later micro-batch."""
    path = fresh_path(prepare(spark), "again")
    raw = A.table(spark, sf, "events")
    sent = raw.withColumn("sent", F.col("ts")).unionByName(raw.withColumn("sent", F.col("ts") + F.expr("INTERVAL 5 DAYS")))
    files = runner.stage_replay(sent, path, 8, "sent")
    return runner.replay(spark, path, schemas.EVENTS, files_per_trigger=files)


@query("stream_copies_in_later_batches", "SELECT event_id FROM events")
def stream_copies_in_later_batches(spark, sf):
    """Every event is delivered again after days; the copies are repeated or late, and none is kept."""
    stream = A.as_activity(A.as_events(_delivered_again(spark, sf)))
    rows = runner.run_to_table(SE.without_duplicates(stream, "6 days").select("id"), "once")
    return rows.select(F.substring("id", 2, 12).cast("bigint").alias("event_id"))


@query("stream_scored_without_copies", f"""
SELECT e.id, n AS window_size, {R("score", "anomaly_score")}, {R("risk_score")}, a.fired AS should_alert FROM evrisk e JOIN evalert a ON a.id = e.id""", **_EV)
def stream_scored_without_copies(spark, sf):
    """The duplicate filter in front of scores and alerts: the same as without the copies."""
    stream = SE.without_duplicates(A.as_activity(A.as_events(_delivered_again(spark, sf))), "6 days")
    out = _scored_events_of(spark, sf, stream)
    return rounded(out.select("id", "window_size", "anomaly_score", "risk_score", "should_alert"), "anomaly_score", "risk_score")


# --- telemetry streams --------------------------------------------------------------------
_PAYLOAD_ROWS = """
SELECT t.* EXCLUDE (keystroke_flight_avg_ms, keystroke_flight_std_ms, keystroke_count, active_app), CASE WHEN id % 3 = 0 THEN 0.0::DOUBLE ELSE keystroke_flight_avg_ms END AS keystroke_flight_avg_ms,
  CASE WHEN id % 3 = 0 THEN 0.0::DOUBLE ELSE keystroke_flight_std_ms END AS keystroke_flight_std_ms, keystroke_count, CASE WHEN id % 5 = 0 THEN 'unknown' ELSE active_app END AS active_app, coalesce(r.role, 'Employee') AS role
FROM telemetry t LEFT JOIN roster r ON r."user" = t.user_id"""


_LIVE = {"tele_role": _PAYLOAD_ROWS, "tele_z": STATIC_Z}


def _live_stream(spark, sf):
    """Payloads in order of time, scored against the baselines that are stored when the stream starts."""
    rows = L.flatten_payload(A.as_payload(A.events(spark, sf)))
    roster = _roster(spark, sf)
    prepared = L.with_productivity(L.with_user_role(rows, roster))
    # the newest time and the means read the payloads, which are parsed once
    prepared = T0.stage(prepared.select("user_id", "timestamp", *L.MEASURES.values()), "prepared")
    base = T0.stage(L.user_baselines(prepared, rollup.latest(prepared, "timestamp")), "baselines")
    payloads = A.as_payload(A.as_events(_activity_stream(spark, sf)))
    return ST.live_scores(payloads, roster, base)


def _second_stream(spark, sf, events, files_per_trigger=2):
    """Events as a replayed stream whose slices end with a second, as baselines are refreshed with whole seconds."""
    path = fresh_path(prepare(spark), "seconds")
    files = runner.stage_replay(events, path, 8, "ts", unit=1_000_000)
    return runner.replay(spark, path, schemas.EVENTS, files_per_trigger=files_per_trigger * files)


@query("stream_live_scores", f"SELECT id, user_id, {R('risk_score')}, mitre_tactic FROM tele", tele_role=_PAYLOAD_ROWS)
def stream_live_scores(spark, sf):
    """Scored with baselines that the stream itself keeps and refreshes: the rows and scores of the batch path."""
    payloads = A.as_payload(A.as_events(_second_stream(spark, sf, A.table(spark, sf, "events"))))
    live = ST.LiveBaselines(spark, fresh_path(spark, "live-baselines"))
    runner.run_batches(ST.prepared(payloads, _roster(spark, sf)), live)
    return rounded(live.table("scored").select("id", "user_id", "risk_score", "mitre_tactic"), "risk_score")


@query("stream_refreshed_baselines", f"""
SELECT id, user_id, n, {", ".join(R(x, digits=9) for x in ["mv_avg", "mv_std", "kf_avg", "kf_std", "prod_avg"])} FROM fresh_base""", tele_role=_PAYLOAD_ROWS)
def stream_refreshed_baselines(spark, sf):
    payloads = A.as_payload(A.as_events(_second_stream(spark, sf, A.table(spark, sf, "events"))))
    live = ST.LiveBaselines(spark, fresh_path(spark, "live-baselines"))
    runner.run_batches(ST.prepared(payloads, _roster(spark, sf)), live)
    return rounded(live.table("fresh").drop("batch_id"), *L.MEASURES, digits=9)


@query("stream_late_rows", f"""
SELECT event_id AS id, {T("ts", "timestamp")}, ts < (SELECT max(ts) FROM events WHERE event_id % 13 <> 0) - INTERVAL 1 DAY AS late FROM events WHERE event_id % 13 = 0""")
def stream_late_rows(spark, sf):
    """Each thirteenth event comes after all others. The ones from before the last day are set aside, the rest is scored."""
    path, raw = fresh_path(prepare(spark), "late-rows"), A.table(spark, sf, "events")
    files = runner.stage_replay(raw.filter("event_id % 13 <> 0"), path, 4, "ts", unit=1_000_000)
    runner.stage_replay(raw.filter("event_id % 13 = 0"), path, 1, "ts", files_per_slice=files)
    payloads = A.as_payload(A.as_events(runner.replay(spark, path, schemas.EVENTS, files_per_trigger=files)))
    live = ST.LiveBaselines(spark, fresh_path(spark, "live-baselines"), lateness="1 DAY")
    runner.run_batches(ST.prepared(payloads, _roster(spark, sf)), live)
    rows = live.table("late").select("id", "timestamp", F.lit(True).alias("late")).unionByName(
        live.table("scored").filter("id % 13 = 0").select("id", "timestamp", F.lit(False).alias("late")))
    return text_time(rows, "timestamp")


@query("stream_fixed_baseline_scores", f"SELECT id, user_id, {R('risk_score')}, mitre_tactic FROM tele", **_LIVE)
def stream_fixed_baseline_scores(spark, sf):
    """Scored with the baselines that are stored when the stream starts."""
    out = runner.run_to_table(_live_stream(spark, sf).select("id", "user_id", "risk_score", "mitre_tactic"), "live")
    return rounded(out.drop("batch_id"), "risk_score")


def _telemetry_stream(spark, sf):
    return A.as_telemetry(A.as_events(_activity_stream(spark, sf)))


@query("stream_flush_summary", f"""
SELECT user_id, {T("w", "start")}, {R("avg(mouse_velocity_avg)", "velocity_avg")}, CAST(sum(keystroke_count) AS BIGINT) AS keys FROM (SELECT *, time_bucket(INTERVAL 5 SECOND, timestamp) AS w FROM telemetry) GROUP BY user_id, w""")
def stream_flush_summary(spark, sf):
    table = runner.run_to_table(ST.flush_summary(_telemetry_stream(spark, sf)), "flush", mode="update")
    rows = runner.latest_per_key(table, ["user_id", "start"])
    return text_time(rounded(rows.select("user_id", "start", "velocity_avg", "keys"), "velocity_avg"), "start")


@query("stream_session_entropy", f"""
SELECT "user", {T("w", "start")}, {R("greatest(0.0::DOUBLE, log2(sum(n)::DOUBLE) - sum(n * log2(n::DOUBLE)) / sum(n))", "activity_entropy")} FROM (SELECT "user", time_bucket(INTERVAL 5 MINUTE, timestamp) AS w, activity_type, count(*) AS n FROM bio GROUP BY ALL) GROUP BY "user", w""")
def stream_session_entropy(spark, sf):
    stream = A.as_biometrics(A.as_events(_activity_stream(spark, sf)))
    table = runner.run_to_table(ST.activity_counts(stream), "entropy", mode="update")
    rows = ST.entropy_of_windows(runner.latest_per_key(table, ["user", "start", "activity_type"]))
    return text_time(rounded(rows, "activity_entropy"), "start")


@query("stream_sliding_baselines", f"""
SELECT user_id, {T("w", "as_of")}, {R("avg(mouse_velocity_avg)", "mv_avg", 9)}, {R("avg(keystroke_flight_avg_ms)", "kf_avg", 9)}, {R("avg(productivity_score)", "prod_avg", 9)}
FROM (SELECT user_id, mouse_velocity_avg, keystroke_flight_avg_ms, productivity_score, date_trunc('day', timestamp) + to_days(CAST(d AS INTEGER)) AS w FROM tele, range(1, 8) r(d)) GROUP BY user_id, w""", **_LIVE)
def stream_sliding_baselines(spark, sf):
    table = runner.run_to_table(ST.sliding_baselines(_live_stream(spark, sf)), "sliding", mode="update")
    rows = runner.latest_per_key(table, ["user_id", "as_of"]).select("user_id", "as_of", "mv_avg", "kf_avg", "prod_avg")
    return text_time(rounded(rows, "mv_avg", "kf_avg", "prod_avg", digits=9), "as_of")


@query("stream_hourly_heat", f"""
SELECT user_id, {T("date_trunc('hour', timestamp)", "start")}, {R("avg(risk_score)", "avg_risk")}, count(*) AS event_count FROM tele GROUP BY user_id, date_trunc('hour', timestamp)""", **_LIVE)
def stream_hourly_heat(spark, sf):
    table = runner.run_to_table(ST.hourly_heat(_live_stream(spark, sf)), "heat", mode="update")
    return text_time(rounded(runner.latest_per_key(table, ["user_id", "start"]), "avg_risk"), "start")


@query("stream_account_updates", f"SELECT user_id, {R('risk_score')}, productivity_score, {T('last_seen')} FROM latest_tele", **_LIVE)
def stream_account_updates(spark, sf):
    """Append each scored micro-batch, and keep the newest state per user in a versioned table."""
    base = fresh_path(spark, "accounts")
    runner.run_batches(_live_stream(spark, sf), ST.account_writer(spark, base))
    state = spark.read.parquet(f"{base}/v{runner.latest_version(spark, base)}")
    return text_time(rounded(state, "risk_score"), "last_seen")

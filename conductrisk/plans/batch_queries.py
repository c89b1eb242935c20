"""Queries of the batch path: timeline, daily features, scores, alerts, roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from conductrisk import adapters as A
from conductrisk.functions import riskrules
from conductrisk.functions.common import relative_time, session_state, clean_app, session_id
from conductrisk.operators import alerts, daily, rollup, sequences, timeline
from conductrisk.operators.ordered import previous
from conductrisk.plans import tables as T0
from conductrisk.plans.registry import D, R, T, query, rounded, text_time


@query("source_tagged_timeline", "SELECT id, source, activity, '' AS content FROM act")
def source_tagged_timeline(spark, sf):
    logs = A.raw_logs(A.activity(spark, sf))
    parts = [
        timeline.with_defaults_content(timeline.tag_source(df, kind)) for kind, df in logs.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("unified_timeline", f'SELECT id, "user", {T("date")}, pc, source, activity FROM act')
def unified_timeline(spark, sf):
    return text_time(timeline.unify(A.raw_logs(A.activity(spark, sf))), "date")


@query("ordered_timeline", f'SELECT id, "user", {T("date")}, source FROM act ORDER BY act.date, id')
def ordered_timeline(spark, sf):
    rows = timeline.unify(A.raw_logs(A.activity(spark, sf))).select("id", "user", "date", "source")
    return text_time(rows.orderBy("date", "id"), "date")


@query("behaviour_log_union", """
SELECT id, source, activity, is_file_copy, is_delete, is_usb_connect, to_removable_media AS is_removable
FROM flags WHERE not_web""")
def behaviour_log_union(spark, sf):
    return timeline.prepare_behaviour(A.raw_logs(A.activity(spark, sf))).select(
        "id", "source", "activity", "is_file_copy", "is_delete", "is_usb_connect", "is_removable")


@query("renamed_user_dimension", 'SELECT "user", role, department, pc FROM roster')
def renamed_user_dimension(spark, sf):
    raw = A.roster(spark, sf).select(F.col("user").alias("id"), "role", F.col("department").alias("dept"), "pc")
    return timeline.rename_users(raw)


@query("event_date_parts", f'SELECT id, {D("day")}, hour, isodow(date) - 1 AS day_of_week FROM act')
def event_date_parts(spark, sf):
    rows = timeline.with_date_parts(A.activity(spark, sf)).select("id", "day", "hour", "day_of_week")
    return text_time(rows, "day")


@query("parsed_text_dates", f"""
SELECT event_id, CASE WHEN k % 10 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS day, CASE WHEN k % 10 = 0 THEN -1 ELSE hour(ts) END AS hour
FROM ev""")
def parsed_text_dates(spark, sf):
    raw = A.events(spark, sf).withColumn("text", F.when(F.col("k") % 10 == 0, F.lit("not a date")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    rows = timeline.with_text_dates(raw, "text").select("event_id", "day", F.coalesce("hour", F.lit(-1)).alias("hour"))
    return text_time(rows, "day")


@query("after_hours_variants", """
SELECT id, (hour < 7 OR hour >= 20) AS ah_features, (hour < 7 OR hour > 20) AS ah_event, (hour < 8 OR hour > 20) AS ah_live_tactic, (hour < 6 OR hour > 22) AS ah_context
FROM act""")
def after_hours_variants(spark, sf):
    return timeline.with_after_hours_variants(A.activity(spark, sf)).select(
        "id", "ah_features", "ah_event", "ah_live_tactic", "ah_context")


@query("truth_label_by_date", """
SELECT id, CAST("user" = 'U5' AND day >= DATE '2024-01-20' AS INTEGER) AS label FROM act""")
def truth_label_by_date(spark, sf):
    return timeline.with_truth_by_date(A.activity(spark, sf)).select("id", "label")


@query("truth_label_by_offset", """
SELECT id, CAST(floor((epoch_us(date) - epoch_us((SELECT min(date) FROM act))) / 86400000000.0::DOUBLE) AS INTEGER) AS day_offset,
  CAST("user" = 'U5' AND floor((epoch_us(date) - epoch_us((SELECT min(date) FROM act))) / 86400000000.0::DOUBLE) >= 25 AS INTEGER) AS label
FROM act""")
def truth_label_by_offset(spark, sf):
    return timeline.with_truth_by_offset(A.activity(spark, sf)).select("id", "day_offset", "label")


_SCHEMA_CHECK = """
SELECT id, 'file' AS kind, activity IN ('File Open', 'File Copy', 'File Write') OR (activity = 'File Delete' AND k % 3 <> 0) AS is_valid FROM act WHERE source = 'File'
UNION ALL SELECT id, 'device', k % 4 <> 0 FROM act WHERE source = 'Device'
UNION ALL SELECT id, 'http', k % 5 <> 0 FROM act WHERE source = 'Http'
UNION ALL SELECT id, 'logon', TRUE FROM act WHERE source = 'Logon'"""


def _broken_logs(spark, sf):
    """The raw logs with some rows spoilt."""
    logs = A.raw_logs(A.activity(spark, sf).withColumn("bad3", F.col("k") % 3 == 0))
    k = {kind: df for kind, df in logs.items()}
    act = A.activity(spark, sf).select("id", "k")
    return {
        "file": k["file"].join(act, "id").withColumn("activity", F.when(
            (F.col("activity") == "File Delete") & (F.col("k") % 3 == 0), "Shred").otherwise(F.col("activity"))),
        "device": k["device"].join(act, "id").withColumn("pc", F.when(F.col("k") % 4 != 0, F.col("pc"))),
        "http": k["http"].join(act, "id").withColumn("url", F.when(F.col("k") % 5 != 0, F.col("url"))),
        "logon": k["logon"],
    }


@query("quarantined_rows", "SELECT id, kind, CASE WHEN is_valid THEN 'valid' ELSE 'quarantine' END AS part FROM checked", checked=_SCHEMA_CHECK)
def quarantined_rows(spark, sf):
    out = None
    for kind, df in _broken_logs(spark, sf).items():
        for name, part in zip(("valid", "quarantine"), timeline.split_valid(df, kind)):
            rows = part.select("id", F.lit(kind).alias("kind"), F.lit(name).alias("part"))
            out = rows if out is None else out.unionByName(rows)
    return out


@query("log_schema_check", _SCHEMA_CHECK)
def log_schema_check(spark, sf):
    out = None
    for kind, df in _broken_logs(spark, sf).items():
        part = timeline.validity(df, kind).select("id", F.lit(kind).alias("kind"), "is_valid")
        out = part if out is None else out.unionByName(part)
    return out


@query("text_flag_parsing", """
SELECT event_id, k % 4 IN (0, 1) AS strict_flag, k % 4 IN (0, 1, 2) AS loose_flag FROM ev""")
def text_flag_parsing(spark, sf):
    from conductrisk.functions.common import to_bool
    text = F.element_at(F.array(*[F.lit(x) for x in (" True", "1", "Yes ", "no")]), (F.col("k") % 4 + 1).cast("int"))
    ev = A.events(spark, sf).withColumn("flag", text)
    return ev.select("event_id", to_bool("flag").alias("strict_flag"), to_bool("flag", yes=True).alias("loose_flag"))


@query("defensive_numbers", """
SELECT event_id, CASE WHEN k % 9 = 0 THEN 0.0::DOUBLE ELSE round(value / 4, 4) + 0.0 END AS amount,
  CASE WHEN k % 7 = 0 THEN NULL ELSE concat('W', k) END AS label, k % 3 = 0 AS flag FROM ev""")
def defensive_numbers(spark, sf):
    k = F.col("k")
    raw = A.events(spark, sf).select(
        "event_id",
        F.when(k % 9 == 0, "n/a").otherwise((F.col("value") / 4).cast("string")).alias("amount"),
        F.when(k % 7 == 0, "  ").otherwise(F.concat(F.lit(" W"), k, F.lit(" "))).alias("label"),
        F.when(k % 3 == 0, "YES").otherwise("0").alias("flag"),
    )
    return timeline.clean_report(raw, ["amount"], ["label"], ["flag"])


@query("event_time_fallback", "SELECT event_id, CASE WHEN k % 4 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS timestamp FROM ev")
def event_time_fallback(spark, sf):
    raw = A.events(spark, sf).select(
        "event_id",
        F.when(F.col("k") % 4 == 0, " ").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("date"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )
    return timeline.event_time_text(raw).select("event_id", "timestamp")


@query("user_defaults", """
SELECT "user", CASE WHEN user_key % 4 = 0 THEN 'Employee' ELSE role END AS role, CASE WHEN user_key % 6 = 0 THEN 'General' ELSE department END AS department FROM roster""")
def user_defaults(spark, sf):
    raw = A.roster(spark, sf).select(
        "user", F.when(F.col("user_key") % 4 != 0, F.col("role")).alias("role"),
        F.when(F.col("user_key") % 6 != 0, F.col("department")).alias("department"))
    return timeline.fill_user_defaults(raw)


@query("optional_columns_added", "SELECT event_id, value, 1.0::DOUBLE AS productive_app_ratio, 'Low' AS entropy_risk_level FROM ev")
def optional_columns_added(spark, sf):
    from conductrisk.functions.common import with_defaults
    ev = A.events(spark, sf).select("event_id", "value")
    return with_defaults(ev, {"value": 0.0, "productive_app_ratio": 1.0, "entropy_risk_level": "Low"})


# --- daily features ---------------------------------------------------------------
@query("seconds_since_previous_event", f'SELECT "user", {D("day")}, id, {R("gap", "gap_seconds")} FROM (SELECT "user", day, id, (epoch_us(date) - lag(epoch_us(date)) OVER (PARTITION BY "user", day ORDER BY date, id)) / 1000000.0::DOUBLE AS gap FROM act)')
def seconds_since_previous_event(spark, sf):
    rows = timeline.with_date_parts(A.activity(spark, sf)).select("user", "day", "id", "date")
    lagged = previous(rows, ["user", "day"], "date", "id", {"before": "date"})
    gap = (F.unix_micros("date") - F.unix_micros("before")) / 1e6
    return text_time(rounded(lagged.select("user", "day", "id", gap.alias("gap_seconds")), "gap_seconds"), "day")


@query("daily_behaviour_counts", f"""
SELECT "user", {D("day")}, file_copy_count, usb_count, removable_media_count, delete_count, after_hours_count, event_count, {R("after_hours_ratio")}
FROM day_counts WHERE event_count > 0""")
def daily_behaviour_counts(spark, sf):
    flagged = timeline.prepare_behaviour(A.raw_logs(A.activity(spark, sf)))
    return text_time(rounded(daily.behaviour_counts(flagged), "after_hours_ratio"), "day")


@query("daily_after_hours_ratio", f'SELECT "user", {D("day")}, {R("after_hours_ratio")} FROM day_counts WHERE event_count > 0')
def daily_after_hours_ratio(spark, sf):
    flagged = timeline.prepare_behaviour(A.raw_logs(A.activity(spark, sf)))
    return text_time(rounded(daily.behaviour_counts(flagged).select("user", "day", "after_hours_ratio"), "after_hours_ratio"), "day")


@query("daily_source_counts", f'SELECT "user", {D("day")}, file_count, email_count FROM day_counts')
def daily_source_counts(spark, sf):
    return text_time(daily.source_counts(A.activity(spark, sf)), "day")


@query("daily_activity_variance", f'SELECT "user", {D("day")}, {R("iav", digits=1)} FROM day_iav')
def daily_activity_variance(spark, sf):
    return text_time(rounded(daily.activity_variance(A.activity(spark, sf)), "iav", digits=1), "day")


@query("daily_odd_hours", f'SELECT "user", {D("day")}, {R("oaf")} FROM day_counts')
def daily_odd_hours(spark, sf):
    return text_time(rounded(daily.odd_hours(A.activity(spark, sf)), "oaf"), "day")


@query("daily_login_entropy", f'SELECT "user", {D("day")}, {R("login_entropy")} FROM day_entropy')
def daily_login_entropy(spark, sf):
    return text_time(rounded(daily.login_entropy(A.activity(spark, sf)), "login_entropy"), "day")


@query("peer_statistics", f"SELECT role, {D('day')}, {R('pf', 'peer_file_mean')}, {R('pe', 'peer_email_mean')}, {R('ps', 'peer_email_std')} FROM peers")
def peer_statistics(spark, sf):
    rows = daily.peer_stats(A.activity(spark, sf), A.roster(spark, sf))
    return text_time(rounded(rows, "peer_file_mean", "peer_email_mean", "peer_email_std"), "day")


@query("peer_relative_ratios", f'SELECT "user", {D("day")}, role, {R("far")}, {R("eds")} FROM daily')
def peer_relative_ratios(spark, sf):
    act, users = A.activity(spark, sf), A.roster(spark, sf)
    rows = daily.peer_relative(daily.with_role(daily.source_counts(act), users), daily.peer_stats(act, users))
    return text_time(rounded(rows.select("user", "day", "role", "far", "eds"), "far", "eds"), "day")


@query("behaviour_joined_to_days", f"""
SELECT "user", {D("day")}, file_count, file_copy_count, usb_count, event_count, {R("after_hours_ratio")} FROM day_counts""")
def behaviour_joined_to_days(spark, sf):
    act = A.activity(spark, sf)
    counts = daily.behaviour_counts(timeline.prepare_behaviour(A.raw_logs(act)))
    rows = daily.join_behaviour(daily.source_counts(act), counts).select(
        "user", "day", "file_count", "file_copy_count", "usb_count", "event_count", "after_hours_ratio")
    return text_time(rounded(rows, "after_hours_ratio"), "day")


@query("user_role_lookup", """
SELECT a.id, coalesce(r.role, 'Unknown') AS feature_role, coalesce(r.role, 'Employee') AS scoring_role
FROM act a LEFT JOIN roster r ON r."user" = a."user" """)
def user_role_lookup(spark, sf):
    rows = daily.with_role(A.activity(spark, sf).select("id", "user"), A.roster(spark, sf))
    return rows.select("id", F.col("role").alias("feature_role"),
                       F.when(F.col("role") == "Unknown", "Employee").otherwise(F.col("role")).alias("scoring_role"))


@query("daily_features", f"""
SELECT "user", role, {D("day")}, day_of_week, {R("far")}, {R("eds")}, {R("iav", digits=1)}, {R("oaf")}, {R("login_entropy")}, file_count, email_count,
  file_copy_count, usb_count, removable_media_count, delete_count, after_hours_count, {R("after_hours_ratio")}, event_count FROM daily""")
def daily_features(spark, sf):
    rows = rounded(T0.daily(spark, sf), "far", "eds", "oaf", "login_entropy", "after_hours_ratio")
    return text_time(rounded(rows, "iav", digits=1), "day")


# --- sequences and models' metadata --------------------------------------------------
@query("daily_sequences", f"""
SELECT "user", {D("day")}, 10 AS rows_in_sequence, array_to_string(list(file_count) OVER f, ',') AS file_counts
FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY daily.day) AS rn FROM daily)
WINDOW f AS (PARTITION BY "user" ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) QUALIFY rn >= 10""")
def daily_sequences(spark, sf):
    i = sequences.C.DAILY_FEATURES.index("file_count")
    rows = sequences.sequences(T0.daily(spark, sf))
    counts = F.transform("sequence", lambda r: r[i].cast("long").cast("string"))
    return text_time(rows.select("user", "day", F.size("sequence").alias("rows_in_sequence"),
                                 F.array_join(counts, ",").alias("file_counts")), "day")


@query("labelled_sequences", f"""
SELECT "user", {D("day")}, 'last' AS rule, lab AS label FROM (
  SELECT "user", day, row_number() OVER w AS rn, CAST("user" = 'U5' AND day >= DATE '2024-01-20' AS INTEGER) AS lab FROM daily WINDOW w AS (PARTITION BY "user" ORDER BY day)) WHERE rn >= 5
UNION ALL
SELECT "user", {D("day")}, 'any', lab FROM (
  SELECT "user", day, row_number() OVER w AS rn, max(CAST("user" = 'U5' AND day >= DATE '2024-01-20' AS INTEGER)) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS lab
  FROM daily WINDOW w AS (PARTITION BY "user" ORDER BY day)) WHERE rn >= 10""")
def labelled_sequences(spark, sf):
    rows = timeline.with_truth_by_date(T0.daily(spark, sf).withColumn("date", F.col("day")))
    short = sequences.labelled_sequences(rows, 5).select("user", "day", F.lit("last").alias("rule"), F.col("sequence_label").alias("label"))
    long = sequences.labelled_sequences(rows, 10, rule="any").select("user", "day", F.lit("any").alias("rule"), F.col("sequence_label").alias("label"))
    return text_time(short.unionByName(long), "day")


@query("sequence_errors", f'SELECT "user", {D("day")}, {R("coalesce(own_error, -1)", "own_error")}, {R("coalesce(global_error, -1)", "global_error")} FROM errors')
def sequence_errors(spark, sf):
    rows = T0.errors(spark, sf).select("user", "day", F.coalesce("own_error", F.lit(-1.0)).alias("own_error"),
                                       F.coalesce("global_error", F.lit(-1.0)).alias("global_error"))
    return text_time(rounded(rows, "own_error", "global_error"), "day")


@query("role_model_metadata", f"""
SELECT model, n_sequences, {R("threshold")}, {R("error_mean")}, {R("error_std")}, {R("error_p50")}, {R("error_p95")}, {R("error_p99")} FROM metadata""")
def role_model_metadata(spark, sf):
    rows = sequences.model_metadata(T0.errors(spark, sf))
    return rounded(rows, "threshold", "error_mean", "error_std", "error_p50", "error_p95", "error_p99")


@query("model_choice_per_user_day", f'SELECT "user", {D("day")}, role, {R("anomaly_score")}, {R("threshold")} FROM anomalies')
def model_choice_per_user_day(spark, sf):
    rows = T0.anomalies(spark, sf).select("user", "day", "role", "anomaly_score", "threshold")
    return text_time(rounded(rows, "anomaly_score", "threshold"), "day")


@query("model_choice_first_available", f"""
SELECT e."user", {D("e.day", "day")}, e.role, {R("coalesce(r.threshold, f.threshold)", "threshold")}
FROM errors e LEFT JOIN metadata r ON r.model = e.role AND r.model <> 'global' CROSS JOIN (SELECT threshold FROM metadata WHERE model = 'Employee') f""")
def model_choice_first_available(spark, sf):
    """Without a global model, roles that have none of their own take the first model there is."""
    errors = T0.errors(spark, sf)
    rows = sequences.with_model(errors, sequences.model_metadata(errors).filter("model <> 'global'"))
    return text_time(rounded(rows.select("user", "day", "role", "threshold"), "threshold"), "day")


# --- scores ---------------------------------------------------------------------------
@query("base_risk", f'SELECT "user", {D("day")}, {R("base_risk")} FROM scored')
def base_risk(spark, sf):
    return text_time(rounded(T0.scored(spark, sf).select("user", "day", "base_risk"), "base_risk"), "day")


@query("base_risk_fallbacks", f"""
SELECT event_id, {R("least(100.0::DOUBLE, greatest(0.0::DOUBLE, value / 500 - 0.16::DOUBLE) * 250)", "no_metadata")},
  {R("greatest(0.0::DOUBLE, least(100.0::DOUBLE, (value / 500 - 0.1::DOUBLE) / 0.2::DOUBLE * 25))", "z_score")},
  {R("CASE WHEN value / 500 - 0.3::DOUBLE < 0 THEN least(100.0::DOUBLE, abs(value / 500 - 0.3::DOUBLE) * 400) ELSE 0.0::DOUBLE END", "baseline_model")} FROM ev""")
def base_risk_fallbacks(spark, sf):
    none = F.lit(None).cast("double")
    score = F.col("value") / 500
    rows = A.events(spark, sf).select(
        "event_id",
        riskrules.base_risk(score, none, none, none).alias("no_metadata"),
        riskrules.base_risk(score, F.lit(0.1), F.lit(0.2), F.lit(0.1)).alias("z_score"),
        riskrules.base_risk(score - 0.3, none, none, none, "baseline").alias("baseline_model"),
    )
    return rounded(rows, "no_metadata", "z_score", "baseline_model")


@query("risk_multipliers", f"""
SELECT "user", {D("day")}, role_multiplier, ah_day AS is_after_hours_day, time_multiplier, activity_multiplier, {R("behaviour_multiplier")} FROM scored""")
def risk_multipliers(spark, sf):
    rows = T0.scored(spark, sf).select("user", "day", "role_multiplier", "is_after_hours_day", "time_multiplier",
                                       "activity_multiplier", "behaviour_multiplier")
    return text_time(rounded(rows, "behaviour_multiplier"), "day")


@query("role_multiplier_of_users", """SELECT "user", role, CASE role WHEN 'Admin' THEN 1.5::DOUBLE WHEN 'Contractor' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS multiplier FROM roster""")
def role_multiplier_of_users(spark, sf):
    return A.roster(spark, sf).select("user", "role", riskrules.role_multiplier(F.col("role")).alias("multiplier"))


@query("after_hours_gate", f"""
SELECT "user", {D("day")}, after_hours_ratio > 0.3::DOUBLE AND after_hours_count >= 6 AS is_after_hours FROM day_counts""")
def after_hours_gate(spark, sf):
    counts = daily.join_behaviour(daily.source_counts(A.activity(spark, sf)), daily.behaviour_counts(
        timeline.prepare_behaviour(A.raw_logs(A.activity(spark, sf)))))
    return text_time(counts.select("user", "day", riskrules.is_after_hours_day(
        F.col("after_hours_ratio"), F.col("after_hours_count")).alias("is_after_hours")), "day")


@query("activity_multiplier", f"""
SELECT "user", {D("day")}, CASE WHEN file_copy_count > 0 THEN 4.0::DOUBLE WHEN usb_count > 0 THEN 3.0::DOUBLE WHEN delete_count > 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS multiplier,
  CASE WHEN file_copy_count > 0 THEN 'File Copy' WHEN usb_count > 0 THEN 'Connect' WHEN delete_count > 0 THEN 'File Delete' END AS reason FROM day_counts WHERE event_count > 0""")
def activity_multiplier(spark, sf):
    counts = daily.behaviour_counts(timeline.prepare_behaviour(A.raw_logs(A.activity(spark, sf))))
    m, reason = riskrules.activity_multiplier(F.col("file_copy_count"), F.col("usb_count"), F.col("delete_count"))
    return text_time(counts.select("user", "day", m.alias("multiplier"), reason.alias("reason")), "day")


@query("behaviour_boost", f"""
SELECT "user", {D("day")}, {R("(CASE WHEN usb_count > 0 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN removable_media_count > 0 THEN 1.4::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN file_copy_count > 5 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN after_hours_ratio > 0.3::DOUBLE AND after_hours_count >= 6 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END)", "boost")}
FROM day_counts WHERE event_count > 0""")
def behaviour_boost(spark, sf):
    counts = daily.behaviour_counts(timeline.prepare_behaviour(A.raw_logs(A.activity(spark, sf))))
    gate = riskrules.is_after_hours_day(F.col("after_hours_ratio"), F.col("after_hours_count"))
    boost = riskrules.behaviour_boost(F.col("file_copy_count"), F.col("usb_count"), F.col("removable_media_count"), gate)
    return text_time(rounded(counts.select("user", "day", boost.alias("boost")), "boost"), "day")


_VELOCITY = "k % 10 + 0.27::DOUBLE"
_LEVELS = "(['Low', 'Medium', 'High', 'Critical'])[k % 4 + 1]"


def _integrity_rows(spark, sf):
    k = F.col("k")
    return A.events(spark, sf).select(
        "event_id",
        (F.lit(1.0) - k / 101).alias("productive_app_ratio"),
        (k % 10 + 0.27).alias("file_op_velocity"),
        F.lit(1.0).alias("baseline_file_velocity"),
        F.element_at(F.array(*[F.lit(x) for x in ("Low", "Medium", "High", "Critical")]), (k % 4 + 1).cast("int")).alias("entropy_risk_level"),
        ((k % 7) * 0.75 + 0.12).alias("mouse_tortuosity_index"),
        ((k % 11) / 10 + 0.033).alias("keystroke_anomaly_score"),
    )


@query("work_integrity_multiplier", f"""
SELECT event_id, {R(f"(CASE WHEN 1 - k / 101.0::DOUBLE < 0.5 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN {_VELOCITY} > 5 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) * (CASE k % 4 WHEN 3 THEN 2.5::DOUBLE WHEN 2 THEN 1.5::DOUBLE WHEN 1 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN (k % 7) * 0.75::DOUBLE + 0.12::DOUBLE > 3 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN (k % 11) / 10.0::DOUBLE + 0.033::DOUBLE > 0.5 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END)", "multiplier")} FROM ev""")
def work_integrity_multiplier(spark, sf):
    return rounded(_integrity_rows(spark, sf).select("event_id", riskrules.integrity_multiplier().alias("multiplier")), "multiplier")


@query("work_integrity_factors", f"""
SELECT event_id, array_to_string(list_filter([
  CASE WHEN 1 - k / 101.0::DOUBLE < 0.5 THEN concat('Low productivity ratio (', CAST(round_even((1 - k / 101.0::DOUBLE) * 100, 0) AS BIGINT), '%)') END,
  CASE WHEN {_VELOCITY} > 5 THEN printf('Anomalous file velocity (%.1fx baseline)', {_VELOCITY}) END,
  CASE WHEN k % 4 >= 2 THEN concat('High session entropy (', {_LEVELS}, ')') END,
  CASE WHEN (k % 7) * 0.75::DOUBLE + 0.12::DOUBLE > 3 THEN printf('Erratic mouse pattern (tortuosity=%.1f)', (k % 7) * 0.75::DOUBLE + 0.12::DOUBLE) END,
  CASE WHEN (k % 11) / 10.0::DOUBLE + 0.033::DOUBLE > 0.5 THEN printf('Abnormal keystroke rhythm (anomaly=%.2f)', (k % 11) / 10.0::DOUBLE + 0.033::DOUBLE) END
  ], lambda x: x IS NOT NULL), '; ') AS factors FROM ev""")
def work_integrity_factors(spark, sf):
    parts = F.filter(F.array(*riskrules.integrity_factors()), lambda x: x.isNotNull())
    return _integrity_rows(spark, sf).select("event_id", F.array_join(parts, "; ").alias("factors"))


@query("exfiltration_override", f'SELECT "user", {D("day")}, is_pattern, risk_score >= 85 AS at_least_85, {R("risk_score")} FROM scored')
def exfiltration_override(spark, sf):
    rows = T0.scored(spark, sf).select("user", "day", "is_pattern", (F.col("risk_score") >= 85).alias("at_least_85"), "risk_score")
    return text_time(rounded(rows, "risk_score"), "day")


@query("tactic_of_day", f'SELECT "user", {D("day")}, mitre_tactic, mitre_technique FROM scored')
def tactic_of_day(spark, sf):
    return text_time(T0.scored(spark, sf).select("user", "day", "mitre_tactic", "mitre_technique"), "day")


@query("risk_factors", f"""SELECT "user", {D("day")}, array_to_string(factors, ' | ') AS factors, primary_factor FROM explained""")
def risk_factors(spark, sf):
    return text_time(T0.scored(spark, sf).select("user", "day", F.array_join("factors", " | ").alias("factors"), "primary_factor"), "day")


@query("risk_explanations", f'SELECT "user", {D("day")}, explanation FROM explained')
def risk_explanations(spark, sf):
    return text_time(T0.scored(spark, sf).select("user", "day", "explanation"), "day")


@query("top_three_factors", f"""SELECT "user", {D("day")}, array_to_string(factors[1:3], '; ') AS top_factors FROM explained""")
def top_three_factors(spark, sf):
    return text_time(T0.scored(spark, sf).select("user", "day", F.array_join(F.slice("factors", 1, 3), "; ").alias("top_factors")), "day")


@query("scored_user_days", f"""
SELECT "user", role, {D("day")}, {R("anomaly_score")}, {R("base_risk")}, {R("risk_score")}, primary_factor, mitre_tactic, explanation FROM explained""")
def scored_user_days(spark, sf):
    rows = T0.scored(spark, sf).select("user", "role", "day", "anomaly_score", "base_risk", "risk_score",
                                       "primary_factor", "mitre_tactic", "explanation")
    return text_time(rounded(rows, "anomaly_score", "base_risk", "risk_score"), "day")


# --- alerts and roll-up -------------------------------------------------------------
@query("alert_decisions", f'SELECT "user", {D("date", "day")}, {R("risk_score")}, should_alert, alert_severity FROM alerted')
def alert_decisions(spark, sf):
    rows = alerts.decide(T0.scored_days(spark, sf)).select("user", "day", "risk_score", "should_alert", "alert_severity")
    return text_time(rounded(rows, "risk_score"), "day")


@query("alert_state_totals", """
SELECT count_if(hits > 0) AS users_in_warning, count_if(last IS NOT NULL) AS users_in_cooldown
FROM (SELECT f.* FROM fold f JOIN (SELECT "user", max(i) AS i FROM fold GROUP BY 1) m USING ("user", i))""")
def alert_state_totals(spark, sf):
    return alerts.alert_state_stats(T0.scored_days(spark, sf))


@query("user_risk_totals", f"""
SELECT "user", {R("max_risk")}, {R("decayed_sum")}, {R("max_risk + 0.1::DOUBLE * decayed_sum", "total_risk_score")}, event_count FROM user_totals""")
def user_risk_totals(spark, sf):
    return rounded(rollup.user_risk(T0.scored_days(spark, sf)), "max_risk", "decayed_sum", "total_risk_score")


@query("daily_risk_series", f'SELECT "user", {D("day")}, {R("daily_risk")} FROM series')
def daily_risk_series(spark, sf):
    return text_time(rounded(rollup.daily_risk(T0.scored(spark, sf)), "daily_risk"), "day")


@query("own_baselines", f"""
SELECT "user", baseline_count, baseline_valid, {R("baseline_avg")}, {R("baseline_std")}, {R("coalesce(baseline_min, -1)", "baseline_min")}, {R("coalesce(baseline_max, -1)", "baseline_max")}, {R("recent_risk")} FROM bases""")
def own_baselines(spark, sf):
    rows = rollup.baselines(rollup.daily_risk(T0.scored(spark, sf))).fillna(-1.0, ["baseline_min", "baseline_max"])
    return rounded(rows, "baseline_avg", "baseline_std", "baseline_min", "baseline_max", "recent_risk")


@query("behaviour_drift", f'SELECT "user", is_drift, {R("deviation_sigma")}, drift_explanation FROM drifts')
def behaviour_drift(spark, sf):
    rows = rollup.drift(rollup.baselines(rollup.daily_risk(T0.scored(spark, sf))))
    return rounded(rows.select("user", "is_drift", "deviation_sigma", "drift_explanation"), "deviation_sigma")


@query("user_risk_report", f'SELECT "user", {R("total_risk_score")}, {R("max_risk")}, event_count, is_drift, {R("deviation_sigma")}, drift_explanation FROM report')
def user_risk_report(spark, sf):
    return rounded(T0.report(spark, sf), "total_risk_score", "max_risk", "deviation_sigma")


@query("rescaled_user_risk", """
SELECT "user", round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, total_risk_score / (SELECT max(total_risk_score) FROM report) * 97)), 2) + 0.0 AS scaled_risk FROM report""")
def rescaled_user_risk(spark, sf):
    report = T0.report(spark, sf)
    return rollup.rescaled(report).select("user", (F.col("scaled_risk") + 0.0).alias("scaled_risk"))


_EVENT_RISK = "least(100.0::DOUBLE, value / 4)"


def _risky_events(spark, sf):
    """Events with a numeric score and the activity names that the correlated pairs know."""
    ev = A.events(spark, sf)
    act = F.when(F.col("event_type") == "purchase", "File Copy").when(
        F.col("event_type") == "error", "USB").when(F.col("event_type") == "signup", "After Hours").otherwise("Web")
    return ev.select("event_id", "user", F.col("ts").alias("date"), act.alias("activity"),
                     F.least(F.lit(100.0), F.col("value") / 4).alias("risk_score"))


_RISKY = f"""
SELECT event_id, "user", ts AS date, CASE event_type WHEN 'purchase' THEN 'File Copy' WHEN 'error' THEN 'USB' WHEN 'signup' THEN 'After Hours' ELSE 'Web' END AS activity, {_EVENT_RISK} AS risk_score FROM ev"""
_BOOSTS = """
SELECT "user", CASE WHEN count(*) < 2 THEN 0.0::DOUBLE ELSE least(0.5::DOUBLE,
  (CASE WHEN bool_or(activity = 'File Copy') AND bool_or(activity = 'USB') THEN 0.8::DOUBLE * 0.1::DOUBLE ELSE 0.0::DOUBLE END)
  + (CASE WHEN bool_or(activity = 'After Hours') AND bool_or(activity = 'File Copy') THEN 0.6::DOUBLE * 0.1::DOUBLE ELSE 0.0::DOUBLE END)) END AS boost
FROM risky GROUP BY 1"""
_NONLINEAR = """
SELECT r."user", count(*) AS event_count, max(risk_score) AS max_risk, avg(risk_score) AS avg_risk,
  sum(risk_score * w * exp(risk_score / 50) / m) / greatest(1.0::DOUBLE, sum(w * exp(risk_score / 50) / m)) AS base_risk
FROM (SELECT *, pow(0.9::DOUBLE, (epoch_us((SELECT max(date) FROM risky)) - epoch_us(date)) / 86400000000.0::DOUBLE) AS w,
        max(exp(risk_score / 50)) OVER (PARTITION BY "user") AS m FROM risky) r GROUP BY 1"""


@query("correlated_activity_boost", f'SELECT "user", {R("boost")} FROM boosts', risky=_RISKY, boosts=_BOOSTS)
def correlated_activity_boost(spark, sf):
    return rounded(rollup.correlation_boost(_risky_events(spark, sf)), "boost")


@query("nonlinear_user_risk", f"""
SELECT n."user", event_count, {R("max_risk")}, {R("avg_risk")}, {R("base_risk")}, {R("boost")}, {R("least(100.0::DOUBLE, base_risk * (1 + boost))", "final_risk")}
FROM nonlinear n JOIN boosts b ON b."user" = n."user" """, risky=_RISKY, boosts=_BOOSTS, nonlinear=_NONLINEAR)
def nonlinear_user_risk(spark, sf):
    return rounded(rollup.nonlinear_risk(_risky_events(spark, sf)), "max_risk", "avg_risk", "base_risk", "boost", "final_risk")


@query("severity_weights", f"""
SELECT "user", {D("day")}, {R("exp(risk_score / 50) / max(exp(risk_score / 50)) OVER (PARTITION BY \"user\")", "severity_weight")} FROM scored""")
def severity_weights(spark, sf):
    rows = rollup.severity_weights(T0.scored(spark, sf)).select("user", "day", "severity_weight")
    return text_time(rounded(rows, "severity_weight"), "day")


# --- small presentation functions -----------------------------------------------------
@query("risk_bands", f"""
SELECT event_id, CASE WHEN value / 4 >= 80 THEN 'Critical' WHEN value / 4 >= 60 THEN 'High' WHEN value / 4 >= 40 THEN 'Medium' ELSE 'Low' END AS level,
  CASE WHEN value / 4 > 80 THEN 'Critical' WHEN value / 4 > 50 THEN 'High' WHEN value / 4 > 25 THEN 'Medium' ELSE 'Low' END AS profile_level,
  CASE WHEN value / 4 >= 80 THEN 'Critical' WHEN value / 4 >= 60 THEN 'High' ELSE 'Medium' END AS severity FROM ev""")
def risk_bands(spark, sf):
    from conductrisk.functions.common import band
    score = F.col("value") / 4
    return A.events(spark, sf).select(
        "event_id", band(score).alias("level"), band(score, (80, 50, 25), strict=True).alias("profile_level"),
        riskrules.live_severity(score).alias("severity"))


@query("session_states", """
SELECT event_id, CASE WHEN m < 2 THEN 'active' WHEN m < 15 THEN 'idle' ELSE 'offline' END AS state,
  CASE WHEN floor(m) < 1 THEN 'just now' WHEN floor(m) < 60 THEN concat(CAST(floor(m) AS BIGINT), 'm ago') WHEN floor(m) < 1440 THEN concat(CAST(floor(floor(m) / 60) AS BIGINT), 'h ago') ELSE strftime(ts, '%b %-d') END AS seen
FROM (SELECT *, (epoch_us((SELECT max(ts) FROM ev)) - epoch_us(ts)) / 60000000.0::DOUBLE AS m FROM ev)""")
def session_states(spark, sf):
    ev = A.events(spark, sf)
    now = rollup.latest(ev, "ts")
    return ev.select("event_id", session_state("ts", now).alias("state"), relative_time("ts", now).alias("seen"))


@query("clean_app_names", r"""
SELECT id, CASE WHEN raw NOT IN ('', '—', 'unknown') THEN regexp_replace(regexp_replace(raw, '\.exe$', '', 'i'), '^\.', '') END AS app, session_id
FROM (SELECT id, session_id, CASE id % 5 WHEN 0 THEN concat('.', active_app) WHEN 1 THEN 'unknown' WHEN 2 THEN '' WHEN 3 THEN upper(active_app) ELSE active_app END AS raw FROM telemetry)""")
def clean_app_names(spark, sf):
    """Names as agents send them: hidden, unknown, empty, in capitals."""
    t, app, kind = A.telemetry(spark, sf), F.col("active_app"), F.col("id") % 5
    raw = (F.when(kind == 0, F.concat(F.lit("."), app)).when(kind == 1, "unknown").when(kind == 2, "")
           .when(kind == 3, F.upper(app)).otherwise(app))
    t = t.withColumn("raw", raw)
    return t.select("id", clean_app("raw").alias("app"), session_id("user_id", "timestamp").alias("session_id"))


@query("alert_ids", "SELECT id, printf('ALT-%05d', id) AS alert_id, concat('Anomalous behaviour detected in ', active_app, ' — ', window_title) AS activity FROM telemetry")
def alert_ids(spark, sf):
    return A.telemetry(spark, sf).select("id", riskrules.alert_id(F.col("id")).alias("alert_id"),
                                         riskrules.alert_text(F.col("active_app"), F.col("window_title")).alias("activity"))


@query("factor_bars", f"""
SELECT "user", {D("day")}, {R("greatest(0.0::DOUBLE, least(100.0::DOUBLE, CASE WHEN far <= 1 THEN far * 100 ELSE far END))", "far_bar")},
  {R("greatest(0.0::DOUBLE, least(100.0::DOUBLE, CASE WHEN oaf <= 1 THEN oaf * 100 ELSE oaf END))", "oaf_bar")}, {R("file_count::DOUBLE / greatest(1, file_count, email_count) * 100", "file_count_bar")} FROM daily""")
def factor_bars(spark, sf):
    rows = timeline.factor_bars(T0.daily(spark, sf)).select("user", "day", "far_bar", "oaf_bar", "file_count_bar")
    return text_time(rounded(rows, "far_bar", "oaf_bar", "file_count_bar"), "day")


@query("top_risk_users", f"""
SELECT r."user", {R("r.total_risk_score", "total_risk_score")}, CASE WHEN r.total_risk_score >= 80 THEN 'Critical' WHEN r.total_risk_score >= 60 THEN 'High' WHEN r.total_risk_score >= 40 THEN 'Medium' ELSE 'Low' END AS risk_level,
  r.is_drift, w.mitre_tactic AS worst_tactic, w.role FROM report r JOIN (SELECT "user", role, arg_max(mitre_tactic, struct_pack(a := risk_score, b := day)) AS mitre_tactic FROM scored GROUP BY 1, 2) w USING ("user")""")
def top_risk_users(spark, sf):
    """Users by total risk, with level, drift and the tactic of their riskiest day."""
    from conductrisk.functions.common import band
    days = T0.scored_days(spark, sf)
    worst = days.groupBy("user", "role").agg(F.max_by("mitre_tactic", F.struct("risk_score", "day")).alias("worst_tactic"))
    rows = rollup.user_report(days).join(worst, "user").select(
        "user", "total_risk_score", band("total_risk_score").alias("risk_level"), "is_drift", "worst_tactic", "role")
    return rounded(rows, "total_risk_score").orderBy(F.desc("total_risk_score"), "user")

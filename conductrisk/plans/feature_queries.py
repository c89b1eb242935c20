"""Queries over biometrics, entropy and the event feature set."""

from __future__ import annotations

from pyspark.sql import functions as F

from conductrisk import adapters as A
from conductrisk.operators import biometrics as B
from conductrisk.operators import entropy as E
from conductrisk.operators import featurestore as S
from conductrisk.operators import rollup
from conductrisk.plans import tables as T0
from conductrisk.plans.registry import D, R, T, query, rounded, text_time

_STEPS = """
SELECT *, lag(mouse_x) OVER w - mouse_x AS dx, lag(mouse_y) OVER w - mouse_y AS dy,
  (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 1000.0::DOUBLE AS dt_ms,
  key_press_time - lag(key_release_time) OVER w AS flight_time_ms, key_release_time - key_press_time AS dwell_time_ms
FROM bio WINDOW w AS (PARTITION BY "user" ORDER BY timestamp, id)"""


@query("mouse_steps", f"SELECT id, {R('dx')}, {R('dy')}, {R('dt_ms', digits=3)}, {R('sqrt(dx * dx + dy * dy)', 'path_segment')} FROM steps", steps=_STEPS)
def mouse_steps(spark, sf):
    rows = B.mouse_steps(A.biometrics(spark, sf)).select("id", "dx", "dy", "dt_ms", "path_segment")
    return rounded(rounded(rows, "dx", "dy", "path_segment"), "dt_ms", digits=3)


@query("key_times", f"SELECT id, {R('flight_time_ms', digits=2)}, {R('dwell_time_ms', digits=2)} FROM steps", steps=_STEPS)
def key_times(spark, sf):
    rows = B.key_times(A.biometrics(spark, sf)).select("id", "flight_time_ms", "dwell_time_ms")
    return rounded(rows, "flight_time_ms", "dwell_time_ms", digits=2)


_MOUSE = """
SELECT "user", avg(mouse_velocity) AS mouse_velocity_mean, stddev_samp(mouse_velocity) AS mouse_velocity_std,
  count_if(mouse_velocity > 0)::DOUBLE / count(*) AS mouse_activity_ratio, coalesce(sum(sqrt(dx * dx + dy * dy)), 0) AS path,
  sqrt(pow(arg_max(mouse_x, timestamp) - arg_min(mouse_x, timestamp), 2) + pow(arg_max(mouse_y, timestamp) - arg_min(mouse_y, timestamp), 2)) AS straight
FROM steps GROUP BY 1"""
_MOUSE_COLS = f"""{R("mouse_velocity_mean")}, {R("mouse_velocity_std")}, {R("mouse_activity_ratio")},
  {R("path / ((SELECT sum(path) FROM mouse) + 1e-6::DOUBLE)", "mouse_path_share")}, {R("path / (straight + 1e-6::DOUBLE)", "mouse_tortuosity_index", 4)}"""


@query("mouse_features", f'SELECT "user", {_MOUSE_COLS} FROM mouse', steps=_STEPS, mouse=_MOUSE)
def mouse_features(spark, sf):
    rows = B.mouse_features(A.biometrics(spark, sf))
    return rounded(rounded(rows, "mouse_velocity_mean", "mouse_velocity_std", "mouse_activity_ratio", "mouse_path_share"),
                   "mouse_tortuosity_index", digits=4)


_KEYS = """
SELECT "user", avg(flight_time_ms) AS keystroke_flight_mean, stddev_samp(flight_time_ms) AS keystroke_flight_std, avg(dwell_time_ms) AS keystroke_dwell_mean,
  count(*) * 60.0::DOUBLE / ((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1000000.0::DOUBLE) AS typing_speed_wpm FROM steps GROUP BY 1"""
_KEY_COLS = f"{R('keystroke_flight_mean', digits=1)}, {R('keystroke_flight_std', digits=1)}, {R('keystroke_dwell_mean', digits=3)}, {R('typing_speed_wpm')}"


@query("keystroke_features", f'SELECT "user", {_KEY_COLS} FROM keysum', steps=_STEPS, keysum=_KEYS)
def keystroke_features(spark, sf):
    rows = rounded(B.keystroke_features(A.biometrics(spark, sf)), "keystroke_flight_mean", "keystroke_flight_std", digits=1)
    return rounded(rounded(rows, "keystroke_dwell_mean", digits=3), "typing_speed_wpm")


_WORK = """
SELECT "user", avg(is_productive_app) AS productive_app_ratio, avg(is_idle) AS idle_time_ratio, avg(is_non_work_http) AS non_work_http_ratio,
  count(file_operation) * 60.0::DOUBLE / ((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1000000.0::DOUBLE) AS file_op_velocity,
  count_if(hour(timestamp) < 7 OR hour(timestamp) > 20)::DOUBLE / count(*) AS after_hours_ratio FROM bio GROUP BY 1"""
_WORK_NAMES = ["productive_app_ratio", "idle_time_ratio", "non_work_http_ratio", "file_op_velocity", "after_hours_ratio"]
_WORK_COLS = ", ".join(R(n) for n in _WORK_NAMES)


@query("work_features", f'SELECT "user", {_WORK_COLS} FROM worksum', worksum=_WORK)
def work_features(spark, sf):
    return rounded(B.work_features(A.biometrics(spark, sf)), *_WORK_NAMES)


_SESS = """
SELECT "user", time_window, greatest(0.0::DOUBLE, log2(sum(n)::DOUBLE) - sum(n * log2(n::DOUBLE)) / sum(n)) AS activity_entropy
FROM (SELECT "user", CAST(floor(epoch(timestamp) / 300) AS BIGINT) AS time_window, activity_type, count(*) AS n FROM bio GROUP BY 1, 2, 3) GROUP BY 1, 2"""
_SWITCH = """
SELECT "user", time_window, count_if(app_category <> before) AS app_transitions, count(DISTINCT domain) AS domain_diversity
FROM (SELECT *, lag(app_category) OVER (PARTITION BY "user", time_window ORDER BY timestamp, id) AS before
      FROM (SELECT *, CAST(floor(epoch(timestamp) / 300) AS BIGINT) AS time_window FROM bio)) GROUP BY 1, 2"""


@query("app_switches", 'SELECT "user", time_window, app_transitions FROM switches', switches=_SWITCH)
def app_switches(spark, sf):
    return E.app_switches(A.biometrics(spark, sf))


@query("session_entropy", f'SELECT "user", time_window, {R("activity_entropy")}, app_transitions, domain_diversity FROM sess JOIN switches USING ("user", time_window)',
       sess=_SESS, switches=_SWITCH)
def session_entropy(spark, sf):
    return rounded(E.session_entropy(A.biometrics(spark, sf)), "activity_entropy")


_SUMMARY = """
SELECT "user", avg(activity_entropy) AS mean_activity_entropy, coalesce(stddev_samp(activity_entropy), 0) AS entropy_variance,
  avg(app_transitions) AS avg_app_transitions, avg(domain_diversity) AS avg_domain_diversity FROM sess JOIN switches USING ("user", time_window) GROUP BY 1"""
_SUMMARY_NAMES = ["mean_activity_entropy", "entropy_variance", "avg_app_transitions", "avg_domain_diversity"]


@query("user_entropy_summary", f'SELECT "user", {", ".join(R(n) for n in _SUMMARY_NAMES)} FROM esum', sess=_SESS, switches=_SWITCH, esum=_SUMMARY)
def user_entropy_summary(spark, sf):
    return rounded(E.user_entropy_summary(E.session_entropy(A.biometrics(spark, sf))), *_SUMMARY_NAMES)


@query("merged_biometric_features", f"""
SELECT "user", {R("coalesce(mouse_velocity_mean, -1)", "mouse_velocity_mean")}, {R("coalesce(keystroke_dwell_mean, -1)", "keystroke_dwell_mean", 3)}, {R("coalesce(productive_app_ratio, -1)", "productive_app_ratio")}
FROM mouse FULL JOIN keysum USING ("user") FULL JOIN worksum USING ("user")""",
       steps=_STEPS, mouse=_MOUSE, keysum=_KEYS, worksum=_WORK)
def merged_biometric_features(spark, sf):
    rows = A.biometrics(spark, sf)
    merged = B.merge_features(
        B.mouse_features(rows), B.keystroke_features(rows), B.work_features(rows),
    ).select("user", "mouse_velocity_mean", "keystroke_dwell_mean", "productive_app_ratio").fillna(-1.0)
    return rounded(rounded(merged, "mouse_velocity_mean", "productive_app_ratio"), "keystroke_dwell_mean", digits=3)


@query("behavioural_signature", f"""
SELECT "user", {_MOUSE_COLS}, {_KEY_COLS}, {_WORK_COLS}, {", ".join(R(n) for n in _SUMMARY_NAMES)}
FROM mouse JOIN keysum USING ("user") JOIN worksum USING ("user") JOIN esum USING ("user")""",
       steps=_STEPS, mouse=_MOUSE, keysum=_KEYS, worksum=_WORK, sess=_SESS, switches=_SWITCH, esum=_SUMMARY)
def behavioural_signature(spark, sf):
    rows = B.signature(A.biometrics(spark, sf))
    rows = rounded(rows, "mouse_velocity_mean", "mouse_velocity_std", "mouse_activity_ratio", "mouse_path_share",
                   "typing_speed_wpm", *_WORK_NAMES, *_SUMMARY_NAMES)
    rows = rounded(rows, "keystroke_flight_mean", "keystroke_flight_std", digits=1)
    return rounded(rounded(rows, "keystroke_dwell_mean", digits=3), "mouse_tortuosity_index", digits=4)


@query("velocity_anomaly_scores", f"""
SELECT "user", {R("current_mean", digits=8)}, {R("coalesce(baseline_mean, -1)", "baseline_mean", 8)},
  {R("CASE WHEN baseline_mean > 0 AND current_mean > 5 * baseline_mean THEN least(1.0::DOUBLE, (current_mean - baseline_mean) / (baseline_std + 1e-6::DOUBLE) / 10) ELSE 0.0::DOUBLE END", "velocity_score")}
FROM (SELECT "user", avg(value) AS current_mean FROM ev WHERE ts >= (SELECT max(ts) FROM ev) - INTERVAL 1 DAY GROUP BY 1)
LEFT JOIN (SELECT "user", avg(value) AS baseline_mean, coalesce(stddev_samp(value), 0) AS baseline_std FROM ev WHERE ts < (SELECT max(ts) FROM ev) - INTERVAL 1 DAY GROUP BY 1) USING ("user")""")
def velocity_anomaly_scores(spark, sf):
    ev = A.events(spark, sf)
    since = rollup.latest(ev, "ts") - F.expr("INTERVAL 1 DAY")
    now, then = ev.filter(F.col("ts") >= since), ev.filter(F.col("ts") < since)
    rows = B.velocity_anomaly(now, then, "value", ["user"]).fillna(-1.0, ["baseline_mean"]).drop("baseline_std")
    return rounded(rounded(rows, "velocity_score"), "current_mean", "baseline_mean", digits=8)


@query("agent_flush_summary", f"""
SELECT user_id, {T("time_bucket(INTERVAL 5 SECOND, timestamp)", "start")}, {R("avg(mouse_velocity_avg)", "velocity_avg")}, {R("stddev_pop(mouse_velocity_avg)", "velocity_std")},
  {R("avg(keystroke_flight_avg_ms)", "flight_avg")}, {R("stddev_pop(keystroke_flight_avg_ms)", "flight_std")}, CAST(sum(mouse_click_count) AS BIGINT) AS clicks, CAST(sum(keystroke_count) AS BIGINT) AS keys, CAST(sum(mouse_positions_count) AS BIGINT) AS positions
FROM telemetry GROUP BY user_id, time_bucket(INTERVAL 5 SECOND, timestamp)""")
def agent_flush_summary(spark, sf):
    rows = B.flush_summary(A.telemetry(spark, sf))
    return text_time(rounded(rows, "velocity_avg", "velocity_std", "flight_avg", "flight_std"), "start")


# --- entropy ---------------------------------------------------------------------------
def _norm(group: str, key: str, table: str = "bio") -> str:
    return f"""
SELECT {group}, CASE WHEN count(*) > 1 THEN greatest(0.0::DOUBLE, (log2(sum(n)::DOUBLE) - sum(n * log2(n::DOUBLE)) / sum(n)) / log2(count(*)::DOUBLE)) ELSE 0.0::DOUBLE END AS e
FROM (SELECT {group}, {key}, count(*) AS n FROM {table} WHERE {key} IS NOT NULL GROUP BY ALL) GROUP BY ALL"""


_BIOX = 'SELECT b.*, hour(timestamp) AS hr, strftime(timestamp, \'%Y-%m-%d\') AS session_day, r.role FROM bio b JOIN roster r ON r."user" = b."user"'


def _entropy_tables(group: str, prefix: str = "") -> dict[str, str]:
    keys = {"e_act": "activity_type", "e_app": "app_category", "e_dom": "domain", "e_tmp": "hr"}
    out = {f"{prefix}{n}": _norm(group, k, "biox") for n, k in keys.items()}
    out[f"{prefix}comp"] = f"""
SELECT {group}, a.e AS activity_entropy, p.e AS app_entropy, coalesce(d.e, 0.0::DOUBLE) AS domain_entropy, t.e AS temporal_entropy,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.35::DOUBLE * a.e + 0.25::DOUBLE * p.e + 0.25::DOUBLE * coalesce(d.e, 0.0::DOUBLE) + 0.15::DOUBLE * t.e)) AS composite_entropy
FROM {prefix}e_act a JOIN {prefix}e_app p USING ({group}) JOIN {prefix}e_tmp t USING ({group}) LEFT JOIN {prefix}e_dom d USING ({group})"""
    out["biox"] = _BIOX
    return out


_ENT = ["activity_entropy", "app_entropy", "domain_entropy", "temporal_entropy", "composite_entropy"]
_SESSION = '"user", session_day'


def _bio_rows(spark, sf):
    rows = A.biometrics(spark, sf).withColumn("session_day", F.date_format("timestamp", "yyyy-MM-dd"))
    return rows.join(A.roster(spark, sf).select("user", "role"), "user")


@query("normalised_activity_entropy", f'SELECT "user", {R("e", "entropy")} FROM nent', nent=_norm('"user"', "activity_type"))
def normalised_activity_entropy(spark, sf):
    return rounded(E.normalised_entropy(A.biometrics(spark, sf), ["user"], "activity_type"), "entropy")


@query("composite_session_entropy", f'SELECT {_SESSION}, {", ".join(R(n) for n in _ENT)} FROM comp', **_entropy_tables(_SESSION))
def composite_session_entropy(spark, sf):
    return rounded(E.component_entropies(_bio_rows(spark, sf), ["user", "session_day"]), *_ENT)


@query("role_entropy_baseline", f'SELECT role, {", ".join(R(n) for n in _ENT)} FROM comp', **_entropy_tables("role"))
def role_entropy_baseline(spark, sf):
    return rounded(E.component_entropies(_bio_rows(spark, sf), ["role"]), *_ENT)


_RANKED = """
SELECT c."user", c.session_day, r.role, c.composite_entropy, round(c.composite_entropy, 9) AS v, c.session_day >= strftime((SELECT max(ts) FROM ev) - INTERVAL 6 DAY, '%Y-%m-%d') AS is_now
FROM comp c JOIN roster r ON r."user" = c."user" """
_RANKS = """
SELECT c.*, (SELECT count(*) FROM ranked b WHERE NOT b.is_now AND b.v <= c.v)::DOUBLE / (SELECT count(*) FROM ranked WHERE NOT is_now) * 100 AS pct FROM ranked c WHERE is_now"""


def _ranked_sessions(spark, sf):
    rows = E.component_entropies(_bio_rows(spark, sf), ["user", "session_day"]).withColumn("v", F.round("composite_entropy", 9))
    rows = T0.stage(rows.select("user", "session_day", "v"), "sessions")
    since = F.date_format(rollup.latest(A.events(spark, sf), "ts") - F.expr("INTERVAL 6 DAYS"), "yyyy-MM-dd")
    now, then = rows.filter(F.col("session_day") >= since), rows.filter(F.col("session_day") < since)
    ranked = E.percentile_rank(now, then, "v")
    return ranked.join(A.roster(spark, sf).select("user", "role"), "user")


@query("entropy_percentile_rank", f'SELECT "user", session_day, {R("pct", "entropy_percentile")} FROM ranks', ranked=_RANKED, ranks=_RANKS, **_entropy_tables(_SESSION))
def entropy_percentile_rank(spark, sf):
    return rounded(_ranked_sessions(spark, sf).select("user", "session_day", "entropy_percentile"), "entropy_percentile")


@query("entropy_risk_levels", """
SELECT "user", session_day, role, CASE WHEN pct >= least(100.0::DOUBLE, 95.0::DOUBLE * m) THEN 'Critical' WHEN pct >= least(100.0::DOUBLE, 80.0::DOUBLE * m) THEN 'High' WHEN pct >= least(100.0::DOUBLE, 60.0::DOUBLE * m) THEN 'Medium' ELSE 'Low' END AS level
FROM (SELECT *, CASE role WHEN 'Admin' THEN 1.3::DOUBLE WHEN 'Contractor' THEN 1.15::DOUBLE WHEN 'Developer' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS m FROM ranks)""",
       ranked=_RANKED, ranks=_RANKS, **_entropy_tables(_SESSION))
def entropy_risk_levels(spark, sf):
    rows = _ranked_sessions(spark, sf)
    return rows.select("user", "session_day", "role", E.entropy_level(F.col("entropy_percentile"), F.col("role")).alias("level"))


@query("entropy_anomalies", """
SELECT "user", session_day, is_hit AS is_entropy_anomaly,
  CASE WHEN is_hit THEN printf('Entropy anomaly detected: Current composite entropy (%.2f) is 2.0x higher than role baseline (%.2f). This suggests erratic, multi-domain activity inconsistent with normal role behavior.', composite_entropy, base) ELSE '' END AS entropy_text
FROM (SELECT *, composite_entropy > base * 2 AS is_hit FROM (
  SELECT c."user", c.session_day, c.composite_entropy, coalesce(b.composite_entropy, 0.5::DOUBLE) AS base FROM comp c JOIN roster r ON r."user" = c."user" LEFT JOIN role_comp b ON b.role = r.role))""",
       **(_entropy_tables(_SESSION) | _entropy_tables("role", "role_")))
def entropy_anomalies(spark, sf):
    """Sessions against the baseline of the user's role."""
    bio = _bio_rows(spark, sf)
    base = E.component_entropies(bio, ["role"]).select("role", F.col("composite_entropy").alias("baseline_composite"))
    rows = E.component_entropies(bio, ["user", "session_day"]).join(A.roster(spark, sf).select("user", "role"), "user")
    return E.entropy_anomaly(rows.join(base, "role", "left")).select("user", "session_day", "is_entropy_anomaly", "entropy_text")


# --- feature statistics and encodings ---------------------------------------------------
_LONG = """
SELECT feature, value FROM (SELECT far, oaf, login_entropy, file_count::DOUBLE AS file_count, CASE WHEN event_count > 1 THEN after_hours_ratio END AS after_hours_ratio FROM daily)
UNPIVOT INCLUDE NULLS (value FOR feature IN (far, oaf, login_entropy, file_count, after_hours_ratio))"""
_STATS = """
SELECT feature, count(*) AS count, count(*) - count(value) AS missing, count(DISTINCT value) AS "unique", avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
  quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM longf GROUP BY 1"""
_FEATURES = ["far", "oaf", "login_entropy", "file_count", "after_hours_ratio"]


def _statistics(spark, sf, older_than=None):
    rows = T0.stage(T0.daily(spark, sf), "daily")
    if older_than:
        rows = rows.filter(F.col("day") < F.date_sub(rollup.latest(rows, "day"), older_than))
    rows = rows.withColumn(
        "after_hours_ratio", F.when(F.col("event_count") > 1, F.col("after_hours_ratio")))
    rows = rows.withColumns({f: F.round(F.col(f).cast("double"), 9) for f in _FEATURES})
    return S.statistics(rows, _FEATURES)


@query("feature_statistics", f"""
SELECT feature, count, missing, "unique", {R("mean")}, {R("std")}, {R("min")}, {R("max")}, {R("q25")}, {R("q50")}, {R("q75")} FROM stats""",
       longf=_LONG.replace("SELECT feature, value", "SELECT feature, round(value, 9) AS value"), stats=_STATS)
def feature_statistics(spark, sf):
    return rounded(_statistics(spark, sf), "mean", "std", "min", "max", "q25", "q50", "q75")


@query("feature_quality", """
SELECT feature, len(iss) = 0 AS valid, array_to_string(iss, '; ') AS issues, unique_count FROM (
 SELECT feature, "unique" AS unique_count, list_filter([CASE WHEN missing::DOUBLE / count > 0.1 THEN printf('High missing ratio: %.2f%%', missing::DOUBLE / count * 100) END,
  CASE WHEN feature = 'login_entropy' AND "unique"::DOUBLE / count > 0.5 THEN concat('High cardinality: ', "unique", ' unique values') END,
  CASE WHEN ref_std > 0 AND abs(mean - ref_mean) / ref_std > 3 THEN printf('Mean shifted by %.1f std devs', abs(mean - ref_mean) / ref_std) END], lambda x: x IS NOT NULL) AS iss
 FROM stats JOIN (SELECT feature, avg(round(value, 9)) AS ref_mean, stddev_samp(round(value, 9)) AS ref_std FROM oldf GROUP BY 1) USING (feature))""",
       longf=_LONG.replace("SELECT feature, value", "SELECT feature, round(value, 9) AS value"), stats=_STATS,
       oldf=_LONG.replace("FROM daily)", "FROM daily WHERE day < (SELECT max(day) FROM daily) - INTERVAL 15 DAY)"))
def feature_quality(spark, sf):
    """The last fifteen days and all before, judged by the statistics of what came before."""
    reference = _statistics(spark, sf, older_than=15).select("feature", "mean", "std")
    kinds = spark.createDataFrame([(f, "category" if f == "login_entropy" else "float64") for f in _FEATURES], "feature string, dtype string")
    rows = S.quality(_statistics(spark, sf), reference, kinds)
    return rows.select("feature", "valid", F.array_join("issues", "; ").alias("issues"), "unique_count")


_CAT = "SELECT event_id, CASE WHEN k < 3 THEN concat(event_type, '_', k) ELSE event_type END AS category FROM ev"
_ENC = "SELECT category, count(*)::DOUBLE / (SELECT count(*) FROM cats) AS share, count(*) < (SELECT count(*) FROM cats) * 0.01 AS is_rare FROM cats GROUP BY 1"


def _categories(spark, sf):
    ev = A.events(spark, sf)
    name = F.when(F.col("k") < 3, F.concat("event_type", F.lit("_"), F.col("k"))).otherwise(F.col("event_type"))
    return ev.select("event_id", name.alias("name"))


@query("frequency_encoder", f"SELECT category, {R('share')}, is_rare FROM enc", cats=_CAT, enc=_ENC)
def frequency_encoder(spark, sf):
    return rounded(S.fit_frequency(_categories(spark, sf), "name"), "share")


@query("frequency_encoded_events", "SELECT event_id, round(CASE WHEN is_rare THEN 0.0::DOUBLE ELSE share END, 5) + 0.0 AS code FROM cats JOIN enc USING (category)", cats=_CAT, enc=_ENC)
def frequency_encoded_events(spark, sf):
    rows = _categories(spark, sf)
    coded = S.encode_frequency(rows, "name", S.fit_frequency(rows, "name"), "code")
    return coded.select("event_id", (F.round(F.col("code").cast("double"), 5) + 0.0).alias("code"))


_CYC = f"""{R("sin(hour * 2 * pi() / 24)", "hour_sin")}, {R("cos(hour * 2 * pi() / 24)", "hour_cos")}, {R("sin((isodow(date) - 1) * 2 * pi() / 7)", "day_of_week_sin")},
  {R("cos((isodow(date) - 1) * 2 * pi() / 7)", "day_of_week_cos")}, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST(hour < 7 OR hour > 20 AS INTEGER) AS is_after_hours"""
_CYC_NAMES = ["hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos"]


@query("cyclical_time_features", f"SELECT id, {_CYC} FROM act")
def cyclical_time_features(spark, sf):
    rows = S.datetime_features(A.activity(spark, sf)).select("id", *_CYC_NAMES, "is_weekend", "is_after_hours")
    return rounded(rows, *_CYC_NAMES)


def _roll(cond: str, hours: int, name: str) -> str:
    return f'CAST(count(*) FILTER (WHERE {cond}) OVER (PARTITION BY "user" ORDER BY CAST(floor(epoch(date)) AS BIGINT) RANGE BETWEEN {hours * 3600} PRECEDING AND CURRENT ROW) AS BIGINT) AS {name}'


_ROLLS = ", ".join([
    _roll("source = 'Logon'", 1, "logon_count_1h"), _roll("source = 'Logon'", 24, "logon_count_24h"),
    _roll("source = 'File'", 1, "file_access_count_1h"), _roll("source = 'File'", 24, "file_access_count_24h"),
    _roll("source = 'Http'", 1, "http_count_1h"), _roll("source = 'Device'", 1, "device_count_1h"),
    _roll("activity = 'Connect'", 168, "usb_events_7d"), _roll("activity = 'File Copy'", 24, "file_copy_count_24h"),
    _roll("TRUE", 24, "event_count_24h")])
_ROLL_NAMES = ["logon_count_1h", "logon_count_24h", "file_access_count_1h", "file_access_count_24h", "http_count_1h",
               "device_count_1h", "usb_events_7d", "file_copy_count_24h", "event_count_24h"]


@query("rolling_event_counts", f"SELECT id, {_ROLLS} FROM act")
def rolling_event_counts(spark, sf):
    return S.rolling_event_counts(A.activity(spark, sf)).select("id", *_ROLL_NAMES)


@query("event_feature_set", f"SELECT id, {_CYC}, {_ROLLS}, 0.0::DOUBLE AS mouse_velocity, 0.0::DOUBLE AS keystroke_flight_time, 0.0::DOUBLE AS productive_app_ratio FROM act")
def event_feature_set(spark, sf):
    rows = S.event_features(A.activity(spark, sf)).select(
        "id", *_CYC_NAMES, "is_weekend", "is_after_hours", *_ROLL_NAMES, "mouse_velocity", "keystroke_flight_time", "productive_app_ratio")
    return rounded(rows, *_CYC_NAMES)


_SESSION_STEPS = """
SELECT *, mouse_x - lag(mouse_x) OVER w AS mx, mouse_y - lag(mouse_y) OVER w AS my, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 1000000.0::DOUBLE AS secs,
  key_press_time - lag(key_release_time) OVER w AS flight
FROM (SELECT *, CAST(timestamp AS DATE) AS d FROM bio) WINDOW w AS (PARTITION BY "user", d ORDER BY timestamp, id)"""
_SESSION_DAYS = """
SELECT "user", d, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1000000.0::DOUBLE AS session_duration, coalesce(sum(secs) FILTER (WHERE is_idle = 1), 0)::DOUBLE AS idle_time,
  avg(is_productive_app) AS productive_app_ratio, avg(mouse_velocity) AS mouse_velocity, avg(flight) AS keystroke_flight_time,
  coalesce(sum(sqrt(mx * mx + my * my)), 0) / (sqrt(pow(arg_max(mouse_x, (timestamp, id)) - arg_min(mouse_x, (timestamp, id)), 2) + pow(arg_max(mouse_y, (timestamp, id)) - arg_min(mouse_y, (timestamp, id)), 2)) + 1e-6::DOUBLE) AS mouse_tortuosity
FROM day_steps GROUP BY 1, 2"""
_SESSION_SCORES = """
SELECT s.*, CASE WHEN m > 0 AND keystroke_flight_time > m * 5 THEN least(1.0::DOUBLE, (keystroke_flight_time - m) / (dev + 1e-6::DOUBLE) / 10) ELSE 0.0::DOUBLE END AS keystroke_anomaly_score
FROM day_sums s JOIN (SELECT "user", avg(keystroke_flight_time) AS m, coalesce(stddev_samp(keystroke_flight_time), 0) AS dev FROM day_sums GROUP BY 1) b ON b."user" = s."user" """
_SESSION_LEVELS = """
SELECT "user", session_day, CASE WHEN pct >= least(100.0::DOUBLE, 95.0::DOUBLE * m) THEN 'Critical' WHEN pct >= least(100.0::DOUBLE, 80.0::DOUBLE * m) THEN 'High' WHEN pct >= least(100.0::DOUBLE, 60.0::DOUBLE * m) THEN 'Medium' ELSE 'Low' END AS entropy_risk_level
FROM (SELECT c."user", c.session_day, cume_dist() OVER (ORDER BY round(c.composite_entropy, 9)) * 100 AS pct,
  CASE r.role WHEN 'Admin' THEN 1.3::DOUBLE WHEN 'Contractor' THEN 1.15::DOUBLE WHEN 'Developer' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS m FROM comp c JOIN roster r ON r."user" = c."user")"""
_DAY_FEATURES = ["session_duration", "idle_time", "productive_app_ratio", "mouse_velocity", "mouse_tortuosity", "keystroke_flight_time", "keystroke_anomaly_score"]
_FEATURES_21 = f"""
SELECT a.*, {", ".join("s." + n for n in _DAY_FEATURES)}, l.entropy_risk_level FROM (
  SELECT id, "user", date, CAST(hour AS INTEGER) AS hour, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST(hour < 7 OR hour > 20 AS INTEGER) AS is_after_hours,
    {_ROLLS}, {_roll("hour < 7 OR hour > 20", 24, "late_24h")}, late_24h::DOUBLE / event_count_24h AS after_hours_ratio FROM act) a
LEFT JOIN day_scores s ON s."user" = a."user" AND s.d = CAST(a.date AS DATE) LEFT JOIN day_levels l ON l."user" = a."user" AND l.session_day = strftime(a.date, '%Y-%m-%d')"""
_PIPE = {**_entropy_tables(_SESSION), "day_steps": _SESSION_STEPS, "day_sums": _SESSION_DAYS, "day_scores": _SESSION_SCORES, "day_levels": _SESSION_LEVELS, "feats": _FEATURES_21}
_WHOLE = ["hour", "day_of_week", "is_weekend", "is_after_hours", *[n for n in _ROLL_NAMES if n != "event_count_24h"], "entropy_risk_level"]
_REAL = ["after_hours_ratio", *_DAY_FEATURES]
# times in milliseconds of the epoch leave about three digits
_DIGITS = {n: 1 if n == "keystroke_flight_time" else 6 if n in ("session_duration", "idle_time") else 4 for n in _REAL}


def _pipeline(spark, sf):
    return S.event_pipeline(A.activity(spark, sf), A.biometrics(spark, sf), A.roster(spark, sf))


@query("event_feature_pipeline", f"SELECT id, {', '.join(_WHOLE)}, {', '.join(R(f'coalesce({n}, -1)', n, _DIGITS[n]) for n in _REAL)} FROM feats", **_PIPE)
def event_feature_pipeline(spark, sf):
    """All features of the contract per event."""
    rows = _pipeline(spark, sf)
    rows = rows.select("id", *_WHOLE, *[F.coalesce(n, F.lit(-1.0)).alias(n) for n in _REAL])
    for name in _REAL:
        rows = rounded(rows, name, digits=_DIGITS[name])
    return rows


_FEATURE_ROWS = f"""
SELECT date, unnest([{", ".join(f"'{n}'" for n in [*_WHOLE, *_REAL])}]) AS feature,
  unnest([{", ".join("list_position(['Low', 'Medium', 'High', 'Critical'], entropy_risk_level)::DOUBLE" if n == "entropy_risk_level" else f"{n}::DOUBLE" for n in [*_WHOLE, *_REAL])}]) AS value FROM feats"""


@query("event_feature_warnings", """
SELECT feature, substring(md5(concat(feature, ':1.0.0')), 1, 8) AS feature_id, len(iss) = 0 AS valid, array_to_string(iss, '; ') AS issues FROM (
 SELECT feature, list_filter([CASE WHEN missing::DOUBLE / n > 0.1 THEN printf('High missing ratio: %.2f%%', missing::DOUBLE / n * 100) END,
  CASE WHEN feature = 'entropy_risk_level' AND uniq::DOUBLE / n > 0.5 THEN concat('High cardinality: ', uniq, ' unique values') END,
  CASE WHEN ref_std > 0 AND abs(mean - ref_mean) / ref_std > 3 THEN printf('Mean shifted by %.1f std devs', abs(mean - ref_mean) / ref_std) END], lambda x: x IS NOT NULL) AS iss
 FROM (SELECT feature, count(*) AS n, count(*) - count(value) AS missing, count(DISTINCT value) AS uniq, avg(value) AS mean FROM frows GROUP BY 1)
 JOIN (SELECT feature, avg(value) AS ref_mean, stddev_samp(value) AS ref_std FROM frows WHERE date < (SELECT max(date) FROM act) - INTERVAL 15 DAY GROUP BY 1) USING (feature))""",
       **_PIPE, frows=_FEATURE_ROWS)
def event_feature_warnings(spark, sf):
    """Every feature judged against the rows that are older than fifteen days."""
    rows = T0.stage(_pipeline(spark, sf), "event-features")
    older = rows.filter(F.col("date") < rollup.latest(rows, "date") - F.expr("INTERVAL 15 DAYS"))
    judged = S.pipeline_warnings(rows, older)
    return judged.select("feature", "feature_id", "valid", F.array_join("issues", "; ").alias("issues"))


@query("feature_ids", "SELECT event_type AS name, count(*) AS n, substring(md5(concat(event_type, ':1.0.0')), 1, 8) AS feature_id FROM ev GROUP BY 1")
def feature_ids(spark, sf):
    from conductrisk.functions.common import feature_id
    kinds = A.events(spark, sf).groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    return kinds.withColumn("feature_id", feature_id("name", F.lit("1.0.0")))

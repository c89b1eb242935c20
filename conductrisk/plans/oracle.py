"""SQL twins: shared common table expressions and a helper that adds those a query needs."""

from __future__ import annotations

import re

from conductrisk import config as C
from conductrisk import adapters as A

DAILY = C.DAILY_FEATURES


def _case(key: str, mapping: dict, default="NULL") -> str:
    whens = " ".join(f"WHEN {key} = '{k}' THEN {_lit(v)}" for k, v in mapping.items())
    return f"(CASE {whens} ELSE {_lit(default)} END)" if mapping else _lit(default)


def _lit(v) -> str:
    if isinstance(v, str) and v != "NULL":
        return "'" + v.replace("'", "''") + "'"
    return f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)


def any_of(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_lit(w)})" for w in words) + ")"


def case_rows(rows: list[tuple[str, str]], default: str) -> str:
    return "(CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rows) + f" ELSE {default} END)"


def role_apps(text: str, table: dict[str, list[str]]) -> str:
    return "(" + " OR ".join(f"(role = '{r}' AND {any_of(text, a)})" for r, a in table.items()) + ")"


def clamp(x: str, lo="0.0::DOUBLE", hi="100.0::DOUBLE") -> str:
    return f"greatest({lo}, least({hi}, {x}))"


CTES: dict[str, str] = {}

CTES["ev"] = """
SELECT event_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       concat('U', user_id) AS "user", concat('PC-', user_id) AS pc, user_id AS user_key
FROM events"""

CTES["act"] = """
SELECT concat('E', lpad(CAST(event_id AS VARCHAR), 12, '0')) AS id, "user", ts AS date, pc,
  CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'Device' WHEN event_type IN ('error', 'click', 'purchase') THEN 'File'
       WHEN event_type = 'signup' THEN 'Logon' WHEN event_type = 'view' THEN 'Http' END AS source,
  CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'Connect' WHEN event_type = 'error' THEN 'File Delete'
       WHEN event_type = 'signup' THEN 'Logon' WHEN event_type = 'view' THEN 'Http Request'
       WHEN event_type = 'click' THEN 'File Open' WHEN event_type = 'purchase' THEN 'File Copy' END AS activity,
  (event_type = 'purchase' AND k >= 50) AS to_removable_media, k, hour(ts) AS hour, CAST(ts AS DATE) AS day
FROM ev"""

CTES["roster"] = f"""
SELECT concat('U', u.user_id) AS "user", c.c_name AS name,
  {_case('c.c_mktsegment', A.ROLE_OF)} AS role, n.n_name AS department,
  concat('PC-', u.user_id) AS pc, u.user_id AS user_key
FROM (SELECT DISTINCT user_id FROM events) u
JOIN customer c ON c.c_custkey = u.user_id JOIN nation n ON n.n_nationkey = c.c_nationkey"""

CTES["people"] = f"""
SELECT concat('U', c.c_custkey) AS "user", c.c_name AS name, {_case('c.c_mktsegment', A.ROLE_OF)} AS role, n.n_name AS department
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey"""

_APPS = "[" + ", ".join(_lit(a) for a in A.APPS) + "]"
CTES["telemetry"] = f"""
SELECT event_id AS id, ts AS timestamp, "user" AS user_id,
  concat('session_', "user", '_', strftime(ts, '%Y%m%d')) AS session_id,
  value AS mouse_velocity_avg, value / 4 AS mouse_velocity_std,
  CAST(k % 7 AS BIGINT) AS mouse_click_count, CAST(k % 11 AS BIGINT) AS mouse_positions_count,
  value * 2 + k AS keystroke_flight_avg_ms, 1.0::DOUBLE + k / 2.0::DOUBLE AS keystroke_flight_std_ms,
  CAST(k % 50 AS BIGINT) AS keystroke_count, ({_APPS})[k % {len(A.APPS)} + 1] AS active_app,
  concat('Window ', k) AS window_title, concat('p', k) AS process_id
FROM ev"""

_CATS = "[" + ", ".join(_lit(a) for a in A.APP_CATEGORIES) + "]"
CTES["bio"] = f"""
SELECT event_id AS id, "user", ts AS timestamp,
  CAST((event_id * 37) % 1920 AS DOUBLE) AS mouse_x, CAST((event_id * 53 + k) % 1080 AS DOUBLE) AS mouse_y,
  CASE WHEN k % 10 = 0 THEN 0.0::DOUBLE ELSE value END AS mouse_velocity,
  epoch_us(ts) / 1000.0::DOUBLE AS key_press_time, epoch_us(ts) / 1000.0::DOUBLE + 40 + k AS key_release_time,
  ({_CATS})[k % {len(A.APP_CATEGORIES)} + 1] AS app_category, event_type AS activity_type,
  CASE WHEN event_type = 'view' THEN concat('site', k % 13, '.example') END AS domain,
  CASE WHEN k < 60 THEN 1 ELSE 0 END AS is_productive_app, CASE WHEN k >= 90 THEN 1 ELSE 0 END AS is_idle,
  CASE WHEN event_type = 'view' AND k % 13 >= 10 THEN 1 ELSE 0 END AS is_non_work_http,
  CASE WHEN event_type IN ('click', 'purchase') THEN 1 END AS file_operation
FROM ev"""

# --- daily features ------------------------------------------------------------
CTES["flags"] = """
SELECT *, (source = 'File' AND activity = 'File Copy') AS is_file_copy,
  (source = 'File' AND contains(lower(activity), 'delete')) AS is_delete,
  (source = 'Device' AND activity = 'Connect') AS is_usb_connect,
  (hour < 7 OR hour >= 20) AS odd, source <> 'Http' AS not_web
FROM act"""

CTES["gaps"] = """
SELECT "user", day, (epoch_us(date) - lag(epoch_us(date)) OVER (PARTITION BY "user", day ORDER BY date, id)) / 1000000.0::DOUBLE AS gap
FROM act"""

CTES["day_iav"] = """
SELECT "user", day, CASE WHEN count(gap) >= 2 THEN var_samp(gap) ELSE 0.0::DOUBLE END AS iav
FROM gaps GROUP BY 1, 2"""

CTES["day_entropy"] = """
SELECT "user", day, greatest(0.0::DOUBLE, ln(sum(n)::DOUBLE) - sum(n * ln(n::DOUBLE)) / sum(n)) AS login_entropy
FROM (SELECT "user", day, hour, count(*) AS n FROM act GROUP BY 1, 2, 3) GROUP BY 1, 2"""

CTES["day_counts"] = """
SELECT "user", day, count(*) AS n, count_if(source = 'File') AS file_count, count_if(source = 'Email') AS email_count,
  count_if(odd)::DOUBLE / count(*) AS oaf, count_if(is_file_copy) AS file_copy_count, count_if(is_usb_connect) AS usb_count,
  count_if(to_removable_media AND not_web) AS removable_media_count, count_if(is_delete) AS delete_count,
  count_if(odd AND not_web) AS after_hours_count, count_if(not_web) AS event_count,
  CASE WHEN count_if(not_web) = 0 THEN 0.0::DOUBLE ELSE count_if(odd AND not_web)::DOUBLE / count_if(not_web) END AS after_hours_ratio
FROM flags GROUP BY 1, 2"""

CTES["day_role"] = """
SELECT d.*, coalesce(r.role, 'Unknown') AS role FROM day_counts d LEFT JOIN roster r USING ("user")"""

CTES["peers"] = """
SELECT role, day, avg(file_count) AS pf, avg(email_count) AS pe, stddev_samp(email_count) AS ps
FROM day_role GROUP BY 1, 2"""

CTES["daily"] = """
SELECT d."user", d.role, d.day, isodow(d.day) - 1 AS day_of_week,
  d.file_count / (p.pf + 1e-6::DOUBLE) AS far, coalesce((d.email_count - p.pe) / (p.ps + 1e-6::DOUBLE), 0.0::DOUBLE) AS eds,
  v.iav, d.oaf, e.login_entropy, d.file_count, d.email_count, d.file_copy_count, d.usb_count, d.removable_media_count,
  d.delete_count, d.after_hours_count, d.after_hours_ratio, d.event_count
FROM day_role d JOIN peers p USING (role, day) JOIN day_iav v USING ("user", day) JOIN day_entropy e USING ("user", day)"""

# --- sequence errors and model metadata ------------------------------------------
CTES["weighted"] = """
SELECT *, i, greatest(0, least(i, n - 9) - greatest(1, i - 9) + 1) AS w
FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY day) AS i, count(*) OVER (PARTITION BY "user") AS n FROM daily)"""


def _scaler(group: str) -> str:
    parts = []
    for f in DAILY:
        m = f"(sum(w * {f}::DOUBLE) / sum(w))"
        v = f"(sum(w * {f}::DOUBLE * {f}::DOUBLE) / sum(w) - {m} * {m})"
        parts.append(f"{m} AS m_{f}, CASE WHEN {v} > 1e-12::DOUBLE * (1 + {m} * {m}) THEN sqrt({v}) ELSE 1.0::DOUBLE END AS s_{f}")
    return ", ".join(parts) + f" FROM weighted WHERE w > 0 {group}"


def _row_error(alias: str) -> str:
    z = [f"(({f}::DOUBLE - {alias}.m_{f}) / {alias}.s_{f})" for f in DAILY]
    return "(" + " + ".join(f"{x} * {x}" for x in z) + f") / {len(DAILY)}"


_ROLES = ", ".join(_lit(r) for r in C.MODEL_ROLES)
CTES["scale_role"] = "SELECT role, " + _scaler(f"AND role IN ({_ROLES}) GROUP BY role")
CTES["scale_all"] = "SELECT " + _scaler("")
CTES["row_errors"] = f"""
SELECT w.*, {_row_error('r')} AS own_row, {_row_error('g')} AS global_row
FROM weighted w LEFT JOIN scale_role r ON w.role = r.role CROSS JOIN scale_all g"""
CTES["errors"] = """
SELECT *, CASE WHEN i >= 10 THEN avg(own_row) OVER f END AS own_error, CASE WHEN i >= 10 THEN avg(global_row) OVER f END AS global_error
FROM row_errors WINDOW f AS (PARTITION BY "user" ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""
CTES["model_errors"] = """
SELECT role AS model, own_error AS error FROM errors WHERE own_error IS NOT NULL
UNION ALL SELECT 'global', global_error FROM errors WHERE global_error IS NOT NULL"""
CTES["metadata"] = """
SELECT model, count(*) AS n_sequences, quantile_cont(error, 0.995) AS threshold, avg(error) AS error_mean, stddev_pop(error) AS error_std,
  quantile_cont(error, 0.5) AS error_p50, quantile_cont(error, 0.95) AS error_p95, quantile_cont(error, 0.99) AS error_p99
FROM model_errors GROUP BY 1"""
CTES["anomalies"] = """
SELECT e.* EXCLUDE (own_row, global_row, own_error, global_error, w, i, n), coalesce(own_error, global_error, 0.0::DOUBLE) AS anomaly_score,
  CASE WHEN r.model IS NULL THEN g.error_mean ELSE r.error_mean END AS error_mean,
  CASE WHEN r.model IS NULL THEN g.error_std ELSE r.error_std END AS error_std,
  CASE WHEN r.model IS NULL THEN g.threshold ELSE r.threshold END AS threshold
FROM errors e LEFT JOIN metadata r ON r.model = e.role LEFT JOIN metadata g ON g.model = 'global'"""

# --- scores ----------------------------------------------------------------------
CTES["score_parts"] = f"""
SELECT *, CASE WHEN threshold - error_mean > 1e-6 THEN {clamp('(anomaly_score - error_mean) / (threshold - error_mean) * 45.0::DOUBLE')}
    WHEN error_std > 1e-6 THEN {clamp('(anomaly_score - error_mean) / error_std * 25.0::DOUBLE')}
    ELSE least(100.0::DOUBLE, greatest(0.0::DOUBLE, anomaly_score - 0.16::DOUBLE) * 250.0::DOUBLE) END AS base_risk,
  CASE role WHEN 'Admin' THEN 1.5::DOUBLE WHEN 'Contractor' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS role_multiplier,
  (after_hours_ratio > 0.3::DOUBLE AND after_hours_count >= 6) AS ah_day,
  CASE WHEN file_copy_count > 0 THEN 4.0::DOUBLE WHEN usb_count > 0 THEN 3.0::DOUBLE WHEN delete_count > 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS activity_multiplier,
  CASE WHEN file_copy_count > 0 THEN 'File Copy' WHEN usb_count > 0 THEN 'Connect' WHEN delete_count > 0 THEN 'File Delete' END AS activity_reason
FROM anomalies"""
CTES["score_product"] = """
SELECT *, CASE WHEN ah_day THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS time_multiplier,
  (CASE WHEN usb_count > 0 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN removable_media_count > 0 THEN 1.4::DOUBLE ELSE 1.0::DOUBLE END)
  * (CASE WHEN file_copy_count > 5 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN ah_day THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END) AS behaviour_multiplier,
  (file_copy_count > 0 AND usb_count > 0 AND ah_day) AS is_pattern
FROM score_parts"""
CTES["scored"] = """
SELECT *, least(100.0::DOUBLE, CASE WHEN is_pattern THEN greatest(base_risk * role_multiplier * time_multiplier * activity_multiplier * behaviour_multiplier, 85.0::DOUBLE)
    ELSE base_risk * role_multiplier * time_multiplier * activity_multiplier * behaviour_multiplier END) AS risk_score,
  CASE WHEN file_copy_count > 0 THEN 'TA0010' WHEN usb_count > 0 THEN 'TA0010' WHEN delete_count > 0 THEN 'TA0040' WHEN ah_day THEN 'TA0006' ELSE '' END AS mitre_tactic,
  CASE WHEN file_copy_count > 0 THEN 'Exfiltration' WHEN usb_count > 0 THEN 'Exfiltration' WHEN delete_count > 0 THEN 'Impact' WHEN ah_day THEN 'Credential Access' END AS tactic_name,
  CASE WHEN file_copy_count > 0 THEN 'T1052' WHEN usb_count > 0 THEN 'T1200' WHEN delete_count > 0 THEN 'T1485' WHEN ah_day THEN 'T1078' ELSE '' END AS mitre_technique,
  CAST(day AS TIMESTAMP) AS date
FROM score_product"""
CTES["factored"] = """
SELECT *, list_filter([
   CASE WHEN base_risk > 10 THEN printf('Anomaly score %.3f (role-normalised)', anomaly_score) END,
   CASE WHEN role_multiplier > 1 THEN concat(role, ' role (+', CAST(trunc((role_multiplier - 1) * 100) AS INTEGER), '%)') END,
   CASE WHEN ah_day THEN concat('After-hours activity pattern (', CAST(round_even(after_hours_ratio * 100, 0) AS BIGINT), '%, ', after_hours_count, ' events)') END,
   CASE WHEN activity_multiplier > 1 THEN concat(activity_reason, ' activity (+', CAST(trunc((activity_multiplier - 1) * 100) AS INTEGER), '%)') END,
   CASE WHEN usb_count > 0 THEN concat('USB connect activity (', usb_count, ' events)') END,
   CASE WHEN removable_media_count > 0 THEN concat('Removable-media writes (', removable_media_count, ' files)') END,
   CASE WHEN file_copy_count > 5 THEN concat('High file-copy volume (', file_copy_count, ' files)') END,
   CASE WHEN ah_day THEN concat('Elevated after-hours ratio (', CAST(round_even(after_hours_ratio * 100, 0) AS BIGINT), '%)') END,
   CASE WHEN is_pattern THEN 'PATTERN: File copy + USB + After-hours exfil' END], lambda x: x IS NOT NULL) AS factors
FROM scored"""
CTES["explained"] = """
SELECT *, coalesce(factors[1], 'Normal activity') AS primary_factor,
  CASE WHEN risk_score < 50 THEN 'Low risk - normal activity pattern.' ELSE concat('Risk score ', CAST(round_even(risk_score, 0) AS BIGINT), '/100. ',
    CASE WHEN len(factors) > 0 THEN concat('Contributing factors: ', array_to_string(factors[1:3], '; '), '. ') ELSE '' END,
    CASE WHEN tactic_name IS NOT NULL THEN concat('Maps to MITRE ', mitre_tactic, ' - ', tactic_name, '.') ELSE '' END) END AS explanation
FROM factored"""

# --- alerts: the ordered fold as a recursion over the rows of each user ------------
CTES["fold_rows"] = """
SELECT "user", date, risk_score, row_number() OVER (PARTITION BY "user" ORDER BY date) AS i FROM scored"""
CTES["fold"] = """
SELECT "user", 0::BIGINT AS i, 0 AS hits, NULL::TIMESTAMP AS last, FALSE AS fired FROM (SELECT DISTINCT "user" FROM fold_rows)
UNION ALL
SELECT r."user", r.i,
  CASE WHEN r.risk_score < 70 THEN 0 WHEN f.last IS NOT NULL AND epoch_us(r.date) - epoch_us(f.last) < 86400000000 AND r.risk_score < 95 THEN f.hits
       WHEN f.hits + 1 >= 2 THEN 0 ELSE f.hits + 1 END,
  CASE WHEN r.risk_score >= 70 AND NOT coalesce(epoch_us(r.date) - epoch_us(f.last) < 86400000000 AND r.risk_score < 95, FALSE) AND f.hits + 1 >= 2 THEN r.date ELSE f.last END,
  r.risk_score >= 70 AND NOT coalesce(epoch_us(r.date) - epoch_us(f.last) < 86400000000 AND r.risk_score < 95, FALSE) AND f.hits + 1 >= 2
FROM fold f JOIN fold_rows r ON r."user" = f."user" AND r.i = f.i + 1"""
CTES["alerted"] = """
SELECT r."user", r.date, r.risk_score, f.fired AS should_alert,
  CASE WHEN NOT f.fired THEN '' WHEN r.risk_score >= 95 THEN 'CRITICAL' WHEN r.risk_score >= 85 THEN 'HIGH' ELSE 'MEDIUM' END AS alert_severity
FROM fold_rows r JOIN fold f ON f."user" = r."user" AND f.i = r.i"""

# --- user roll-up ------------------------------------------------------------------
CTES["user_totals"] = """
SELECT "user", greatest(0.0::DOUBLE, max(risk_score)) AS max_risk,
  sum(CASE WHEN risk_score <> 0 THEN risk_score * pow(0.9::DOUBLE, date_diff('day', date, (SELECT max(date) FROM scored))) ELSE 0.0::DOUBLE END) AS decayed_sum,
  count(*) AS event_count
FROM scored GROUP BY 1"""
CTES["series"] = """
SELECT "user", CAST(date AS DATE) AS day, avg(risk_score) AS daily_risk FROM scored GROUP BY 1, 2"""
CTES["base_raw"] = """
SELECT "user", count(*) FILTER (back BETWEEN 7 AND 20) AS baseline_count, avg(daily_risk) FILTER (back BETWEEN 7 AND 20) AS a,
  stddev_pop(daily_risk) FILTER (back BETWEEN 7 AND 20) AS s, min(daily_risk) FILTER (back BETWEEN 7 AND 20) AS lo,
  max(daily_risk) FILTER (back BETWEEN 7 AND 20) AS hi, max(daily_risk) FILTER (back <= 6) AS recent_risk
FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY day DESC) AS back FROM series) GROUP BY 1"""
CTES["bases"] = """
SELECT "user", baseline_count, baseline_count >= 3 AS baseline_valid, CASE WHEN baseline_count >= 3 THEN a ELSE 0.0::DOUBLE END AS baseline_avg,
  CASE WHEN baseline_count >= 3 THEN s ELSE 0.0::DOUBLE END AS baseline_std, CASE WHEN baseline_count >= 3 THEN lo END AS baseline_min,
  CASE WHEN baseline_count >= 3 THEN hi END AS baseline_max, recent_risk
FROM base_raw"""
CTES["drifts"] = """
SELECT *, CASE WHEN NOT baseline_valid THEN FALSE WHEN baseline_std < 1 THEN recent_risk > baseline_avg + 15 ELSE (recent_risk - baseline_avg) / baseline_std > 2 END AS is_drift,
  CASE WHEN NOT baseline_valid THEN 0.0::DOUBLE WHEN baseline_std < 1 THEN CASE WHEN recent_risk > baseline_avg + 15 THEN recent_risk - baseline_avg ELSE 0.0::DOUBLE END
       ELSE (recent_risk - baseline_avg) / baseline_std END AS deviation_sigma,
  CASE WHEN NOT baseline_valid THEN 'Insufficient baseline data'
       WHEN baseline_std < 1 AND recent_risk > baseline_avg + 15 THEN printf('Recent daily risk %.1f >> baseline avg=%.1f (low-variance user)', recent_risk, baseline_avg)
       WHEN baseline_std < 1 THEN 'Within expected range (low variance user)'
       WHEN (recent_risk - baseline_avg) / baseline_std > 2 THEN printf('Recent daily risk %.1f exceeds baseline (avg=%.1f, +%.1f sigma)', recent_risk, baseline_avg, (recent_risk - baseline_avg) / baseline_std)
       ELSE 'Within 2.0 sigma of baseline' END AS drift_explanation
FROM bases"""
CTES["report"] = """
SELECT t."user", t.max_risk * 1.0::DOUBLE + t.decayed_sum * 0.1::DOUBLE AS total_risk_score, t.max_risk, t.event_count, d.is_drift, d.deviation_sigma, d.drift_explanation
FROM user_totals t JOIN drifts d USING ("user")"""

# --- live telemetry ------------------------------------------------------------------
CTES["user_base"] = ""  # filled below, needs the scored rows' productivity
_LOW = "lower(active_app)"
CTES["tele_role"] = """
SELECT t.*, coalesce(r.role, 'Employee') AS role FROM telemetry t LEFT JOIN roster r ON r."user" = t.user_id"""
CTES["tele_prod"] = f"""
SELECT *, CASE WHEN {role_apps(_LOW, C.ROLE_APPS)} OR {any_of(_LOW, C.PRODUCTIVE_APPS)} THEN 1.0::DOUBLE WHEN {any_of(_LOW, C.NEUTRAL_APPS)} THEN 0.7::DOUBLE
    WHEN {any_of(_LOW, C.DISTRACTED_APPS)} THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END AS productivity_score,
  CASE WHEN {role_apps(_LOW, C.ROLE_APPS)} OR {any_of(_LOW, C.PRODUCTIVE_APPS)} THEN 'productive' WHEN {any_of(_LOW, C.NEUTRAL_APPS)} THEN 'neutral'
    WHEN {any_of(_LOW, C.DISTRACTED_APPS)} THEN 'distracted' ELSE 'neutral' END AS productivity_category,
  concat(CASE WHEN {role_apps(_LOW, C.ROLE_APPS)} OR {any_of(_LOW, C.PRODUCTIVE_APPS)} THEN 'Using role-permitted app: ' WHEN {any_of(_LOW, C.NEUTRAL_APPS)} THEN 'Using neutral app: '
    WHEN {any_of(_LOW, C.DISTRACTED_APPS)} THEN 'Distracted by non-work app: ' ELSE 'Unknown application: ' END, active_app) AS productivity_text,
  hour(timestamp) AS hour, isodow(timestamp) >= 6 AS weekend
FROM tele_role"""
CTES["user_base"] = """
SELECT user_id, avg(mouse_velocity_avg) AS mv_avg, avg(mouse_velocity_std) AS mv_std, avg(keystroke_flight_avg_ms) AS kf_avg,
  avg(keystroke_flight_std_ms) AS kf_std, avg(productivity_score) AS prod_avg
FROM tele_prod WHERE timestamp >= (SELECT max(timestamp) FROM telemetry) - INTERVAL 7 DAY GROUP BY 1"""
CTES["fresh_base"] = """
SELECT t.id, t.user_id, count(*) AS n, avg(b.mouse_velocity_avg) AS mv_avg, avg(b.mouse_velocity_std) AS mv_std, avg(b.keystroke_flight_avg_ms) AS kf_avg,
  avg(b.keystroke_flight_std_ms) AS kf_std, avg(b.productivity_score) AS prod_avg
FROM tele_prod t JOIN tele_prod b ON b.user_id = t.user_id AND floor(epoch(b.timestamp)) <= floor(epoch(t.timestamp)) AND floor(epoch(b.timestamp)) >= floor(epoch(t.timestamp)) - 604800
WHERE t.id % 10 = 0 GROUP BY t.id, t.user_id"""
CTES["base_of"] = """
SELECT id, last_value(CASE WHEN id % 10 = 0 THEN id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base_id FROM tele_prod"""
_Z = """
SELECT t.*, b.mv_avg, b.mv_std, b.kf_avg, b.kf_std, b.user_id IS NOT NULL AS has_baseline,
  (abs(mouse_velocity_avg - b.mv_avg) / (b.mv_std + 1e-6::DOUBLE) + abs(keystroke_flight_avg_ms - b.kf_avg) / (b.kf_std + 1e-6::DOUBLE)) / 2 AS z,
  (abs(mouse_velocity_avg - b.mv_avg) / (b.mv_std + 1) + abs(keystroke_flight_avg_ms - b.kf_avg) / (b.kf_std + 1)) / 2 AS z1
FROM tele_prod t"""
CTES["tele_z"] = _Z + " JOIN base_of o ON o.id = t.id LEFT JOIN fresh_base b ON b.id = o.base_id"
#: The same with one fixed baseline per user.
STATIC_Z = _Z + " LEFT JOIN user_base b ON b.user_id = t.user_id"
_W = lambda part: _case("role", {r: p[part] for r, p in C.ROLE_PROFILES.items()}, C.ROLE_PROFILES["Employee"][part])
CTES["tele_parts"] = f"""
SELECT *, CASE WHEN NOT has_baseline THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, z / 3) END AS deviation_score,
  CASE WHEN NOT has_baseline THEN 0.0::DOUBLE WHEN z > 3 THEN 3.0::DOUBLE WHEN z > 2 THEN 2.0::DOUBLE WHEN z > 1.5 THEN 1.5::DOUBLE ELSE z END AS sigma_level,
  CASE WHEN NOT has_baseline THEN 'No baseline available' WHEN z > 3 THEN 'CRITICAL: >3σ deviation - Potential account takeover'
    WHEN z > 2 THEN 'HIGH: >2σ deviation - Impaired user or different person' WHEN z > 1.5 THEN 'MODERATE: >1.5σ deviation - Unusual pattern' ELSE 'NORMAL: Within expected range' END AS deviation_text,
  CASE WHEN {role_apps(_LOW, C.LIVE_ROLE_APPS)} THEN 0.0::DOUBLE WHEN {any_of(_LOW, C.LIVE_PRODUCTIVE_APPS)} THEN 10.0::DOUBLE
    WHEN {any_of(_LOW, C.LIVE_DISTRACTED_APPS)} THEN 80.0::DOUBLE ELSE 40.0::DOUBLE END AS c_productivity,
  CASE WHEN NOT has_baseline THEN 20.0::DOUBLE WHEN z1 < 1 THEN 10.0::DOUBLE WHEN z1 < 2 THEN 40.0::DOUBLE WHEN z1 < 3 THEN 70.0::DOUBLE ELSE 90.0::DOUBLE END AS c_behaviour,
  20.0::DOUBLE AS c_entropy, CASE WHEN hour < 6 OR hour > 22 THEN 60.0::DOUBLE WHEN weekend THEN 40.0::DOUBLE ELSE 10.0::DOUBLE END AS c_context,
  CASE WHEN hour >= 22 OR hour < 6 THEN 2.5::DOUBLE WHEN hour < 9 THEN 1.5::DOUBLE WHEN hour >= 17 THEN 1.8::DOUBLE WHEN weekend THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS time_multiplier
FROM tele_z"""
CTES["tele_risk"] = f"""
SELECT *, least(5.0::DOUBLE, (CASE WHEN productivity_score < 0.5 THEN 1.5::DOUBLE WHEN productivity_score < 0.7::DOUBLE THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END)
    * (CASE WHEN sigma_level > 2 THEN 2.0::DOUBLE WHEN sigma_level > 1.5 THEN 1.5::DOUBLE WHEN sigma_level > 1 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END)
    * (CASE WHEN hour < 7 OR hour > 20 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN weekend THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END)) AS risk_multiplier,
  {clamp(f"(c_productivity * {_W('productivity')} + c_behaviour * {_W('behaviour')} + c_entropy * {_W('entropy')} + c_context * {_W('context')}) * time_multiplier")} AS live_risk
FROM tele_parts"""
_APP_TACTIC = [(any_of(_LOW, w), t) for w, t, _ in C.APP_TACTICS]
_APP_TECHNIQUE = [(any_of(_LOW, w), t) for w, _, t in C.APP_TACTICS]
CTES["tele_final"] = f"""
SELECT *, deviation_score * risk_multiplier AS raw_anomaly, {clamp('greatest(deviation_score * risk_multiplier * 100, live_risk)')} AS risk_score FROM tele_risk"""
CTES["tele"] = f"""
SELECT *, risk_score / 100 AS anomaly_score,
  {case_rows([(c, _lit(t)) for c, t in _APP_TACTIC] + [("(hour < 8 OR hour > 20) AND risk_score >= 60", "'TA0003'"), ("risk_score >= 80", "'TA0009'")], "NULL")} AS mitre_tactic,
  {case_rows([(c, _lit(t)) for c, t in _APP_TECHNIQUE] + [("(hour < 8 OR hour > 20) AND risk_score >= 60", "'T1078'"), ("risk_score >= 80", "'T1119'")], "NULL")} AS mitre_technique
FROM tele_final"""
CTES["latest_tele"] = """
SELECT user_id, arg_max(risk_score, timestamp) AS risk_score, arg_max(productivity_score, timestamp) AS productivity_score, max(timestamp) AS last_seen
FROM tele GROUP BY 1"""
CTES["accounts"] = """
SELECT r."user" AS user_id, r.name, concat(lower(r."user"), '@example.com') AS email, r.role, r.department, (r.user_key % 20 <> 0) AS is_active,
  concat('U', r.user_key // 10) AS manager_id, l.last_seen, l.risk_score, l.productivity_score
FROM roster r LEFT JOIN latest_tele l ON l.user_id = r."user" """
CTES["live_alerts"] = """
SELECT t.id, printf('ALT-%05d', t.id) AS alert_id, t.user_id, coalesce(a.name, t.user_id) AS name, coalesce(a.role, 'Employee') AS role, coalesce(a.department, 'General') AS department,
  CASE WHEN t.risk_score >= 80 THEN 'Critical' WHEN t.risk_score >= 60 THEN 'High' ELSE 'Medium' END AS severity, t.risk_score, t.timestamp,
  concat('Anomalous behaviour detected in ', t.active_app, ' — ', t.window_title) AS activity, t.mitre_tactic, t.mitre_technique, 'open' AS status
FROM tele t JOIN accounts a ON a.user_id = t.user_id WHERE t.risk_score >= 50"""

_NAME = re.compile(r"[a-z_][a-z0-9_]*")
_RECURSIVE = {"fold"}


def _needed(sql: str, known: dict[str, str]) -> set[str]:
    return {w for w in _NAME.findall(sql) if w in known}


def _filtered_counts(text: str) -> str:
    """Spell count_if(x) as a filtered count: never null, and a 64-bit integer as in Spark."""
    out, pos = [], 0
    while (start := text.find("count_if(", pos)) >= 0:
        depth, end = 0, start + len("count_if")
        while True:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
            if depth == 0:
                break
        inner = text[start + len("count_if("):end - 1]
        out += [text[pos:start], f"count(*) FILTER (WHERE {inner})"]
        pos = end
    return "".join(out) + text[pos:]


def sql(text: str, **extra: str) -> str:
    """Prefix a query with the common table expressions it uses, in dependency order."""
    text = _filtered_counts(text)
    known = {n: _filtered_counts(t) for n, t in {**CTES, **extra}.items()}
    order: list[str] = []

    def visit(name: str, path: tuple = ()):
        if name in order or name in path:
            return
        for dep in sorted(_needed(known[name], known) - {name}):
            visit(dep, path + (name,))
        order.append(name)

    for name in sorted(_needed(text, known)):
        visit(name)
    if not order:
        return text.strip()
    parts = [
        f"{n} AS {'' if n in _RECURSIVE else 'MATERIALIZED '}({known[n].strip()})" for n in order
    ]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + text.strip()

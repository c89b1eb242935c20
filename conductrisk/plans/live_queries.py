"""Queries of the live path and of the dashboard reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from conductrisk import adapters as A
from conductrisk.functions import integrity as I
from conductrisk.functions.common import band
from conductrisk.operators import rollup
from conductrisk.operators import serving as S
from conductrisk.operators import telemetry as L
from conductrisk.operators.ordered import total_rank
from conductrisk.plans import tables as T0
from conductrisk.plans.registry import D, R, T, query, rounded, text_time

# --- payloads, baselines, scoring -------------------------------------------------------
@query("telemetry_payload_rows", f"""
SELECT id, user_id, {T("timestamp")}, session_id, {R("mouse_velocity_avg")}, {R("mouse_velocity_std")}, mouse_click_count, mouse_positions_count,
  {R("CASE WHEN id % 3 = 0 THEN 0 ELSE keystroke_flight_avg_ms END", "keystroke_flight_avg_ms")}, {R("CASE WHEN id % 3 = 0 THEN 0 ELSE keystroke_flight_std_ms END", "keystroke_flight_std_ms")},
  CASE WHEN id % 3 = 0 THEN 0 ELSE keystroke_count END AS keystroke_count, CASE WHEN id % 5 = 0 THEN 'unknown' ELSE active_app END AS active_app, window_title, process_id FROM telemetry""")
def telemetry_payload_rows(spark, sf):
    rows = L.flatten_payload(A.as_payload(A.events(spark, sf)))
    return text_time(rounded(rows, "mouse_velocity_avg", "mouse_velocity_std", "keystroke_flight_avg_ms", "keystroke_flight_std_ms"), "timestamp")


@query("recent_telemetry", f"SELECT id, user_id, {T('timestamp')} FROM (SELECT * FROM telemetry ORDER BY telemetry.timestamp DESC, id DESC LIMIT 100)")
def recent_telemetry(spark, sf):
    rows = A.telemetry(spark, sf).orderBy(F.desc("timestamp"), F.desc("id")).limit(100)
    return text_time(rows.select("id", "user_id", "timestamp"), "timestamp")


@query("user_telemetry_page", f"SELECT id, user_id, {T('timestamp')} FROM (SELECT * FROM telemetry WHERE user_id = 'U5' ORDER BY telemetry.timestamp DESC, id DESC LIMIT 20 OFFSET 10)")
def user_telemetry_page(spark, sf):
    rows = A.telemetry(spark, sf).filter("user_id = 'U5'").orderBy(F.desc("timestamp"), F.desc("id")).offset(10).limit(20)
    return text_time(rows.select("id", "user_id", "timestamp"), "timestamp")


@query("app_productivity", "SELECT id, productivity_score, productivity_category, productivity_text FROM tele_prod")
def app_productivity(spark, sf):
    rows = L.with_productivity(L.with_user_role(A.telemetry(spark, sf), A.roster(spark, sf)))
    return rows.select("id", "productivity_score", "productivity_category", "productivity_text")


_BASES = ["mv_avg", "mv_std", "kf_avg", "kf_std", "prod_avg"]


def _prepared(spark, sf):
    return L.with_productivity(L.with_user_role(A.telemetry(spark, sf), A.roster(spark, sf)))


@query("seven_day_baselines", f"SELECT user_id, {', '.join(R(n, digits=9) for n in _BASES)} FROM user_base")
def seven_day_baselines(spark, sf):
    rows = _prepared(spark, sf)
    return rounded(L.user_baselines(rows, rollup.latest(rows, "timestamp")), *_BASES, digits=9)


@query("telemetry_with_baseline", f"SELECT id, has_baseline, {R('coalesce(mv_avg, -1)', 'mv_avg')}, {R('coalesce(kf_avg, -1)', 'kf_avg')} FROM tele_z")
def telemetry_with_baseline(spark, sf):
    joined = L.with_baseline_as_of(_prepared(spark, sf))
    return rounded(joined.select("id", "has_baseline", "mv_avg", "kf_avg").fillna(-1.0), "mv_avg", "kf_avg")


@query("refreshed_baselines", f"""
SELECT id, user_id, n, {", ".join(R(x, digits=9) for x in ["mv_avg", "mv_std", "kf_avg", "kf_std", "prod_avg"])} FROM fresh_base""")
def refreshed_baselines(spark, sf):
    return rounded(L.refreshed_baselines(_prepared(spark, sf)), *_BASES, digits=9)


@query("signature_deviation", f"SELECT id, {R('deviation_score')}, {R('sigma_level')}, deviation_text FROM tele_parts")
def signature_deviation(spark, sf):
    rows = T0.telemetry(spark, sf).select("id", "deviation_score", "sigma_level", "deviation_text")
    return rounded(rows, "deviation_score", "sigma_level")


@query("integrity_multiplier", f"SELECT id, {R('risk_multiplier')}, {R('raw_anomaly')} FROM tele_final")
def integrity_multiplier(spark, sf):
    return rounded(T0.telemetry(spark, sf).select("id", "risk_multiplier", "raw_anomaly"), "risk_multiplier", "raw_anomaly")


@query("live_risk_components", f"SELECT id, c_productivity AS productivity, c_behaviour AS behaviour, c_entropy AS entropy, c_context AS context, {R('live_risk')} FROM tele_risk")
def live_risk_components(spark, sf):
    rows = T0.telemetry(spark, sf)
    names = ["productivity", "behaviour", "entropy", "context"]
    return rounded(rows.select("id", *[F.col(f"{n}_component").alias(n) for n in names], "live_risk"), "live_risk")


@query("time_multipliers", "SELECT id, time_multiplier FROM tele_parts")
def time_multipliers(spark, sf):
    return A.telemetry(spark, sf).select("id", I.time_multiplier(F.col("timestamp")).alias("time_multiplier"))


@query("live_risk_factors", """
SELECT id, array_to_string(list_filter([CASE WHEN c_productivity > 50 THEN 'Low productivity alignment' END, CASE WHEN c_behaviour > 50 THEN 'Behavioral anomaly detected' END,
  CASE WHEN c_entropy > 50 THEN 'Erratic session pattern' END, CASE WHEN c_context > 50 THEN 'Suspicious time context' END], lambda x: x IS NOT NULL), '; ') AS factors FROM tele_parts""")
def live_risk_factors(spark, sf):
    return T0.telemetry(spark, sf).select("id", F.array_join("live_factors", "; ").alias("factors"))


@query("app_tactics", """SELECT id, CASE WHEN contains(lower(active_app), 'telegram') THEN 'TA0010' WHEN contains(lower(active_app), '7zip') THEN 'TA0009'
  WHEN contains(lower(active_app), 'terminal') THEN 'TA0002' WHEN contains(lower(active_app), 'putty') THEN 'TA0008' END AS tactic FROM telemetry""")
def app_tactics(spark, sf):
    return A.telemetry(spark, sf).select("id", I.app_tactic(F.col("active_app"))["tactic"].alias("tactic"))


@query("scored_telemetry", f"SELECT id, user_id, role, {R('risk_score')}, {R('risk_multiplier')}, productivity_score, {R('anomaly_score')}, mitre_tactic, mitre_technique FROM tele")
def scored_telemetry(spark, sf):
    rows = T0.telemetry(spark, sf).select("id", "user_id", "role", "risk_score", "risk_multiplier", "productivity_score",
                                          "anomaly_score", "mitre_tactic", "mitre_technique")
    return rounded(rows, "risk_score", "risk_multiplier", "anomaly_score")


@query("hourly_telemetry", f"""
SELECT user_id, {T("date_trunc('hour', timestamp)", "hour_start")}, {R("avg(mouse_velocity_avg)", "avg_mouse_velocity")}, {R("avg(keystroke_flight_avg_ms)", "avg_keystroke_flight")},
  {R("avg(risk_score)", "avg_risk_score")}, {R("avg(productivity_score)", "avg_productivity")}, count(*) AS event_count FROM tele GROUP BY user_id, date_trunc('hour', timestamp)""")
def hourly_telemetry(spark, sf):
    rows = L.hourly_aggregate(T0.telemetry(spark, sf))
    return text_time(rounded(rows, "avg_mouse_velocity", "avg_keystroke_flight", "avg_risk_score", "avg_productivity"), "hour_start")


# --- keyed writes ---------------------------------------------------------------------
@query("latest_user_state", f"SELECT user_id, {R('risk_score')}, productivity_score, {T('last_seen')} FROM latest_tele")
def latest_user_state(spark, sf):
    return text_time(rounded(L.latest_state(T0.telemetry(spark, sf)), "risk_score"), "last_seen")


@query("baseline_upsert", f"""
SELECT user_id, {R("mv_avg")} FROM user_base UNION ALL
SELECT user_id, {R("avg(mouse_velocity_avg)", "mv_avg")} FROM telemetry WHERE timestamp < (SELECT max(timestamp) FROM telemetry) - INTERVAL 20 DAY AND user_id NOT IN (SELECT user_id FROM user_base) GROUP BY 1""")
def baseline_upsert(spark, sf):
    rows = _prepared(spark, sf)
    before = rollup.latest(rows, "timestamp") - F.expr("INTERVAL 20 DAYS")
    old = rows.filter(F.col("timestamp") < before).groupBy("user_id").agg(F.avg("mouse_velocity_avg").alias("mv_avg"))
    new = L.user_baselines(rows, rollup.latest(rows, "timestamp")).select("user_id", "mv_avg")
    return rounded(L.upsert(old, new, "user_id"), "mv_avg")


@query("insert_missing_users", """
SELECT "user" AS user_id, CASE WHEN role = 'Admin' THEN 'known' ELSE 'added' END AS origin FROM roster""")
def insert_missing_users(spark, sf):
    users = A.roster(spark, sf)
    old = users.filter("role = 'Admin'").select(F.col("user").alias("user_id"), F.lit("known").alias("origin"))
    return L.insert_missing(old, users.select(F.col("user").alias("user_id"), F.lit("added").alias("origin")), "user_id")


@query("account_changes", """
SELECT user_id, CASE WHEN role = 'Admin' THEN 'Renamed' ELSE name END AS name, CASE WHEN role = 'Developer' THEN 'Moved' ELSE department END AS department, CASE WHEN role = 'Contractor' THEN FALSE ELSE is_active END AS is_active
FROM (SELECT "user" AS user_id, name, department, user_key % 20 <> 0 AS is_active, role FROM roster)""")
def account_changes(spark, sf):
    users = A.roster(spark, sf)
    key = F.col("user_key")
    old = users.select(F.col("user").alias("user_id"), "name", "department", (key % 20 != 0).alias("is_active"))
    changes = users.select(
        F.col("user").alias("user_id"), F.when(F.col("role") == "Admin", "Renamed").alias("name"),
        F.when(F.col("role") == "Developer", "Moved").alias("department"),
        F.when(F.col("role") == "Contractor", F.lit(False)).alias("is_active"),
    ).filter("name is not null or department is not null or is_active is not null")
    return L.apply_changes(old, changes, "user_id")


# --- dashboard reads -------------------------------------------------------------------
_ALERT = ["id", "alert_id", "user_id", "name", "role", "department", "severity", "risk_score", "activity", "mitre_tactic", "mitre_technique"]
_ALERT_SQL = ", ".join(R("risk_score") if c == "risk_score" else c for c in _ALERT)


def _alerts(spark, sf):
    rows, accounts = T0.live_tables(spark, sf)
    return S.live_alerts(rows, accounts)


@query("live_alerts", f"SELECT {_ALERT_SQL} FROM live_alerts")
def live_alerts(spark, sf):
    return rounded(_alerts(spark, sf).select(_ALERT), "risk_score")


@query("filtered_alerts", """
SELECT id, severity, user_id, 'severity' AS filter FROM live_alerts WHERE severity = 'High' UNION ALL
SELECT id, severity, user_id, 'user' FROM live_alerts WHERE user_id = 'U5' UNION ALL SELECT id, severity, user_id, 'open' FROM live_alerts""")
def filtered_alerts(spark, sf):
    rows = T0.stage(_alerts(spark, sf), "alerts")
    pick = lambda df, name: df.select("id", "severity", "user_id", F.lit(name).alias("filter"))
    return (
        pick(S.filter_alerts(rows, severity="high"), "severity")
        .unionByName(pick(S.filter_alerts(rows, user="U5"), "user"))
        .unionByName(pick(S.filter_alerts(rows, status="open"), "open"))
        .unionByName(pick(S.filter_alerts(rows, status="closed"), "closed"))
    )


@query("alert_search", "SELECT id, user_id FROM live_alerts WHERE contains(lower(concat(user_id, ' ', name)), 'u12')")
def alert_search(spark, sf):
    return S.search(_alerts(spark, sf), "U12", ["user_id", "name"]).select("id", "user_id")


@query("roster_search", """SELECT "user", role FROM roster WHERE contains(lower(concat_ws(' ', "user", name, role, department)), 'nation_1')""")
def roster_search(spark, sf):
    return S.search(A.roster(spark, sf), " nation_1 ", ["user", "name", "role", "department"]).select("user", "role")


@query("alert_page", f"SELECT id, {R('risk_score')}, (SELECT count(*) FROM live_alerts) AS total FROM (SELECT * FROM live_alerts ORDER BY live_alerts.risk_score DESC, id LIMIT 25 OFFSET 50)")
def alert_page(spark, sf):
    rows = S.page(T0.stage(_alerts(spark, sf), "alerts"), [F.desc("risk_score"), F.asc("id")], 25, 50)
    return rounded(rows.select("id", "risk_score", "total"), "risk_score")


@query("accounts_with_latest_telemetry", f"""
SELECT a.user_id, a.name, a.email, a.role, a.manager_id, {R("a.risk_score", "risk_score")}, l.active_app AS last_active_app, l.window_title AS last_window_title, l.keystroke_count, c.n AS event_count
FROM accounts a JOIN (SELECT * FROM tele QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC) = 1) l USING (user_id) JOIN (SELECT user_id, count(*) AS n FROM tele GROUP BY 1) c USING (user_id) WHERE a.is_active""")
def accounts_with_latest_telemetry(spark, sf):
    rows, accounts = T0.live_tables(spark, sf)
    out = S.with_latest_telemetry(accounts, rows).select("user_id", "name", "email", "role", "manager_id", "risk_score",
                                                         "last_active_app", "last_window_title", "keystroke_count", "event_count")
    return rounded(out, "risk_score")


_EMP = """SELECT "user" AS employee_id, name, user_key % 3 <> 0 AS monitoring_enabled FROM roster"""
_ACTS = """SELECT event_id AS id, "user" AS employee_id, ts AS timestamp, value / 490 AS risk_score FROM ev"""


def _side_app(spark, sf):
    employees = A.roster(spark, sf).select(F.col("user").alias("employee_id"), "name", (F.col("user_key") % 3 != 0).alias("monitoring_enabled"))
    activities = A.events(spark, sf).select(F.col("event_id").alias("id"), F.col("user").alias("employee_id"), F.col("ts").alias("timestamp"), (F.col("value") / 490).alias("risk_score"))
    return employees, activities


@query("recent_activities", "SELECT id, employee_id, e.name AS employee_name FROM (SELECT * FROM acts ORDER BY timestamp DESC, id DESC LIMIT 20) a LEFT JOIN emp e USING (employee_id)", emp=_EMP, acts=_ACTS)
def recent_activities(spark, sf):
    employees, activities = _side_app(spark, sf)
    return S.recent_activities(activities, employees).select("id", "employee_id", "employee_name")


@query("employee_stats", """
SELECT (SELECT count(*) FROM emp WHERE monitoring_enabled) AS total_employees, count(DISTINCT employee_id) FILTER (WHERE timestamp > m - INTERVAL 5 MINUTE) AS active_now,
  count_if(risk_score > 0.7::DOUBLE) AS high_risk_events, count_if(CAST(timestamp AS DATE) = CAST(m AS DATE)) AS today_activities FROM acts, (SELECT max(timestamp) AS m FROM acts) x""", emp=_EMP, acts=_ACTS)
def employee_stats(spark, sf):
    employees, activities = _side_app(spark, sf)
    return S.employee_stats(employees, activities, rollup.latest(activities, "timestamp"))


@query("report_with_user_details", f'SELECT r."user", {R("r.total_risk_score", "total_risk_score")}, u.name, u.role, u.department FROM report r LEFT JOIN roster u USING ("user")')
def report_with_user_details(spark, sf):
    rows = T0.named_report(spark, sf).select("user", "total_risk_score", "name", "role", "department")
    return rounded(rows, "total_risk_score")


_PART_REPORT = """SELECT r."user", u.name, u.role, u.department, r.total_risk_score FROM report r JOIN roster u USING ("user")"""
_PART_LIVE = """SELECT p."user" AS user_id, p.name, p.role, p.department, a.risk_score, concat(lower(p."user"), '@example.com') AS email, 1 AS event_count FROM people p LEFT JOIN accounts a ON a.user_id = p."user" """


def _two_rosters(spark, sf):
    """The report, and the live accounts of all customers: those without events are in no report."""
    rows = T0.stored_telemetry(spark, sf)
    live = T0.stage(T0.as_accounts(A.people(spark, sf), rows), "accounts").withColumn("event_count", F.lit(1))
    return T0.stage(T0.named_report(spark, sf), "report"), live


@query("merged_roster", f"""
SELECT coalesce(p."user", l.user_id) AS "user", coalesce(p.name, l.name) AS name, coalesce(p.role, l.role, 'Employee') AS role, coalesce(p.department, l.department, 'General') AS department,
  {R("coalesce(p.total_risk_score, l.risk_score, 0)", "score")}, CASE WHEN coalesce(p.total_risk_score, l.risk_score, 0) >= 80 THEN 'Critical' WHEN coalesce(p.total_risk_score, l.risk_score, 0) >= 60 THEN 'High' WHEN coalesce(p.total_risk_score, l.risk_score, 0) >= 40 THEN 'Medium' ELSE 'Low' END AS level,
  CASE WHEN p.total_risk_score IS NOT NULL THEN 'report' ELSE 'live' END AS origin FROM prep p FULL JOIN plive l ON l.user_id = p."user" """, prep=_PART_REPORT, plive=_PART_LIVE)
def merged_roster(spark, sf):
    return rounded(S.merged_roster(*_two_rosters(spark, sf)).drop("email", "event_count"), "score")


@query("live_only_users", """SELECT user_id AS "user" FROM plive WHERE user_id NOT IN (SELECT "user" FROM prep)""", prep=_PART_REPORT, plive=_PART_LIVE)
def live_only_users(spark, sf):
    report, live = _two_rosters(spark, sf)
    return S.live_only(live, report)


@query("sorted_rosters", """
SELECT * FROM (SELECT 'risk-desc' AS sort, "user" FROM scores ORDER BY score DESC, "user" LIMIT 20) UNION ALL SELECT * FROM (SELECT 'risk-asc', "user" FROM scores ORDER BY score, "user" LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'name-asc', "user" FROM scores ORDER BY name, "user" LIMIT 20) UNION ALL SELECT * FROM (SELECT 'id-asc', "user" FROM scores ORDER BY "user" LIMIT 20)""",
       scores='SELECT r."user", u.name, round(r.total_risk_score, 6) AS score FROM report r JOIN roster u USING ("user")')
def sorted_rosters(spark, sf):
    rows = T0.stage(rounded(T0.named_report(spark, sf), "total_risk_score").withColumnRenamed("total_risk_score", "score"), "roster")
    out = None
    for key in S.ROSTER_ORDERS:
        part = S.sorted_roster(rows, key, 20).select(F.lit(key).alias("sort"), "user")
        out = part if out is None else out.unionByName(part)
    return out


@query("users_of_one_role", """SELECT a.id FROM act a WHERE a."user" IN (SELECT "user" FROM roster WHERE role = 'Admin')""")
def users_of_one_role(spark, sf):
    admins = A.roster(spark, sf).filter("role = 'Admin'").select("user")
    return A.activity(spark, sf).join(admins, "user", "left_semi").select("id")


@query("distinct_users_and_roles", """SELECT 'user' AS kind, "user" AS value FROM (SELECT DISTINCT "user" FROM act) UNION ALL SELECT 'role', role FROM (SELECT DISTINCT role FROM roster)""")
def distinct_users_and_roles(spark, sf):
    users = A.activity(spark, sf).select(F.lit("user").alias("kind"), F.col("user").alias("value")).distinct()
    return users.unionByName(A.roster(spark, sf).select(F.lit("role").alias("kind"), F.col("role").alias("value")).distinct())


@query("derived_heatmap", f"""
SELECT c."user", c.hour, {R("c.peak", "peak")}, c.n, coalesce(r.name, c.e_name, c."user") AS name, {R("coalesce(r.total_risk_score, c.peak)", "risk_score")}, r.role
FROM (SELECT "user", hour(timestamp) AS hour, max(risk_score) AS peak, count(*) AS n, max(e_name) AS e_name FROM (
  SELECT user_id AS "user", name AS e_name, timestamp, risk_score FROM live_alerts UNION ALL SELECT "user", NULL, ts, least(100.0::DOUBLE, value / 4) FROM ev) GROUP BY 1, 2) c
LEFT JOIN (SELECT r."user", u.name, u.role, r.total_risk_score FROM report r JOIN roster u USING ("user")) r USING ("user")""")
def derived_heatmap(spark, sf):
    report = T0.named_report(spark, sf)
    events = A.events(spark, sf).select("user", F.col("ts").alias("date"), F.least(F.lit(100.0), F.col("value") / 4).alias("risk_score"))
    rows = S.derived_heatmap(report, _alerts(spark, sf), events).drop("department")
    return rounded(rows, "peak", "risk_score")


_DAYS_EVENTS = "(SELECT count(*) FROM scored) AS total_events, (SELECT count(*) FROM scored WHERE risk_score >= 50) AS high_risk_events"


@query("system_stats", f"""
SELECT count(*) AS total_users, count_if(total_risk_score >= 50) AS high_risk_users, {R("avg(total_risk_score)", "avg_risk_score")}, arg_max("user", total_risk_score) AS top_threat, {_DAYS_EVENTS} FROM report""")
def system_stats(spark, sf):
    days = T0.scored_days(spark, sf)
    return rounded(S.system_stats(rollup.user_report(days), days), "avg_risk_score")


@query("system_stats_live_fallback", f"""
SELECT count(*) AS total_users, count_if(total_risk_score >= 50) AS high_risk_users, {R("avg(total_risk_score)", "avg_risk_score")}, arg_max("user", total_risk_score) AS top_threat, {_DAYS_EVENTS}, 'report' AS data_source FROM report""")
def system_stats_live_fallback(spark, sf):
    rows, accounts = T0.live_tables(spark, sf)
    days = T0.scored_days(spark, sf)
    return rounded(S.system_stats_or_live(rollup.user_report(days), days, accounts, rows), "avg_risk_score")


_INTEGRITY = """
SELECT count(*) AS total, count_if(risk_score < 50) AS in_zone, count_if(risk_score >= 50 AND risk_score < 80) AS anomalous, count_if(risk_score >= 80) AS critical, avg(risk_score) AS avg_risk_score, avg(productivity_score) AS avg_productivity
FROM tele WHERE timestamp >= (SELECT max(timestamp) FROM tele) - INTERVAL 1 HOUR"""


@query("integrity_summary", f"SELECT total, in_zone, anomalous, critical, {R('avg_risk_score')}, {R('avg_productivity')} FROM integ", integ=_INTEGRITY)
def integrity_summary(spark, sf):
    rows = T0.telemetry(spark, sf)
    return rounded(S.integrity_summary(rows, rollup.latest(A.telemetry(spark, sf), "timestamp")), "avg_risk_score", "avg_productivity")


@query("integrity_gauge", """
SELECT *, CASE WHEN critical_percent > 20 THEN 'critical' WHEN anomalous_percent > 30 THEN 'warning' ELSE 'healthy' END AS status FROM (
SELECT CAST(round(in_zone * 100.0::DOUBLE / greatest(1, total)) AS BIGINT) AS in_zone_percent, CAST(round(anomalous * 100.0::DOUBLE / greatest(1, total)) AS BIGINT) AS anomalous_percent, CAST(round(critical * 100.0::DOUBLE / greatest(1, total)) AS BIGINT) AS critical_percent FROM integ)""", integ=_INTEGRITY)
def integrity_gauge(spark, sf):
    rows = T0.telemetry(spark, sf)
    return S.integrity_gauge(S.integrity_summary(rows, rollup.latest(A.telemetry(spark, sf), "timestamp")))


_HEAT_CELLS = """SELECT user_id, hour(timestamp) AS h, avg(risk_score) AS r, count(*) AS n FROM tele WHERE timestamp >= (SELECT max(timestamp) FROM tele) - INTERVAL 7 DAY GROUP BY 1, 2"""
_HEAT = """
SELECT a.user_id, a.role, round(coalesce(a.risk_score, 0), 1) AS risk_score, x.h, round(coalesce(c.r, 0), 1) AS r, coalesce(c.n, 0) AS n
FROM accounts a CROSS JOIN (SELECT unnest(range(24)) AS h) x LEFT JOIN hcells c ON c.user_id = a.user_id AND c.h = x.h WHERE a.is_active AND a.user_id IN (SELECT user_id FROM tele)"""


def _heat_rows(spark, sf):
    rows, accounts = T0.live_tables(spark, sf)
    return S.heatmap(rows, accounts, rollup.latest(A.telemetry(spark, sf), "timestamp"))


@query("risk_heatmap", """
SELECT user_id, role, risk_score, array_to_string(list(printf('%.1f', r) ORDER BY h), ',') AS hours, array_to_string(list(n ORDER BY h), ',') AS event_counts FROM heat GROUP BY ALL""", hcells=_HEAT_CELLS, heat=_HEAT)
def risk_heatmap(spark, sf):
    text = lambda c, f: F.array_join(F.transform(c, f), ",")
    return _heat_rows(spark, sf).select("user_id", "role", "risk_score", text("hours", lambda x: F.format_string("%.1f", x)).alias("hours"),
                                        text("event_counts", lambda x: x.cast("string")).alias("event_counts"))


@query("heatmap_summary", """
SELECT (SELECT arg_min(h, struct_pack(a := -s, b := h)) FROM (SELECT h, round(sum(r), 6) AS s FROM vis GROUP BY 1)) AS peak_hour, CAST(sum(n) AS BIGINT) AS total_events,
  arg_min(user_id, struct_pack(a := -risk_score, b := user_id)) AS top_user, count(DISTINCT user_id) FILTER (WHERE risk_score >= 80) AS critical_users FROM vis""",
       hcells=_HEAT_CELLS, heat=_HEAT, vis="SELECT * FROM heat WHERE role = 'Manager' AND risk_score >= 20")
def heatmap_summary(spark, sf):
    return S.heatmap_summary(T0.stage(_heat_rows(spark, sf), "heatmap"), "Manager", 20.0)


@query("hourly_user_profile", """
SELECT user_id, dayofweek(timestamp) AS day_of_week, hour(timestamp) AS hour, round(avg(risk_score), 8) AS avg_risk, round(avg(mouse_velocity_avg), 8) AS avg_mouse_velocity,
  round(avg(keystroke_flight_avg_ms), 8) AS avg_keystroke_flight_ms, round(avg(productivity_score), 9) AS avg_productivity, count(*) AS event_count
FROM tele WHERE timestamp >= (SELECT max(timestamp) FROM tele) - INTERVAL 7 DAY GROUP BY 1, 2, 3""")
def hourly_user_profile(spark, sf):
    rows = T0.telemetry(spark, sf)
    # two-digit means of two values are rounding ties, so more digits are compared
    return S.hourly_profile(rows, rollup.latest(A.telemetry(spark, sf), "timestamp"), digits=8)


@query("user_profiles", f"""
SELECT a.user_id, a.role, {R("coalesce(a.risk_score, 0)", "risk_score")}, t.n AS event_count, {R("t.a", "avg_risk_score")}, {R("t.m", "max_risk_score")}, rank() OVER (ORDER BY coalesce(a.risk_score, 0) DESC) AS rank
FROM accounts a JOIN (SELECT user_id, count(*) AS n, avg(risk_score) AS a, max(risk_score) AS m FROM tele GROUP BY 1) t USING (user_id) WHERE a.is_active""")
def user_profiles(spark, sf):
    rows, accounts = T0.live_tables(spark, sf)
    out = S.user_profiles(accounts, rows).drop("department", "risk_level")
    return rounded(out, "risk_score", "avg_risk_score", "max_risk_score")


@query("user_rank_positions", """SELECT user_id, row_number() OVER (ORDER BY round(coalesce(risk_score, 0), 6) DESC, md5(user_id)) AS position FROM accounts""")
def user_rank_positions(spark, sf):
    _, accounts = T0.live_tables(spark, sf)
    scores = accounts.select("user_id", F.round(F.coalesce("risk_score", F.lit(0.0)), 6).alias("score"))
    return total_rank(scores, "score", "user_id").select("user_id", "position")


@query("recent_risk_profiles", f"""
SELECT a.user_id, {R("coalesce(a.risk_score, 0)", "current_risk")}, {R("t.a", "avg_risk")}, {R("t.p", "avg_productivity")}, {R("t.m", "max_risk")}, t.n AS telemetry_count, 'active' AS status
FROM accounts a JOIN (SELECT user_id, avg(risk_score) AS a, avg(productivity_score) AS p, max(risk_score) AS m, count(*) AS n FROM (SELECT * FROM tele QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC) <= 100) GROUP BY 1) t USING (user_id)""")
def recent_risk_profiles(spark, sf):
    rows, accounts = T0.live_tables(spark, sf)
    return rounded(S.recent_profile(accounts, rows, 100), "current_risk", "avg_risk", "avg_productivity", "max_risk")


@query("drift_status", """
SELECT count(*) AS users_total, count_if(is_drift) AS users_in_drift, round(max(deviation_sigma), 2) AS max_deviation_sigma, count_if(is_drift) > 0 AS drift_detected, round(count_if(is_drift)::DOUBLE / count(*), 4) AS drift_ratio,
  (SELECT array_to_string(list("user" ORDER BY deviation_sigma DESC, "user"), ',') FROM (SELECT * FROM report WHERE is_drift ORDER BY deviation_sigma DESC, "user" LIMIT 10)) AS top_users,
  concat(count_if(is_drift), ' of ', count(*), ' users drift from their baseline. Look at the strongest ones first.') AS recommendation FROM report""")
def drift_status(spark, sf):
    rows = S.drift_status(T0.stage(T0.report(spark, sf), "report"))
    users = F.array_join(F.transform("top_drifting_users", lambda x: x["user"]), ",")
    return rows.withColumn("top_users", users).drop("top_drifting_users")


@query("risk_band_counts", "SELECT band, count(*) AS users FROM (SELECT CASE WHEN total_risk_score >= 80 THEN 'critical' WHEN total_risk_score >= 60 THEN 'high' WHEN total_risk_score >= 40 THEN 'medium' ELSE 'low' END AS band FROM report) GROUP BY 1")
def risk_band_counts(spark, sf):
    return S.band_counts(T0.report(spark, sf))


@query("user_kpis", f"SELECT count(*) AS total, count_if(total_risk_score >= 80) AS critical, count_if(total_risk_score >= 60 AND total_risk_score < 80) AS high, {R('avg(total_risk_score)', 'avg_risk')} FROM report")
def user_kpis(spark, sf):
    return rounded(S.user_kpis(T0.report(spark, sf)), "avg_risk")


@query("session_state_counts", """
SELECT CASE WHEN m < 2 THEN 'active' WHEN m < 15 THEN 'idle' ELSE 'offline' END AS state, count(*) AS users
FROM (SELECT (epoch_us((SELECT max(ts) FROM ev)) - epoch_us(max(ts))) / 60000000.0::DOUBLE AS m FROM ev GROUP BY "user") GROUP BY 1""")
def session_state_counts(spark, sf):
    ev = A.events(spark, sf)
    seen = ev.groupBy("user").agg(F.max("ts").alias("last_seen"))
    return S.session_counts(seen, rollup.latest(ev, "ts"))


@query("severity_counts", "SELECT severity, count(*) AS alerts FROM live_alerts GROUP BY 1")
def severity_counts(spark, sf):
    return S.severity_counts(_alerts(spark, sf))


@query("tactics_of_users", "SELECT user_id, mitre_tactic, arg_min(mitre_technique, struct_pack(a := -risk_score, b := id)) AS mitre_technique FROM live_alerts WHERE mitre_tactic IS NOT NULL GROUP BY 1, 2")
def tactics_of_users(spark, sf):
    return S.tactics_of_users(_alerts(spark, sf))


@query("telemetry_timeline", """
SELECT id, user_id, concat(active_app, ' — ', window_title) AS activity, round(anomaly_score, 4) AS anomaly_score, round(risk_score, 2) AS risk_score, risk_score >= 50 AS is_anomaly, round(mouse_velocity_avg, 1) AS velocity, round(productivity_score, 3) AS productivity FROM tele""")
def telemetry_timeline(spark, sf):
    rows = S.timeline_rows(T0.telemetry(spark, sf))
    return rows.select("id", "user_id", "activity", "anomaly_score", "risk_score", "is_anomaly", F.col("details.mouse_velocity").alias("velocity"), "details.productivity")


@query("activity_feed", f"SELECT id, user_id, {R('keystroke_flight_avg_ms', 'flight_time')}, {R('productivity_score * 100', 'productivity')}, {R('risk_score')}, CASE WHEN productivity_score > 0.7::DOUBLE THEN 'Productive' ELSE 'Neutral' END AS category FROM tele")
def activity_feed(spark, sf):
    return rounded(S.activity_feed(T0.telemetry(spark, sf)), "flight_time", "productivity", "risk_score")


@query("riskiest_users", "SELECT user_id, name, role, round(coalesce(risk_score, 0), 2) AS total_risk_score, CASE WHEN risk_score >= 80 THEN 'Critical' WHEN risk_score >= 60 THEN 'High' WHEN risk_score >= 40 THEN 'Medium' ELSE 'Low' END AS risk_level FROM (SELECT * FROM accounts WHERE is_active ORDER BY accounts.risk_score DESC, user_id LIMIT 50)")
def riskiest_users(spark, sf):
    _, accounts = T0.live_tables(spark, sf)
    return S.risk_ranked(accounts).drop("department")


@query("riskiest_events", f'SELECT "user", {D("day")}, {R("risk_score")}, mitre_tactic FROM (SELECT * FROM scored WHERE risk_score >= 20 ORDER BY round(scored.risk_score, 6) DESC, "user", day LIMIT 100)')
def riskiest_events(spark, sf):
    rows = T0.scored(spark, sf).select("user", "day", "risk_score", "mitre_tactic").filter("risk_score >= 20")
    return text_time(rounded(rows, "risk_score").orderBy(F.desc("risk_score"), "user", "day").limit(100), "day")


@query("last_thirty_days", f'SELECT "user", {D("day")}, file_count FROM (SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY daily.day DESC) <= 30)')
def last_thirty_days(spark, sf):
    rows = S.last_days(T0.daily(spark, sf), 30).select("user", "day", "file_count")
    return text_time(rows, "day")


@query("dashboard_bundle", f"""
SELECT 'stats' AS section, 'users' AS item, {R("count(*)", "value")} FROM report UNION ALL SELECT 'stats', 'average', {R("avg(total_risk_score)", "v")} FROM report
UNION ALL SELECT 'top_users', "user", {R("total_risk_score", "v")} FROM (SELECT * FROM report ORDER BY round(report.total_risk_score, 6) DESC, "user" LIMIT 5)
UNION ALL SELECT 'alerts', alert_id, {R("risk_score", "v")} FROM (SELECT * FROM live_alerts ORDER BY round(live_alerts.risk_score, 6) DESC, id LIMIT 5)
UNION ALL SELECT 'models', model, {R("n_sequences", "v")} FROM metadata""")
def dashboard_bundle(spark, sf):
    from conductrisk.operators import sequences
    errors = T0.errors(spark, sf)
    report = T0.stage(rollup.user_report(T0.stage(T0.scored_of(errors).select(T0.KEEP), "scored")), "report")
    alerts = _alerts(spark, sf)
    part = lambda df, section, item, value: df.select(F.lit(section).alias("section"), F.col(item).alias("item"), F.col(value).cast("double").alias("value"))
    stats = S.user_kpis(report).select(F.explode(F.array(
        F.struct(F.lit("users").alias("item"), F.col("total").cast("double").alias("value")),
        F.struct(F.lit("average").alias("item"), F.col("avg_risk").alias("value")))).alias("s")).select("s.*")
    top = report.orderBy(F.desc(F.round("total_risk_score", 6)), "user").limit(5)
    worst = alerts.orderBy(F.desc(F.round("risk_score", 6)), "id").limit(5)
    models = sequences.model_metadata(errors)
    out = part(stats, "stats", "item", "value").unionByName(part(top, "top_users", "user", "total_risk_score"))
    out = out.unionByName(part(worst, "alerts", "alert_id", "risk_score")).unionByName(part(models, "models", "model", "n_sequences"))
    return rounded(out, "value")

"""Reads for dashboards: rosters, alerts, timelines, heat maps, rankings, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conductrisk.functions import riskrules as R
from conductrisk.functions.common import band, ratio, session_state
from conductrisk.operators.ordered import total_rank

HIGH_RISK = 50.0


def active(accounts: DataFrame) -> DataFrame:
    return accounts.filter(F.coalesce("is_active", F.lit(True)))


def within(df: DataFrame, as_of: Column, interval: str) -> DataFrame:
    return df.filter(F.col("timestamp") >= as_of - F.expr(f"INTERVAL {interval}"))


def live_alerts(scored: DataFrame, accounts: DataFrame, floor: float = HIGH_RISK) -> DataFrame:
    """Telemetry at or above the floor, joined to accounts, with severity, id and text."""
    risky = scored.filter(F.col("risk_score") >= floor).drop("role")
    who = accounts.select("user_id", "name", "role", "department")
    return risky.join(who, "user_id").select(
        "id", R.alert_id(F.col("id")).alias("alert_id"), "user_id",
        F.coalesce("name", "user_id").alias("name"),
        F.coalesce("role", F.lit("Employee")).alias("role"),
        F.coalesce("department", F.lit("General")).alias("department"),
        R.live_severity(F.col("risk_score")).alias("severity"), "risk_score", "timestamp",
        R.alert_text(F.col("active_app"), F.col("window_title")).alias("activity"),
        "mitre_tactic", "mitre_technique", F.lit("open").alias("status"),
    )


def filter_alerts(alerts: DataFrame, severity: str | None = None, user: str | None = None,
                  status: str | None = None) -> DataFrame:
    if severity:
        alerts = alerts.filter(F.lower("severity") == severity.lower())
    if user:
        alerts = alerts.filter(F.col("user_id") == user)
    if status:
        alerts = alerts.filter(F.col("status") == status.lower())
    return alerts


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page with the total on every row. The order must end in a unique column."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    return df.filter(F.lower(F.concat_ws(" ", *columns)).contains(text.strip().lower()))


def with_latest_telemetry(accounts: DataFrame, scored: DataFrame) -> DataFrame:
    """Accounts with the newest application, window and counts, and the number of events."""
    last = F.max_by(
        F.struct("active_app", "window_title", "keystroke_count", "mouse_click_count"), F.struct("timestamp", "id")
    )
    newest = scored.groupBy("user_id").agg(last.alias("l"), F.count("*").alias("event_count"))
    return active(accounts).join(newest, "user_id", "left").select(
        *accounts.columns, F.col("l.active_app").alias("last_active_app"),
        F.col("l.window_title").alias("last_window_title"), "l.keystroke_count", "l.mouse_click_count",
        F.coalesce("event_count", F.lit(0)).alias("event_count"),
    )


def recent_activities(activities: DataFrame, employees: DataFrame, limit: int = 20) -> DataFrame:
    newest = activities.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)
    return newest.join(employees.select("employee_id", F.col("name").alias("employee_name")), "employee_id", "left")


def merged_roster(report: DataFrame, live: DataFrame) -> DataFrame:
    """Report users first, plus users only seen live; report, live, default in that order."""
    p = report.select("user", F.col("name").alias("p_name"), F.col("role").alias("p_role"),
                      F.col("department").alias("p_department"), F.col("total_risk_score").alias("p_score"))
    l = live.select(F.col("user_id").alias("user"), F.col("name").alias("l_name"), F.col("role").alias("l_role"),
                    F.col("department").alias("l_department"), F.col("risk_score").alias("l_score"), "email", "event_count")
    score = F.coalesce("p_score", "l_score", F.lit(0.0))
    return p.join(l, "user", "full_outer").select(
        "user", F.coalesce("p_name", "l_name").alias("name"),
        F.coalesce("p_role", "l_role", F.lit("Employee")).alias("role"),
        F.coalesce("p_department", "l_department", F.lit("General")).alias("department"),
        score.alias("score"), band(score).alias("level"), "email", "event_count",
        F.when(F.col("p_score").isNotNull(), "report").otherwise("live").alias("origin"),
    )


def live_only(live: DataFrame, report: DataFrame) -> DataFrame:
    return live.select(F.col("user_id").alias("user")).join(report.select("user"), "user", "left_anti")


def system_stats(report: DataFrame, events: DataFrame) -> DataFrame:
    """One row of headline numbers."""
    users = report.agg(
        F.count("*").alias("total_users"), F.count_if(F.col("total_risk_score") >= HIGH_RISK).alias("high_risk_users"),
        F.avg("total_risk_score").alias("avg_risk_score"),
        F.max_by("user", F.struct("total_risk_score", "user")).alias("top_threat"),
    )
    totals = events.agg(
        F.struct(F.count("*").alias("n"), F.count_if(F.col("risk_score") >= HIGH_RISK).alias("high")).alias("s")
    ).scalar()
    return users.withColumn("__e", totals).select(
        "total_users", "high_risk_users", "avg_risk_score", F.coalesce("top_threat", F.lit("None")).alias("top_threat"),
        F.col("__e.n").alias("total_events"), F.col("__e.high").alias("high_risk_events"),
    )


def system_stats_or_live(report: DataFrame, events: DataFrame, accounts: DataFrame, live: DataFrame) -> DataFrame:
    """The report's numbers; where the report is empty, those of the live tables."""
    from_report = system_stats(report, events).withColumn("data_source", F.lit("report"))
    people = active(accounts).select(F.col("user_id").alias("user"), F.col("risk_score").alias("total_risk_score"))
    from_live = system_stats(people, live).withColumn("data_source", F.lit("live"))
    return from_report.unionByName(from_live).agg(
        F.min_by(F.struct("*"), F.when(F.col("total_users") > 0, F.when(F.col("data_source") == "report", 0).otherwise(1)).otherwise(2)).alias("s")
    ).select("s.*")


def integrity_summary(scored: DataFrame, as_of: Column) -> DataFrame:
    recent = within(scored, as_of, "1 HOUR")
    score = F.col("risk_score")
    return recent.agg(
        F.count("*").alias("total"), F.count_if(score < 50).alias("in_zone"),
        F.count_if((score >= 50) & (score < 80)).alias("anomalous"), F.count_if(score >= 80).alias("critical"),
        F.avg("risk_score").alias("avg_risk_score"), F.avg("productivity_score").alias("avg_productivity"),
    )


def integrity_gauge(summary: DataFrame) -> DataFrame:
    total = F.greatest(F.lit(1), F.col("in_zone") + F.col("anomalous") + F.col("critical"))
    share = lambda c: F.round(F.col(c) / total * 100).cast("long")
    shares = summary.select(*[share(c).alias(f"{c}_percent") for c in ("in_zone", "anomalous", "critical")])
    return shares.withColumn("status", F.when(F.col("critical_percent") > 20, "critical").when(
        F.col("anomalous_percent") > 30, "warning").otherwise("healthy"))


def heatmap(scored: DataFrame, accounts: DataFrame, as_of: Column) -> DataFrame:
    """24 hourly mean risks and counts per active user with telemetry, for the last 7 days."""
    hourly = within(scored, as_of, "7 DAYS").groupBy("user_id", F.hour("timestamp").alias("hour")).agg(
        F.avg("risk_score").alias("r"), F.count("*").alias("n"))
    slots = hourly.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("hour", F.struct("r", "n")))).alias("m"))
    hours = F.sequence(F.lit(0), F.lit(23))
    seen = active(accounts).join(scored.select("user_id").distinct(), "user_id", "left_semi")
    at = lambda h, f, d: F.coalesce(F.try_element_at("m", h)[f], F.lit(d))
    return seen.join(slots, "user_id", "left").select(
        "user_id", F.coalesce("name", "user_id").alias("name"), F.coalesce("role", F.lit("Employee")).alias("role"),
        F.coalesce("department", F.lit("General")).alias("department"),
        F.round(F.coalesce("risk_score", F.lit(0.0)), 1).alias("risk_score"),
        F.transform(hours, lambda h: F.round(at(h, "r", 0.0), 1)).alias("hours"),
        F.transform(hours, lambda h: at(h, "n", 0)).alias("event_counts"),
    )


def heatmap_summary(rows: DataFrame, role: str | None = None, min_score: float = 0.0) -> DataFrame:
    """Peak hour (summed risk), total events, top user and critical users of the visible rows."""
    visible = rows.filter(F.col("risk_score") >= min_score)
    if role:
        visible = visible.filter(F.col("role") == role)
    per_hour = visible.select(F.posexplode("hours").alias("hour", "r")).groupBy("hour").agg(F.sum("r").alias("r"))
    peak = per_hour.agg(F.min_by("hour", F.struct(-F.round("r", 6), F.col("hour"))).alias("h")).scalar()
    counted = F.aggregate("event_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return visible.agg(
        F.sum(counted).alias("total_events"),
        F.min_by("user_id", F.struct(-F.col("risk_score"), F.col("user_id"))).alias("top_user"),
        F.count_if(F.col("risk_score") >= 80).alias("critical_users"),
    ).withColumn("peak_hour", peak)


def derived_heatmap(report: DataFrame, alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Peak risk and count per user and hour from alerts and events, names from the report."""
    both = alerts.select(F.col("user_id").alias("user"), F.col("name").alias("e_name"), "timestamp", "risk_score").unionByName(
        events.select("user", F.lit(None).cast("string").alias("e_name"), F.col("date").alias("timestamp"), "risk_score"))
    cells = both.groupBy("user", F.hour("timestamp").alias("hour")).agg(
        F.max("risk_score").alias("peak"), F.count("*").alias("n"), F.max("e_name").alias("e_name"))
    known = report.select("user", "name", "role", "department", "total_risk_score")
    return cells.join(known, "user", "left").select(
        "user", "hour", "peak", "n", F.coalesce("name", "e_name", "user").alias("name"),
        F.coalesce("total_risk_score", "peak").alias("risk_score"), "role", "department",
    )


def hourly_profile(scored: DataFrame, as_of: Column, digits: int = 2) -> DataFrame:
    """Hour by weekday (Sunday 0) of each user, last 7 days: four means and the count."""
    return within(scored, as_of, "7 DAYS").groupBy(
        "user_id", (F.dayofweek("timestamp") - 1).alias("day_of_week"), F.hour("timestamp").alias("hour")
    ).agg(
        F.round(F.avg("risk_score"), digits).alias("avg_risk"),
        F.round(F.avg("mouse_velocity_avg"), digits).alias("avg_mouse_velocity"),
        F.round(F.avg("keystroke_flight_avg_ms"), digits).alias("avg_keystroke_flight_ms"),
        F.round(F.avg("productivity_score"), digits + 1).alias("avg_productivity"),
        F.count("*").alias("event_count"),
    )


def user_profiles(accounts: DataFrame, scored: DataFrame) -> DataFrame:
    """Event count, mean and maximum risk and the rank among active users."""
    per_user = scored.groupBy("user_id").agg(
        F.count("*").alias("event_count"), F.avg("risk_score").alias("avg_risk_score"),
        F.max("risk_score").alias("max_risk_score"))
    people = active(accounts).withColumn("risk_score", F.coalesce("risk_score", F.lit(0.0)))
    ranked = total_rank(people.select("user_id", "role", "department", "risk_score"), "risk_score", "user_id")
    return ranked.join(per_user, "user_id", "left").select(
        "user_id", "role", "department", "risk_score", band("risk_score").alias("risk_level"),
        F.coalesce("event_count", F.lit(0)).alias("event_count"),
        F.coalesce("avg_risk_score", F.lit(0.0)).alias("avg_risk_score"),
        F.coalesce("max_risk_score", F.lit(0.0)).alias("max_risk_score"), "rank",
    )


def recent_profile(accounts: DataFrame, scored: DataFrame, rows: int = 100) -> DataFrame:
    """Mean and maximum over a user's newest rows.

    Spark keeps only the newest `rows` per user before the shuffle, so a busy user is no problem.
    """
    w = Window.partitionBy("user_id").orderBy(F.desc("timestamp"), F.desc("id"))
    stats = scored.select("user_id", "timestamp", "id", "risk_score", "productivity_score").withColumn(
        "rn", F.row_number().over(w)).filter(F.col("rn") <= rows).groupBy("user_id").agg(
        F.avg("risk_score").alias("avg_risk"), F.avg("productivity_score").alias("avg_productivity"),
        F.max("risk_score").alias("max_risk"), F.count("*").alias("telemetry_count"))
    return accounts.join(stats, "user_id", "left").select(
        "user_id", F.coalesce("risk_score", F.lit(0.0)).alias("current_risk"),
        F.coalesce("avg_risk", F.lit(0.0)).alias("avg_risk"),
        F.coalesce("avg_productivity", F.lit(1.0)).alias("avg_productivity"),
        F.coalesce("max_risk", F.lit(0.0)).alias("max_risk"),
        F.coalesce("telemetry_count", F.lit(0)).alias("telemetry_count"),
        F.when(F.col("last_seen").isNotNull(), "active").otherwise("inactive").alias("status"),
    )


def drift_status(report: DataFrame, top: int = 10) -> DataFrame:
    """Totals and the strongest drifters as one row."""
    entry = F.struct("user", F.round("total_risk_score", 2).alias("total_risk_score"),
                     F.round("deviation_sigma", 2).alias("deviation_sigma"), F.col("drift_explanation").alias("explanation"))
    strongest = report.filter("is_drift").orderBy(F.desc("deviation_sigma"), "user").limit(top)
    listed = strongest.agg(F.sort_array(F.collect_list(
        F.struct((-F.col("deviation_sigma")).alias("s"), F.col("user").alias("u"), entry.alias("e")))).alias("l"))
    users = listed.select(F.transform("l", lambda x: x["e"])).scalar()
    totals = report.agg(
        F.count("*").alias("users_total"), F.count_if("is_drift").alias("users_in_drift"),
        F.round(F.max("deviation_sigma"), 2).alias("max_deviation_sigma"))
    n, d = F.col("users_total"), F.col("users_in_drift")
    return totals.withColumns({
        "drift_detected": d > 0, "drift_ratio": F.round(ratio(d, n), 4),
        "top_drifting_users": users,
        "recommendation": F.when(d > 0, F.concat(
            d, F.lit(" of "), n, F.lit(" users drift from their baseline. Look at the strongest ones first.")
        )).otherwise("No user drifts from the baseline."),
    })


def employee_stats(employees: DataFrame, activities: DataFrame, as_of: Column) -> DataFrame:
    """Monitored employees, active in five minutes, risky activities, today's activities."""
    monitored = employees.agg(F.count_if("monitoring_enabled").alias("n")).scalar()
    recent = F.col("timestamp") > as_of - F.expr("INTERVAL 5 MINUTES")
    return activities.agg(
        F.count_distinct(F.when(recent, F.col("employee_id"))).alias("active_now"),
        F.count_if(F.col("risk_score") > 0.7).alias("high_risk_events"),
        F.count_if(F.to_date("timestamp") == F.to_date(as_of)).alias("today_activities"),
    ).withColumn("total_employees", monitored)


def band_counts(report: DataFrame) -> DataFrame:
    return report.groupBy(F.lower(band("total_risk_score")).alias("band")).agg(F.count("*").alias("users"))


def user_kpis(report: DataFrame) -> DataFrame:
    level = band("total_risk_score")
    return report.agg(
        F.count("*").alias("total"), F.count_if(level == "Critical").alias("critical"),
        F.count_if(level == "High").alias("high"), F.avg("total_risk_score").alias("avg_risk"))


def session_counts(accounts: DataFrame, as_of: Column) -> DataFrame:
    return accounts.groupBy(session_state(F.col("last_seen"), as_of).alias("state")).agg(F.count("*").alias("users"))


def severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count("*").alias("alerts"))


def tactics_of_users(alerts: DataFrame) -> DataFrame:
    """Distinct tactics per user with the technique of the highest alert."""
    best = F.min_by("mitre_technique", F.struct(-F.col("risk_score"), F.col("id")))
    return alerts.filter("mitre_tactic is not null").groupBy("user_id", "mitre_tactic").agg(best.alias("mitre_technique"))


def timeline_rows(scored: DataFrame) -> DataFrame:
    """Presentation of telemetry as a timeline with an anomaly flag and nested details."""
    window = F.coalesce("window_title", F.lit(""))
    return scored.select(
        "id", "user_id", "timestamp", F.lit("Telemetry").alias("event_type"),
        F.when(window == "", F.col("active_app")).otherwise(F.concat_ws(" — ", "active_app", window)).alias("activity"),
        F.round("anomaly_score", 4).alias("anomaly_score"), F.round("risk_score", 2).alias("risk_score"),
        (F.col("risk_score") >= HIGH_RISK).alias("is_anomaly"),
        F.struct(
            F.round("mouse_velocity_avg", 1).alias("mouse_velocity"),
            F.round("keystroke_flight_avg_ms", 1).alias("keystroke_flight_ms"),
            F.round("productivity_score", 3).alias("productivity"),
        ).alias("details"),
    )


def activity_feed(scored: DataFrame) -> DataFrame:
    """Scatter and feed columns: flight time, productivity, category."""
    return scored.select(
        "id", "user_id", F.col("keystroke_flight_avg_ms").alias("flight_time"),
        (F.col("productivity_score") * 100).alias("productivity"), "risk_score",
        F.when(F.col("productivity_score") > 0.7, "Productive").otherwise("Neutral").alias("category"),
    )


def risk_ranked(accounts: DataFrame, descending: bool = True, limit: int = 50) -> DataFrame:
    score = F.coalesce("risk_score", F.lit(0.0))
    order = F.desc(score) if descending else F.asc(score)
    return active(accounts).orderBy(order, "user_id").limit(limit).select(
        "user_id", "name", "role", "department", F.round(score, 2).alias("total_risk_score"), band(score).alias("risk_level"))


ROSTER_ORDERS = {
    "risk-desc": lambda: [F.desc("score"), F.asc("user")],
    "risk-asc": lambda: [F.asc("score"), F.asc("user")],
    "name-asc": lambda: [F.asc(F.coalesce("name", "user")), F.asc("user")],
    "id-asc": lambda: [F.asc("user")],
}


def sorted_roster(roster: DataFrame, key: str, limit: int) -> DataFrame:
    return roster.orderBy(*ROSTER_ORDERS[key]()).limit(limit)


def last_days(daily: DataFrame, days: int = 30) -> DataFrame:
    """The newest days of each user (daily rows, so a user's series is short)."""
    back = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("day")))
    return daily.withColumn("back", back).filter(F.col("back") <= days).drop("back")

"""Live telemetry: payloads, baselines, scoring, account updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conductrisk import schemas
from conductrisk.functions import integrity as I
from conductrisk.functions.common import clamp

BASELINE_DAYS = 7
#: Length of the slices in which rows look for the last refresh.
SLICE_SECONDS = 600
MEASURES = {
    "mv_avg": "mouse_velocity_avg", "mv_std": "mouse_velocity_std",
    "kf_avg": "keystroke_flight_avg_ms", "kf_std": "keystroke_flight_std_ms",
    "prod_avg": "productivity_score",
}


def flatten_payload(raw: DataFrame, column: str = "payload") -> DataFrame:
    """JSON text to a flat telemetry row; missing parts take defaults."""
    p = raw.withColumn("p", F.from_json(column, schemas.TELEMETRY_PAYLOAD))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    text = lambda c, d="": F.coalesce(F.col(c), F.lit(d))
    keep = [c for c in raw.columns if c != column]
    return p.select(
        *keep,
        F.to_timestamp("p.timestamp").alias("timestamp"),
        F.col("p.user_id").alias("user_id"), F.col("p.session_id").alias("session_id"),
        zero("p.mouse.velocity_avg").alias("mouse_velocity_avg"),
        zero("p.mouse.velocity_std").alias("mouse_velocity_std"),
        count("p.mouse.click_count").alias("mouse_click_count"),
        count("p.mouse.positions_count").alias("mouse_positions_count"),
        zero("p.keyboard.flight_time_avg_ms").alias("keystroke_flight_avg_ms"),
        zero("p.keyboard.flight_time_std_ms").alias("keystroke_flight_std_ms"),
        count("p.keyboard.key_press_count").alias("keystroke_count"),
        text("p.active_window.app_name", "unknown").alias("active_app"),
        text("p.active_window.window_title").alias("window_title"),
        text("p.active_window.pid").alias("process_id"),
    )


def with_user_role(rows: DataFrame, roster: DataFrame) -> DataFrame:
    known = roster.select(F.col("user").alias("user_id"), "role")
    return rows.join(known, "user_id", "left").withColumn("role", F.coalesce("role", F.lit("Employee")))


def with_productivity(rows: DataFrame) -> DataFrame:
    fit = I.productivity(F.col("active_app"), F.col("role"), F.col("__low"))
    return rows.withColumn("__low", F.lower("active_app")).withColumn("__p", fit).withColumns({
        "productivity_score": F.col("__p.score"), "productivity_category": F.col("__p.category"),
        "productivity_text": F.col("__p.text"),
    }).drop("__p", "__low")


def user_baselines(rows: DataFrame, as_of: Column, days: int = BASELINE_DAYS) -> DataFrame:
    """Mean of five measures over the days before `as_of`, per user."""
    recent = rows.filter(F.col("timestamp") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    return recent.groupBy("user_id").agg(*[F.avg(c).alias(n) for n, c in MEASURES.items()])


def with_baseline(rows: DataFrame, baselines: DataFrame) -> DataFrame:
    marked = baselines.withColumn("has_baseline", F.lit(True))
    return rows.join(marked, "user_id", "left").withColumn(
        "has_baseline", F.coalesce("has_baseline", F.lit(False))
    )


def score(rows: DataFrame) -> DataFrame:
    """Score rows that carry role, productivity and baseline columns."""
    base = {n: F.col(n) for n in ("mv_avg", "mv_std", "kf_avg", "kf_std")}
    app, role, ts = F.col("active_app"), F.col("role"), F.col("timestamp")
    velocity, flight, known = F.col("mouse_velocity_avg"), F.col("keystroke_flight_avg_ms"), F.col("has_baseline")
    hour, weekend = I.clock(ts)
    # read by many conditions, so columns of their own
    rows = rows.withColumns({"__low": F.lower(app), "__hour": hour, "__weekend": weekend})
    low, at = F.col("__low"), (F.col("__hour"), F.col("__weekend"))
    parts = I.live_components(app, role, velocity, flight, base, known, ts, low, at)
    rows = rows.withColumns({
        "__d": I.deviation(velocity, flight, base, known),
        **{f"{n}_component": c for n, c in parts.items()},
    })
    stored = {n: F.col(f"{n}_component") for n in parts}
    rows = rows.withColumns({
        "deviation_score": F.col("__d.score"), "sigma_level": F.col("__d.sigma"), "deviation_text": F.col("__d.text"),
        "time_multiplier": I.time_multiplier(ts, at),
        "live_risk": I.live_risk(stored, role, ts, at),
        "live_factors": I.live_factors(stored),
    })
    rows = rows.withColumn("risk_multiplier", I.integrity_multiplier(F.col("productivity_score"), F.col("sigma_level"), ts, at))
    rows = rows.withColumn("raw_anomaly", F.col("deviation_score") * F.col("risk_multiplier"))
    rows = rows.withColumn("risk_score", clamp(F.greatest(F.col("raw_anomaly") * 100, F.col("live_risk")), 0, 100))
    return rows.withColumns({
        "anomaly_score": F.col("risk_score") / 100,
        "__t": I.live_tactic(app, F.col("risk_score"), at[0], low),
    }).withColumns({
        "mitre_tactic": F.col("__t.tactic"), "mitre_technique": F.col("__t.technique"),
    }).drop("__d", "__t", "__low", "__hour", "__weekend")


def with_baseline_as_of(rows: DataFrame, fresh: DataFrame | None = None, newest: DataFrame | None = None) -> DataFrame:
    """The user's newest baseline from before each row; baselines are refreshed at each tenth row of the table.

    No row sees its own refresh or a later one. Work is cut at slices of SLICE_SECONDS: within a slice of a user the last
    refresh before the row counts, else the last one of an earlier slice. A stream passes the refreshes of its batch (`fresh`)
    and the last ones of the batches before (`newest`: user_id, last).
    """
    fresh = refreshed_baselines(rows) if fresh is None else fresh
    marked = rows.join(fresh.select("id", F.struct(*MEASURES).alias("__b")), "id", "left").withColumn(
        "__slice", F.floor(F.unix_seconds("timestamp") / SLICE_SECONDS))
    refreshed = F.max(F.when(F.col("__b").isNotNull(), F.struct("timestamp", "id", "__b")))
    earlier = Window.partitionBy("user_id").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    opening = marked.groupBy("user_id", "__slice").agg(refreshed.alias("__l")).select(
        "user_id", "__slice", F.last("__l", ignorenulls=True).over(earlier).alias("__l"))
    if newest is not None:
        opening = opening.join(newest.select("user_id", "last"), "user_id", "left").select(
            "user_id", "__slice", F.coalesce("__l", "last").alias("__l"))
    within = Window.partitionBy("user_id", "__slice").orderBy("timestamp", "id").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce("__w", "__l.__b")
    return (
        marked.withColumn("__w", F.last("__b", ignorenulls=True).over(within)).join(opening, ["user_id", "__slice"])
        .withColumns({"has_baseline": base.isNotNull(), **{n: base[n] for n in MEASURES}})
        .drop("__b", "__w", "__l", "__slice")
    )


def last_refreshes(rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """user_id and `last` (timestamp, id, baseline) of each user's newest refresh."""
    at = rows.select("id", "user_id", "timestamp").join(fresh.select("id", F.struct(*MEASURES).alias("__b")), "id")
    return at.groupBy("user_id").agg(F.max(F.struct("timestamp", "id", "__b")).alias("last"))


def score_telemetry(rows: DataFrame, roster: DataFrame) -> DataFrame:
    """Role, productivity, own baseline as of the row, and live risk of every telemetry row."""
    return score(with_baseline_as_of(with_productivity(with_user_role(rows, roster))))


def latest_state(scored: DataFrame) -> DataFrame:
    """Newest risk, productivity and time per user; ties go to the higher row id."""
    newest = F.max_by(F.struct("risk_score", "productivity_score"), F.struct("timestamp", "id"))
    return scored.groupBy("user_id").agg(newest.alias("s"), F.max("timestamp").alias("last_seen")).select(
        "user_id", "s.risk_score", "s.productivity_score", "last_seen"
    )


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert or replace: new rows win."""
    return new.unionByName(old.join(new.select(key), key, "left_anti").select(new.columns))


def insert_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert or ignore: old rows win."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(old.columns))


def apply_changes(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Partial update: a null in the change set keeps the old value."""
    names = [c for c in changes.columns if c != key]
    marked = changes.select(key, *[F.col(c).alias(f"__{c}") for c in names])
    return old.join(marked, key, "left").select(
        *[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in old.columns]
    )


def hourly_aggregate(scored: DataFrame) -> DataFrame:
    return scored.groupBy("user_id", F.date_trunc("hour", "timestamp").alias("hour_start")).agg(
        F.avg("mouse_velocity_avg").alias("avg_mouse_velocity"),
        F.avg("keystroke_flight_avg_ms").alias("avg_keystroke_flight"),
        F.avg("risk_score").alias("avg_risk_score"),
        F.avg("productivity_score").alias("avg_productivity"),
        F.count("*").alias("event_count"),
    )


def sums_per_second(rows: DataFrame, every: int = 10) -> DataFrame:
    """user_id, __sec, __c, the sums of the five measures, and __p: the rows that refresh the baseline."""
    return rows.groupBy("user_id", F.unix_seconds("timestamp").alias("__sec")).agg(
        F.count("*").alias("__c"), *[F.sum(c).alias(n) for n, c in MEASURES.items()],
        F.count_if(F.col("id") % every == 0).alias("__p"))


def refreshed_baselines(rows: DataFrame, every: int = 10, days: int = BASELINE_DAYS, history: DataFrame | None = None,
                        sums: DataFrame | None = None) -> DataFrame:
    """The user's trailing mean at each tenth row of the table.

    Rows become running sums per (user, second): they enter at their own second and leave once
    the window has passed, so no task holds more than one day of one user. They are dealt by user and day once, and only seconds
    with a refresh go on from there. `sums` are the sums per second of the rows, if they are written; `history` those of earlier rows.
    """
    sec = F.unix_seconds("timestamp")
    span = days * 86400 + 1
    names = list(MEASURES)
    per_second = sums_per_second(rows, every) if sums is None else sums.select("user_id", "__sec", "__c", *names, "__p")
    if history is not None:
        per_second = per_second.unionByName(history.select("user_id", "__sec", "__c", *names, F.lit(0).cast("long").alias("__p")))
    parts = F.array(
        F.struct(F.col("__sec").alias("s"), F.col("__c").alias("c"), *[F.col(n) for n in names], F.col("__p").alias("p")),
        F.struct((F.col("__sec") + span).alias("s"), (-F.col("__c")).alias("c"), *[(-F.col(n)).alias(n) for n in names],
                 F.lit(0).cast("long").alias("p")),
    )
    cols = ["c", *names]
    deltas = (
        per_second.select("user_id", F.explode(parts).alias("d"))
        .select("user_id", F.col("d.s").alias("__sec"), F.floor(F.col("d.s") / 86400).alias("__day"), *[f"d.{c}" for c in [*cols, "p"]])
        .repartition("user_id", "__day")
        .groupBy("user_id", "__day", "__sec").agg(*[F.sum(c).alias(c) for c in cols], F.sum("p").alias("__p"))
    )
    within = Window.partitionBy("user_id", "__day").orderBy("__sec").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("user_id").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    opening = deltas.groupBy("user_id", "__day").agg(*[F.sum(c).alias(c) for c in cols]).select(
        "user_id", "__day", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"o_{c}") for c in cols]
    )
    totals = deltas.withColumns({f"r_{c}": F.sum(c).over(within) for c in cols}).filter("__p > 0").join(
        opening, ["user_id", "__day"]
    ).select("user_id", "__sec", *[(F.col(f"r_{c}") + F.col(f"o_{c}")).alias(f"t_{c}") for c in cols])
    points = rows.filter(F.col("id") % every == 0).select("id", "user_id", sec.alias("__sec"))
    return points.join(totals, ["user_id", "__sec"]).select(
        "id", "user_id", F.col("t_c").alias("n"), *[(F.col(f"t_{n}") / F.col("t_c")).alias(n) for n in names]
    )

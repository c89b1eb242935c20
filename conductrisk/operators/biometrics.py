"""Behavioural biometrics: pointer, keyboard and work features per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conductrisk.functions.common import after_hours, ratio
from conductrisk.operators.entropy import session_entropy, user_entropy_summary
from conductrisk.operators.ordered import previous


POINTER = {"__x": "mouse_x", "__y": "mouse_y", "__t": "timestamp"}
RELEASE = {"__r": "key_release_time"}


def _step_columns(lagged: DataFrame) -> DataFrame:
    dx, dy = F.col("__x") - F.col("mouse_x"), F.col("__y") - F.col("mouse_y")
    return lagged.withColumns({
        "dx": dx, "dy": dy,
        "dt_ms": (F.unix_micros("timestamp") - F.unix_micros("__t")) / 1000,
        "path_segment": F.sqrt(dx * dx + dy * dy),
    }).drop(*POINTER)


def _key_columns(lagged: DataFrame) -> DataFrame:
    return lagged.withColumns({
        "flight_time_ms": F.col("key_press_time") - F.col("__r"),
        "dwell_time_ms": F.col("key_release_time") - F.col("key_press_time"),
    }).drop(*RELEASE)


def mouse_steps(rows: DataFrame) -> DataFrame:
    """dx, dy, dt_ms and path_segment from the user's previous pointer position."""
    return _step_columns(previous(rows, ["user"], "timestamp", "id", POINTER))


def key_times(rows: DataFrame) -> DataFrame:
    """Flight time since the user's previous release, and dwell time."""
    return _key_columns(previous(rows, ["user"], "timestamp", "id", RELEASE))


def _mouse_sums() -> list[Column]:
    position, here = F.struct("timestamp", "id"), F.struct("mouse_x", "mouse_y")
    return [
        F.avg("mouse_velocity").alias("mouse_velocity_mean"),
        F.stddev_samp("mouse_velocity").alias("mouse_velocity_std"),
        (F.count_if(F.col("mouse_velocity") > 0) / F.count("*")).alias("mouse_activity_ratio"),
        F.coalesce(F.sum("path_segment"), F.lit(0.0)).alias("path"),
        F.min_by(here, position).alias("a"),
        F.max_by(here, position).alias("b"),
    ]


def _with_paths(per_user: DataFrame) -> DataFrame:
    """The path measures in place of the sums they need."""
    everyone = per_user.agg(F.sum("path").alias("s")).scalar()
    dx, dy = F.col("b.mouse_x") - F.col("a.mouse_x"), F.col("b.mouse_y") - F.col("a.mouse_y")
    first = ["user", "mouse_velocity_mean", "mouse_velocity_std", "mouse_activity_ratio"]
    return per_user.select(
        *first,
        (F.col("path") / (everyone + 1e-6)).alias("mouse_path_share"),
        (F.col("path") / (F.sqrt(dx * dx + dy * dy) + 1e-6)).alias("mouse_tortuosity_index"),
        *[c for c in per_user.columns if c not in (*first, "path", "a", "b")],
    )


def _per_minute(n):
    seconds = (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 1e6
    return ratio(n * 60.0, F.nullif(seconds, F.lit(0.0)))


def _key_sums() -> list[Column]:
    return [
        F.avg("flight_time_ms").alias("keystroke_flight_mean"),
        F.stddev_samp("flight_time_ms").alias("keystroke_flight_std"),
        F.avg("dwell_time_ms").alias("keystroke_dwell_mean"),
        _per_minute(F.count("*")).alias("typing_speed_wpm"),
    ]


def _work_sums() -> list[Column]:
    return [
        F.avg("is_productive_app").alias("productive_app_ratio"),
        F.avg("is_idle").alias("idle_time_ratio"),
        F.avg("is_non_work_http").alias("non_work_http_ratio"),
        _per_minute(F.count("file_operation")).alias("file_op_velocity"),
        F.avg(after_hours(F.hour("timestamp"), closed=True).cast("int")).alias("after_hours_ratio"),
    ]


def mouse_features(rows: DataFrame) -> DataFrame:
    """Velocity mean and deviation, moving share, share of all users' path, and tortuosity.

    Tortuosity is the path length over the straight line from the first to the last position.
    """
    return _with_paths(mouse_steps(rows).groupBy("user").agg(*_mouse_sums()))


def keystroke_features(rows: DataFrame) -> DataFrame:
    return key_times(rows).groupBy("user").agg(*_key_sums())


def work_features(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user").agg(*_work_sums())


def merge_features(mouse: DataFrame, keys: DataFrame, work: DataFrame) -> DataFrame:
    """Full outer join on the user with one coalesced key."""
    return mouse.join(keys, "user", "full_outer").join(work, "user", "full_outer")


def with_entropy_summary(features: DataFrame, summary: DataFrame) -> DataFrame:
    return features.join(summary, "user", "left")


def signature(rows: DataFrame) -> DataFrame:
    """All behavioural features of a user in one row.

    Pointer, keyboard and work features come from one ordered pass over the rows, the entropies of sessions from another.
    """
    lagged = _key_columns(_step_columns(previous(rows, ["user"], "timestamp", "id", POINTER | RELEASE)))
    per_user = lagged.groupBy("user").agg(*_mouse_sums(), *_key_sums(), *_work_sums())
    return with_entropy_summary(_with_paths(per_user), user_entropy_summary(session_entropy(rows)))


def velocity_anomaly(current: DataFrame, baseline: DataFrame, value: str, by: list[str]) -> DataFrame:
    """min(1, z / 10) where the current mean exceeds five times the baseline mean, else 0."""
    now = current.groupBy(*by).agg(F.avg(value).alias("current_mean"))
    then = baseline.groupBy(*by).agg(
        F.avg(value).alias("baseline_mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("baseline_std")
    )
    z = (F.col("current_mean") - F.col("baseline_mean")) / (F.col("baseline_std") + 1e-6)
    hit = (F.col("baseline_mean") > 0) & (F.col("current_mean") > F.col("baseline_mean") * 5)
    return now.join(then, by, "left").withColumn(
        "velocity_score", F.when(hit, F.least(F.lit(1.0), z / 10)).otherwise(0.0)
    )


def flush_summary(rows: DataFrame, seconds: int = 5) -> DataFrame:
    """Per user and short interval: mean and population deviation of velocity and flight time."""
    keyed = rows.groupBy("user_id", F.window("timestamp", f"{seconds} seconds").alias("w"))
    return keyed.agg(
        F.avg("mouse_velocity_avg").alias("velocity_avg"),
        F.stddev_pop("mouse_velocity_avg").alias("velocity_std"),
        F.avg("keystroke_flight_avg_ms").alias("flight_avg"),
        F.stddev_pop("keystroke_flight_avg_ms").alias("flight_std"),
        F.sum("mouse_click_count").alias("clicks"),
        F.sum("keystroke_count").alias("keys"),
        F.sum("mouse_positions_count").alias("positions"),
    ).select("user_id", F.col("w.start").alias("start"), "velocity_avg", "velocity_std", "flight_avg",
             "flight_std", "clicks", "keys", "positions")

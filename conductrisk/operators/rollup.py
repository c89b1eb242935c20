"""User risk from scored days: decayed totals, own baselines, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conductrisk import config as C
from conductrisk.functions.common import half_even


def latest(df: DataFrame, ts: str = "date") -> Column:
    """The newest timestamp of a table, as a one-value subquery."""
    return df.agg(F.max(ts).alias("m")).scalar()


def _age_days(ts, as_of: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(ts)) / (86400 * 1e6))


def user_risk(scored: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Maximum, decayed sum, their weighted total and the row count per user."""
    as_of = latest(scored) if as_of is None else as_of
    decayed = F.col("risk_score") * F.pow(F.lit(C.DECAY_RATE), _age_days("date", as_of))
    return scored.groupBy("user").agg(
        F.greatest(F.lit(0.0), F.max("risk_score")).alias("max_risk"),
        F.sum(F.when(F.col("risk_score") != 0, decayed).otherwise(0.0)).alias("decayed_sum"),
        F.count("*").alias("event_count"),
    ).withColumn("total_risk_score", C.MAX_WEIGHT * F.col("max_risk") + C.SUM_WEIGHT * F.col("decayed_sum"))


def daily_risk(scored: DataFrame) -> DataFrame:
    """Mean risk per user and day."""
    return scored.groupBy("user", F.to_date("date").alias("day")).agg(F.avg("risk_score").alias("daily_risk"))


def baselines(series: DataFrame, recent: int = C.RECENT_DAYS, window: int = C.BASELINE_DAYS) -> DataFrame:
    """Own baseline: the days before the recent ones; and the maximum of the recent days.

    The daily series is bounded by the days of history, so one window per user is safe.
    """
    back = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("day")))
    in_recent, in_base = F.col("back") <= recent, (F.col("back") > recent) & (F.col("back") <= recent + window)
    value = F.when(in_base, F.col("daily_risk"))
    stats = series.withColumn("back", back).groupBy("user").agg(
        F.count(value).alias("baseline_count"),
        F.avg(value).alias("avg"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        F.max(F.when(in_recent, F.col("daily_risk"))).alias("recent_risk"),
    )
    valid = F.col("baseline_count") >= 3
    return stats.select(
        "user", "baseline_count", valid.alias("baseline_valid"),
        F.when(valid, F.col("avg")).otherwise(0.0).alias("baseline_avg"),
        F.when(valid, F.col("std")).otherwise(0.0).alias("baseline_std"),
        F.when(valid, F.col("min")).alias("baseline_min"),
        F.when(valid, F.col("max")).alias("baseline_max"),
        "recent_risk",
    )


def drift(base: DataFrame) -> DataFrame:
    """is_drift, deviation_sigma and drift_explanation from the baseline columns."""
    valid, recent = F.col("baseline_valid"), F.col("recent_risk")
    avg, std = F.col("baseline_avg"), F.col("baseline_std")
    flat = std < 1.0
    jump = recent > avg + C.LOW_VARIANCE_JUMP
    z = F.try_divide(recent - avg, F.when(std < 1.0, F.lit(1.0)).otherwise(std))
    high = z > C.DRIFT_SIGMA
    is_drift = F.when(~valid, False).when(flat, jump).otherwise(high)
    sigma = F.when(~valid, 0.0).when(flat, F.when(jump, z).otherwise(0.0)).otherwise(z)
    text = (
        F.when(~valid, C.DRIFT_TEXTS["no_baseline"])
        .when(flat & jump, F.format_string(
            C.DRIFT_TEXTS["low_variance_jump"], half_even(recent, 1), half_even(avg, 1)))
        .when(flat, C.DRIFT_TEXTS["low_variance"])
        .when(high, F.format_string(
            C.DRIFT_TEXTS["high"],
            half_even(recent, 1), half_even(avg, 1), half_even(z, 1)))
        .otherwise(f"Within {C.DRIFT_SIGMA} sigma of baseline")
    )
    return base.withColumns({
        "is_drift": is_drift, "deviation_sigma": sigma, "drift_explanation": text,
    })


def user_report(scored: DataFrame) -> DataFrame:
    """The user report: totals and drift per user."""
    drifting = drift(baselines(daily_risk(scored))).select(
        "user", "is_drift", "deviation_sigma", "drift_explanation"
    )
    return user_risk(scored).join(drifting, "user").select(
        "user", "total_risk_score", "max_risk", "event_count", "is_drift", "deviation_sigma", "drift_explanation"
    )


def correlation_boost(events: DataFrame, activity: str = "activity") -> DataFrame:
    """Boost per user for pairs of activities that occur together; at most 0.5."""
    present = lambda a: F.max((F.col(activity) == a).cast("int"))
    boost = F.lit(0.0)
    for first, second, strength in C.CORRELATED_ACTIVITIES:
        both = F.coalesce(present(first) * present(second), F.lit(0))
        boost = boost + both * (strength * 0.1)
    return events.groupBy("user").agg(
        F.when(F.count("*") < 2, 0.0).otherwise(F.least(F.lit(0.5), boost)).alias("boost")
    )


def severity_weights(scored: DataFrame) -> DataFrame:
    """exp(score / 50) relative to the user's maximum (daily rows)."""
    raw = F.exp(F.col("risk_score") / 50)
    return scored.withColumn("severity_weight", raw / F.max(raw).over(Window.partitionBy("user")))


def nonlinear_risk(events: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Recency- and severity-weighted mean risk with the boost for correlated activities.

    The severity weight relative to the maximum is taken out of the sums, so one aggregation per
    user with map-side combine is enough: no window over a user's events.
    """
    as_of = latest(events) if as_of is None else as_of
    weight = F.pow(F.lit(C.DECAY_RATE), _age_days("date", as_of)) * F.exp(F.col("risk_score") / 50)
    sums = events.groupBy("user").agg(
        F.count("*").alias("event_count"),
        F.max("risk_score").alias("max_risk"),
        F.avg("risk_score").alias("avg_risk"),
        F.sum(weight).alias("w"),
        F.sum(weight * F.col("risk_score")).alias("ws"),
    )
    top = F.exp(F.col("max_risk") / 50)
    base = (F.col("ws") / top) / F.greatest(F.col("w") / top, F.lit(1.0))
    return sums.join(correlation_boost(events), "user").select(
        "user", "event_count", "max_risk", "avg_risk", base.alias("base_risk"), "boost",
        F.least(F.lit(100.0), base * (1 + F.col("boost"))).alias("final_risk"),
    )


def rescaled(report: DataFrame, target: float = 97.0) -> DataFrame:
    """Linear rescale of the totals so that the largest lands at `target`."""
    top = report.agg(F.max("total_risk_score").alias("m")).scalar()
    value = F.when(top <= 0, 0.0).otherwise(
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("total_risk_score") / top * target)), 2)
    )
    return report.withColumn("scaled_risk", value)

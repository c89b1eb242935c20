"""One feature row per user and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conductrisk.functions.common import after_hours, iso_weekday, ratio
from conductrisk.operators.timeline import with_event_flags
from conductrisk.session import stage

SLICE_SECONDS = 600
BEHAVIOUR = ["file_copy_count", "usb_count", "removable_media_count", "delete_count",
             "after_hours_count", "event_count"]
COLUMNS = [
    "user", "role", "day", "day_of_week", "far", "eds", "iav", "oaf", "login_entropy",
    "file_count", "email_count", "file_copy_count", "usb_count", "removable_media_count",
    "delete_count", "after_hours_count", "after_hours_ratio", "event_count",
]


def behaviour_counts(flagged: DataFrame) -> DataFrame:
    """Counts per user and day of the flagged logs, and the after-hours share."""
    return (
        flagged.groupBy("user", F.to_date("date").alias("day"))
        .agg(
            F.count_if("is_file_copy").alias("file_copy_count"),
            F.count_if("is_usb_connect").alias("usb_count"),
            F.count_if("is_removable").alias("removable_media_count"),
            F.count_if("is_delete").alias("delete_count"),
            F.count_if(after_hours(F.hour("date"))).alias("after_hours_count"),
            F.count("*").alias("event_count"),
        )
        .withColumn("after_hours_ratio", ratio(F.col("after_hours_count"), F.col("event_count")))
    )


def source_counts(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("user", F.to_date("date").alias("day")).agg(
        F.count_if(F.col("source") == "File").alias("file_count"),
        F.count_if(F.col("source") == "Email").alias("email_count"),
    )


def odd_hours(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("user", F.to_date("date").alias("day")).agg(
        F.avg(after_hours(F.hour("date")).cast("int")).alias("oaf")
    )


def login_entropy(timeline: DataFrame) -> DataFrame:
    """Natural-log entropy of the hours of a user's day."""
    per_hour = timeline.groupBy("user", F.to_date("date").alias("day"), F.hour("date").alias("hour")).agg(
        F.count("*").alias("n")
    )
    return per_hour.groupBy("user", "day").agg(
        F.greatest(F.lit(0.0), F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias("login_entropy")
    )


def _gaps_in_slices(timeline: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Per user, day and short time slice: count, first and last time, sums of gaps, measures.

    Gap sums of neighbouring slices can be merged later, so a user-day of any size is spread
    over many tasks.
    """
    sliced = timeline.withColumns({
        "day": F.to_date("date"),
        "hour": F.hour("date"),
        "__us": F.unix_micros("date"),
        "__slice": F.floor(F.unix_seconds("date") / SLICE_SECONDS),
    })
    w = Window.partitionBy("user", "day", "__slice").orderBy("__us", "id")
    gap = (F.col("__us") - F.lag("__us").over(w)) / 1e6
    return (
        sliced.withColumn("__gap", gap)
        .groupBy("user", "day", "__slice")
        .agg(
            F.first("hour").alias("hour"), F.count("*").alias("n"),
            F.min("__us").alias("first_us"), F.max("__us").alias("last_us"),
            F.coalesce(F.sum("__gap"), F.lit(0.0)).alias("g1"),
            F.coalesce(F.sum(F.col("__gap") * F.col("__gap")), F.lit(0.0)).alias("g2"),
            *[c.alias(name) for name, c in measures.items()],
        )
    )


def _per_user_day(sliced: DataFrame, measures: list[str]) -> DataFrame:
    """Merge the slices of a user-day. One exchange on (user, day) serves all three steps."""
    w = Window.partitionBy("user", "day").orderBy("__slice")
    bridge = (F.col("first_us") - F.lag("last_us").over(w)) / 1e6
    bridged = sliced.withColumn("__b", F.coalesce(bridge, F.lit(0.0)))
    hourly = bridged.groupBy("user", "day", "hour").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("g1") + F.col("__b")).alias("g1"),
        F.sum(F.col("g2") + F.col("__b") * F.col("__b")).alias("g2"),
        *[F.sum(m).alias(m) for m in measures],
    )
    gaps = F.sum("n") - 1
    variance = (F.sum("g2") - F.sum("g1") * F.sum("g1") / gaps) / (gaps - 1)
    return hourly.groupBy("user", "day").agg(
        F.when(gaps >= 2, F.greatest(F.lit(0.0), variance)).otherwise(0.0).alias("iav"),
        F.greatest(F.lit(0.0), F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias("login_entropy"),
        F.sum("n").alias("n"),
        *[F.sum(m).alias(m) for m in measures],
    )


def activity_variance(timeline: DataFrame) -> DataFrame:
    """Sample variance of the seconds between a user's events of one day."""
    return _per_user_day(_gaps_in_slices(timeline, {}), []).select("user", "day", "iav")


def peer_stats(timeline: DataFrame, roster: DataFrame) -> DataFrame:
    """Mean file count, mean and sample deviation of the email count per role and day."""
    return _peers(with_role(source_counts(timeline), roster))


def _peers(days: DataFrame) -> DataFrame:
    return days.groupBy("role", "day").agg(
        F.avg("file_count").alias("peer_file_mean"),
        F.avg("email_count").alias("peer_email_mean"),
        F.stddev_samp("email_count").alias("peer_email_std"),
    )


def with_role(df: DataFrame, roster: DataFrame, default: str = "Unknown") -> DataFrame:
    """Attach the role of the user. Spark broadcasts the roster only if it measures small."""
    return df.join(roster.select("user", "role"), "user", "left").withColumn(
        "role", F.coalesce("role", F.lit(default))
    )


def peer_relative(df: DataFrame, peers: DataFrame) -> DataFrame:
    """far and eds. The peer table has one row per role and day, so it joins as a small side."""
    joined = df.join(peers, ["role", "day"], "left")
    far = F.col("file_count") / (F.col("peer_file_mean") + 1e-6)
    eds = (F.col("email_count") - F.col("peer_email_mean")) / (F.col("peer_email_std") + 1e-6)
    return joined.withColumns({"far": far, "eds": F.coalesce(eds, F.lit(0.0))}).drop(
        "peer_file_mean", "peer_email_mean", "peer_email_std"
    )


def daily_features(activity: DataFrame, roster: DataFrame) -> DataFrame:
    """The daily feature table of the unified, flagged activity log.

    Web rows count for time-based features but not for behaviour counts. Two exchanges of log
    rows: (user, day, slice), then the much smaller slices by (user, day).
    """
    flagged = with_event_flags(activity)
    odd, not_web = after_hours(F.hour("date")), F.col("source") != "Http"
    measures = {
        "file_count": F.count_if(F.col("source") == "File"),
        "email_count": F.count_if(F.col("source") == "Email"),
        "odd": F.count_if(odd),
        "file_copy_count": F.count_if("is_file_copy"),
        "usb_count": F.count_if("is_usb_connect"),
        "removable_media_count": F.count_if(F.col("is_removable") & not_web),
        "delete_count": F.count_if("is_delete"),
        "after_hours_count": F.count_if(odd & not_web),
        "event_count": F.count_if(not_web),
    }
    # the log is read once: peers are told from the rows per user and day, which are written
    per_day = stage(with_role(_per_user_day(_gaps_in_slices(flagged, measures), list(measures)), roster), "per-day")
    with_peers = peer_relative(per_day, _peers(per_day))
    return with_peers.withColumns({
        "oaf": F.col("odd") / F.col("n"),
        "after_hours_ratio": ratio(F.col("after_hours_count"), F.col("event_count")),
        "day_of_week": iso_weekday("day"),
    }).select(COLUMNS)


def join_behaviour(features: DataFrame, counts: DataFrame) -> DataFrame:
    """Left join of separately computed behaviour counts; days without any get zeros."""
    return features.join(counts, ["user", "day"], "left").fillna(0, BEHAVIOUR + ["after_hours_ratio"])

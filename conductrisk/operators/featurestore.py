"""Feature statistics, quality checks, frequency encoding and event-level features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conductrisk import config as C
from conductrisk.functions.common import after_hours, cyclical, feature_id, ratio, with_defaults
from conductrisk.operators.entropy import LEVELS, component_entropies, entropy_level, percentile_rank
from conductrisk.operators.ordered import percentiles, previous, rolling_counts
from conductrisk.session import stage


def long_form(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value) rows of some numeric columns."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(F.explode(pairs).alias("p")).select("p.feature", "p.value")


def statistics(df: DataFrame, features: list[str]) -> DataFrame:
    """Count, missing, unique, moments, range and quartiles, one row per feature.

    Values are counted per (feature, value) first; distinct counts and moments follow from that.
    """
    rows = long_form(df, features)
    values = rows.groupBy("feature", "value").agg(F.count("*").alias("n"))
    present = F.col("value").isNotNull()
    n = F.sum(F.when(present, F.col("n")))
    mean = F.sum(F.col("value") * F.col("n")) / n
    basic = values.groupBy("feature").agg(
        F.sum("n").alias("count"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("missing"),
        F.count_if(present).alias("unique"),
        n.alias("present"),
        mean.alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    spread = rows.groupBy("feature").agg(F.stddev_samp("value").alias("std"))
    quartiles = percentiles(rows, "value", [0.25, 0.5, 0.75], ["feature"], max_groups=len(features)).select(
        "feature", F.col("p")[0].alias("q25"), F.col("p")[1].alias("q50"), F.col("p")[2].alias("q75"))
    return basic.drop("present").join(spread, "feature").join(quartiles, "feature", "left")


def quality(stats: DataFrame, reference: DataFrame, kinds: DataFrame) -> DataFrame:
    """Issues per feature: missing above 10 %, too many categories, shifted mean."""
    ref = reference.select("feature", F.col("mean").alias("ref_mean"), F.col("std").alias("ref_std"))
    joined = stats.join(ref, "feature", "left").join(kinds, "feature", "left")
    missing = ratio(F.col("missing"), F.col("count"))
    z = F.try_divide(F.abs(F.col("mean") - F.col("ref_mean")), F.col("ref_std"))
    issues = F.filter(F.array(
        F.when(missing > 0.1, F.format_string(C.QUALITY_TEXTS["missing"], missing * 100)),
        F.when((F.col("dtype") == "category") & (ratio(F.col("unique"), F.col("count")) > 0.5),
               F.concat(F.lit(C.QUALITY_TEXTS["cardinality"]), F.col("unique"), F.lit(C.QUALITY_TEXTS["unique"]))),
        F.when((F.col("ref_std") > 0) & (z > 3), F.format_string(C.QUALITY_TEXTS["shift"], z)),
    ), lambda x: x.isNotNull())
    return joined.select(
        "feature", (F.size(issues) == 0).alias("valid"), issues.alias("issues"),
        missing.alias("missing_ratio"), F.col("unique").alias("unique_count"),
    )


def fit_frequency(df: DataFrame, column: str) -> DataFrame:
    """Share per category, and whether it is rare (below one per cent of all rows)."""
    total = df.agg(F.count("*").alias("n")).scalar()
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
    return counts.select("category", (F.col("n") / total).alias("share"), (F.col("n") < total * 0.01).alias("is_rare"))


def encode_frequency(df: DataFrame, column: str, encoder: DataFrame, name: str) -> DataFrame:
    """Attach the share of the category; rare and unknown ones get 0."""
    code = F.when(~F.col("is_rare"), F.col("share"))
    return (
        df.join(encoder, df[column] == encoder["category"], "left")
        .withColumn(name, F.coalesce(code, F.lit(0.0)).cast("float"))
        .drop("category", "share", "is_rare")
    )


def datetime_features(df: DataFrame, ts: str = "date") -> DataFrame:
    hour, dow = F.hour(ts), F.weekday(F.col(ts))
    hour_sin, hour_cos = cyclical(hour, 24)
    dow_sin, dow_cos = cyclical(dow, 7)
    return df.withColumns({
        "hour_sin": hour_sin, "hour_cos": hour_cos, "day_of_week_sin": dow_sin, "day_of_week_cos": dow_cos,
        "is_weekend": (dow >= 5).cast("int"), "is_after_hours": after_hours(hour, closed=True).cast("int"),
    })


def rolling_event_counts(activity: DataFrame, more: dict | None = None) -> DataFrame:
    """Counts over the trailing hours of the user, per event."""
    source, action = F.col("source"), F.col("activity")
    everything = F.lit(True)
    return rolling_counts(activity, "user", "date", {
        "logon_count_1h": (source == "Logon", 1),
        "logon_count_24h": (source == "Logon", 24),
        "file_access_count_1h": (source == "File", 1),
        "file_access_count_24h": (source == "File", 24),
        "http_count_1h": (source == "Http", 1),
        "device_count_1h": (source == "Device", 1),
        "usb_events_7d": ((source == "Device") & (action == "Connect"), 168),
        "file_copy_count_24h": (action == "File Copy", 24),
        "event_count_24h": (everything, 24),
    } | (more or {}))


BIOMETRIC_DEFAULTS = {
    "mouse_velocity": 0.0, "mouse_tortuosity": 0.0, "keystroke_flight_time": 0.0,
    "keystroke_anomaly_score": 0.0, "productive_app_ratio": 0.0,
}


def event_features(activity: DataFrame) -> DataFrame:
    """The event-level feature set: cyclical time, rolling counts, biometric defaults."""
    return with_defaults(datetime_features(rolling_event_counts(activity)), BIOMETRIC_DEFAULTS)


def session_features(rows: DataFrame) -> DataFrame:
    """Pointer, keyboard and session features per user and day of raw biometric rows, in one ordered pass.

    idle_time sums the seconds that ended in an idle row. The keyboard score compares the day's mean flight time with the mean and
    deviation of the user's days. A day with a single row has no flight time.
    """
    lagged = previous(rows.withColumn("day", F.to_date("timestamp")), ["user", "day"], "timestamp", "id",
                      {"__x": "mouse_x", "__y": "mouse_y", "__t": "timestamp", "__r": "key_release_time"})
    seconds = (F.unix_micros("timestamp") - F.unix_micros("__t")) / 1e6
    step = F.sqrt(F.pow(F.col("mouse_x") - F.col("__x"), 2) + F.pow(F.col("mouse_y") - F.col("__y"), 2))
    here, place = F.struct("mouse_x", "mouse_y"), F.struct("timestamp", "id")
    days = lagged.groupBy("user", "day").agg(
        ((F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 1e6).alias("session_duration"),
        F.coalesce(F.sum(F.when(F.col("is_idle") == 1, seconds)), F.lit(0.0)).alias("idle_time"),
        F.avg("is_productive_app").alias("productive_app_ratio"), F.avg("mouse_velocity").alias("mouse_velocity"),
        F.avg(F.col("key_press_time") - F.col("__r")).alias("keystroke_flight_time"),
        F.coalesce(F.sum(step), F.lit(0.0)).alias("path"), F.min_by(here, place).alias("a"), F.max_by(here, place).alias("b"))
    straight = F.sqrt(F.pow(F.col("b.mouse_x") - F.col("a.mouse_x"), 2) + F.pow(F.col("b.mouse_y") - F.col("a.mouse_y"), 2))
    days = stage(days.withColumn("mouse_tortuosity", F.col("path") / (straight + 1e-6)).drop("path", "a", "b"), "session-days")
    base = days.groupBy("user").agg(F.avg("keystroke_flight_time").alias("m"),
                                    F.coalesce(F.stddev_samp("keystroke_flight_time"), F.lit(0.0)).alias("s"))
    flight = F.col("keystroke_flight_time")
    hit = (F.col("m") > 0) & (flight > F.col("m") * 5)
    return days.join(base, "user", "left").withColumn("keystroke_anomaly_score", F.when(
        hit, F.least(F.lit(1.0), (flight - F.col("m")) / (F.col("s") + 1e-6) / 10)).otherwise(0.0)).drop("m", "s")


def session_levels(rows: DataFrame, roster: DataFrame) -> DataFrame:
    """Entropy risk level per user and day: the percentile of the composite entropy among all sessions, cut by role."""
    sessions = component_entropies(rows.withColumn("day", F.to_date("timestamp")), ["user", "day"])
    sessions = stage(sessions.select("user", "day", F.round("composite_entropy", 9).alias("v")), "session-entropies")
    ranked = percentile_rank(sessions, sessions, "v").join(roster.select("user", "role"), "user", "left")
    return ranked.select("user", "day", entropy_level(F.col("entropy_percentile"), F.col("role")).alias("entropy_risk_level"))


def event_pipeline(activity: DataFrame, biometric: DataFrame, roster: DataFrame) -> DataFrame:
    """All features of the contract (config.EVENT_FEATURES) per event: id, user, date, the features, and the cyclical pairs.

    Times and counts are those of the event, after_hours_ratio is the share of the user's last 24 hours, and the biometric, session
    and entropy features are those of the user's day. Events of a day without biometric rows have null there.
    """
    late = after_hours(F.hour("date"), closed=True)
    counted = rolling_event_counts(activity, {"__late": (late, 24)}).withColumns({
        "hour": F.hour("date"), "day_of_week": F.weekday("date"), "day": F.to_date("date"),
        "after_hours_ratio": ratio(F.col("__late"), F.col("event_count_24h"))})
    days = session_features(biometric).join(session_levels(biometric, roster), ["user", "day"], "left")
    timed = datetime_features(counted)
    pairs = ["hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos"]
    return timed.join(days, ["user", "day"], "left").select("id", "user", "date", *[n for n, _, _ in C.EVENT_FEATURES], *pairs)


def feature_values(rows: DataFrame) -> DataFrame:
    """The features of the contract as numbers; the entropy level by its rank."""
    ranks = F.array(*[F.lit(n) for n in LEVELS])
    level = F.nullif(F.array_position(ranks, F.col("entropy_risk_level")), F.lit(0))
    return rows.select(*[level.alias(n) if n == "entropy_risk_level" else F.col(n) for n, _, _ in C.EVENT_FEATURES])


def moments(values: DataFrame, features: list[str]) -> DataFrame:
    """feature, count, missing, unique, mean, std in one pass: counts per (feature, value), then sums."""
    counts = long_form(values, features).groupBy("feature", "value").agg(F.count("*").alias("n"))
    v, n = F.col("value"), F.col("n").cast("double")
    k = F.sum(F.when(v.isNotNull(), n))
    mean = F.sum(v * n) / k
    var = (F.sum(v * v * n) / k - mean * mean) * k / F.nullif(k - 1, F.lit(0.0))
    # what rounding leaves of a constant feature is no deviation
    var = F.when(var > 1e-12 * mean * mean, var).when(var.isNotNull(), 0.0)
    return counts.groupBy("feature").agg(
        F.sum("n").alias("count"), F.coalesce(F.sum(F.when(v.isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.count("value").alias("unique"), mean.alias("mean"), F.sqrt(var).alias("std"))


def pipeline_warnings(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """The quality verdict of every feature of the contract against the rows of an earlier time, with the feature's stable id."""
    names = [n for n, _, _ in C.EVENT_FEATURES]
    kinds = feature_catalogue(rows.sparkSession).select(F.col("name").alias("feature"), "dtype", "feature_id")
    judged = quality(moments(feature_values(rows), names), moments(feature_values(reference), names), kinds.drop("feature_id"))
    return judged.join(F.broadcast(kinds), "feature")


def feature_catalogue(spark) -> DataFrame:
    """The feature contract as a table with stable feature ids."""
    rows = spark.createDataFrame(
        [(n, kind, dtype, "1.0.0") for n, kind, dtype in C.EVENT_FEATURES],
        "name string, kind string, dtype string, version string",
    )
    return rows.withColumn("feature_id", feature_id("name", "version"))

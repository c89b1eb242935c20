"""Raw logs to one timeline: tagging, pruning, union, validation, labels, small projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conductrisk import config as C
from conductrisk import schemas
from conductrisk.functions.common import (
    after_hours, blank_to_null, clamp, iso_weekday, parse_time, ratio, to_bool, to_number,
)

COMMON = ["id", "user", "date", "pc", "source", "activity"]
SOURCE_OF = {"logon": "Logon", "file": "File", "http": "Http", "device": "Device"}


def tag_source(log: DataFrame, kind: str) -> DataFrame:
    """Add the source; web rows get their constant activity and an empty content."""
    log = log.withColumn("source", F.lit(SOURCE_OF[kind]))
    if kind == "http":
        log = log.withColumns({
            "activity": F.lit("Http Request"),
            "content": F.coalesce("content", F.lit("")),
        })
    return log


def with_defaults_content(log: DataFrame) -> DataFrame:
    """id, source, activity and a never-null content of a tagged log."""
    if "content" not in log.columns:
        log = log.withColumn("content", F.lit(""))
    return log.select("id", "source", "activity", F.coalesce("content", F.lit("")).alias("content"))


def unify(logs: dict[str, DataFrame]) -> DataFrame:
    """Union of the logs on the common columns. Unordered; order belongs to the reader."""
    parts = [tag_source(df, kind).select(COMMON) for kind, df in logs.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def prepare_behaviour(logs: dict[str, DataFrame]) -> DataFrame:
    """Union of the flagged logs that carry behaviour counts (web rows carry none)."""
    parts = []
    for kind in ("file", "device", "logon"):
        if kind not in logs:
            continue
        log = tag_source(logs[kind], kind)
        if "to_removable_media" not in log.columns:
            log = log.withColumn("to_removable_media", F.lit(None).cast("string"))
        parts.append(log.select(*COMMON, "to_removable_media"))
    return with_event_flags(reduce(lambda a, b: a.unionByName(b), parts))


def with_event_flags(df: DataFrame) -> DataFrame:
    is_file = F.col("source") == "File"
    return df.withColumns({
        "is_file_copy": is_file & (F.col("activity") == "File Copy"),
        "is_delete": is_file & F.lower("activity").contains("delete"),
        "is_usb_connect": (F.col("source") == "Device") & (F.col("activity") == "Connect"),
        "is_removable": to_bool("to_removable_media"),
    })


def with_date_parts(df: DataFrame, ts: str = "date") -> DataFrame:
    return df.withColumns({
        "hour": F.hour(ts), "day_of_week": iso_weekday(ts), "day": F.to_date(ts),
    })


def with_text_dates(df: DataFrame, text: str) -> DataFrame:
    """Parse a text timestamp (bad text gives null) and derive its parts."""
    return with_date_parts(df.withColumn("date", parse_time(text)))


def with_after_hours_variants(df: DataFrame, ts: str = "date") -> DataFrame:
    """The four definitions of after hours, each used in its own place."""
    hour = F.hour(ts)
    return df.withColumns({
        "ah_features": after_hours(hour),
        "ah_event": after_hours(hour, closed=True),
        "ah_live_tactic": after_hours(hour, 8, 20, closed=True),
        "ah_context": after_hours(hour, 6, 22, closed=True),
    })


def rename_users(users: DataFrame) -> DataFrame:
    return users.withColumnsRenamed({"id": "user", "dept": "department"})


def fill_user_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "role": F.coalesce("role", F.lit("Employee")),
        "department": F.coalesce("department", F.lit("General")),
    })


def with_truth_by_date(df: DataFrame, user: str = C.TRUTH_USER, start: str = C.TRUTH_START_DATE) -> DataFrame:
    label = (F.col("user") == user) & (F.to_date("date") >= F.lit(start).cast("date"))
    return df.withColumn("label", label.cast("int"))


def with_truth_by_offset(df: DataFrame, user: str = C.TRUTH_USER, offset: int = C.TRUTH_START_OFFSET) -> DataFrame:
    """Label by whole days since the first event of the whole table."""
    first = df.agg(F.min("date").alias("m")).scalar()
    days = F.floor((F.unix_micros("date") - F.unix_micros(first)) / (86400 * 1e6)).cast("int")
    return df.withColumn("day_offset", days).withColumn(
        "label", ((F.col("user") == user) & (F.col("day_offset") >= offset)).cast("int")
    )


def validity(log: DataFrame, kind: str) -> DataFrame:
    """Add `is_valid`: required fields present, activity among the allowed ones."""
    ok = F.lit(True)
    for name in schemas.REQUIRED_FIELDS[kind]:
        ok = ok & F.col(name).isNotNull()
    if kind in schemas.ALLOWED_ACTIVITIES:
        ok = ok & F.coalesce(F.col("activity").isin(schemas.ALLOWED_ACTIVITIES[kind]), F.lit(False))
    return log.withColumn("is_valid", ok)


def split_valid(log: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    checked = validity(log, kind)
    return checked.filter("is_valid").drop("is_valid"), checked.filter("not is_valid").drop("is_valid")


def clean_report(df: DataFrame, numbers: list[str], texts: list[str], flags: list[str]) -> DataFrame:
    """Defensive types for a report read as text."""
    return df.withColumns({
        **{c: to_number(c) for c in numbers},
        **{c: blank_to_null(c) for c in texts},
        **{c: to_bool(c, yes=True) for c in flags},
    })


def event_time_text(df: DataFrame) -> DataFrame:
    """`timestamp` = date, else day, blanks as null."""
    return df.withColumn("timestamp", F.coalesce(blank_to_null("date"), blank_to_null("day")))


def factor_bars(daily: DataFrame) -> DataFrame:
    """0-100 bars of a daily row: ratios times 100, counts relative to the larger count."""
    ratios, counts = ["far", "eds", "iav", "oaf", "login_entropy"], ["file_count", "email_count"]
    largest = F.greatest(F.lit(1), *[F.col(c) for c in counts])
    bar = lambda c: clamp(F.when(c <= 1, c * 100).otherwise(c), 0, 100)
    return daily.withColumns({
        **{f"{c}_bar": bar(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in ratios},
        **{f"{c}_bar": ratio(F.col(c).cast("double"), largest) * 100 for c in counts},
    })

"""Views that give the star-schema test tables the shape of activity logs and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conductrisk.session import prepare

# fixed values: event type -> (source, activity); errors are split by the parity of k
ACTIVITY_OF = {
    "signup": ("Logon", "Logon"),
    "view": ("Http", "Http Request"),
    "click": ("File", "File Open"),
    "purchase": ("File", "File Copy"),
}
# fixed values: market segment -> role
ROLE_OF = {
    "MACHINERY": "Admin",
    "AUTOMOBILE": "Contractor",
    "FURNITURE": "Developer",
    "HOUSEHOLD": "Manager",
    "BUILDING": "Employee",
}
# fixed values: applications, chosen by k modulo the length of the list
APPS = [
    "Excel.exe", "Chrome", "Visual Studio", "Netflix", "Terminal", "Telegram", "Outlook",
    "7zip", "PuTTY", "Mystery Tool",
]
APP_CATEGORIES = ["office", "browser", "development", "messaging"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lookup(column, mapping: dict[str, str], default=None):
    out = F.lit(default)
    for key, value in mapping.items():
        out = F.when(column == key, value).otherwise(out)
    return out


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(table(spark, sf_dir, "events"))


def as_events(raw: DataFrame) -> DataFrame:
    """Events with a UTC timestamp, the numeric `k` of the payload and a string user."""
    return raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.concat(F.lit("U"), F.col("user_id")).alias("user"),
        F.concat(F.lit("PC-"), F.col("user_id")).alias("pc"),
    )


def as_activity(ev: DataFrame) -> DataFrame:
    """Unified activity log: id, user, date, pc, source, activity, to_removable_media."""
    kind = F.col("event_type")
    is_error, even = kind == "error", F.col("k") % 2 == 0
    source = F.when(is_error, F.when(even, "Device").otherwise("File")).otherwise(
        _lookup(kind, {k: v[0] for k, v in ACTIVITY_OF.items()})
    )
    activity = F.when(is_error, F.when(even, "Connect").otherwise("File Delete")).otherwise(
        _lookup(kind, {k: v[1] for k, v in ACTIVITY_OF.items()})
    )
    return ev.select(
        F.concat(F.lit("E"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("id"),
        "user",
        F.col("ts").alias("date"),
        "pc",
        source.alias("source"),
        activity.alias("activity"),
        ((kind == "purchase") & (F.col("k") >= 50)).alias("to_removable_media"),
        F.lit("").alias("content"),
        "k",
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_activity(events(spark, sf_dir))


def raw_logs(act: DataFrame) -> dict[str, DataFrame]:
    """The four raw logs behind the unified log."""
    base = ["id", "user", "date", "pc"]
    log = lambda source: act.filter(F.col("source") == source)
    return {
        "logon": log("Logon").select(*base, "activity"),
        "file": log("File").select(
            *base,
            F.concat(F.lit("file_"), F.col("k")).alias("filename"),
            "activity",
            F.initcap(F.col("to_removable_media").cast("string")).alias("to_removable_media"),
        ),
        "http": log("Http").select(
            *base,
            F.concat(F.lit("http://site"), F.col("k") % 13).alias("url"),
            F.lit(None).cast("string").alias("content"),
        ),
        "device": log("Device").select(*base, "activity"),
    }


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User dimension of the active users: user, name, role, department, pc, key."""
    ids = table(spark, sf_dir, "events").select("user_id").distinct()
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    return (
        ids.join(customer, ids.user_id == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .select(
            F.concat(F.lit("U"), F.col("user_id")).alias("user"),
            F.col("c_name").alias("name"),
            _lookup(F.col("c_mktsegment"), ROLE_OF).alias("role"),
            F.col("n_name").alias("department"),
            F.concat(F.lit("PC-"), F.col("user_id")).alias("pc"),
            F.col("user_id").alias("user_key"),
        )
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User dimension of all customers, with or without events."""
    nation = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("U"), F.col("c_custkey")).alias("user"), F.col("c_name").alias("name"),
        _lookup(F.col("c_mktsegment"), ROLE_OF).alias("role"), F.col("n_name").alias("department"),
        F.concat(F.lit("PC-"), F.col("c_custkey")).alias("pc"), F.col("c_custkey").alias("user_key"),
    )


def _pick(values: list[str], index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def as_telemetry(ev: DataFrame) -> DataFrame:
    """Flat telemetry rows, one per event."""
    k = F.col("k")
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.col("user").alias("user_id"),
        F.concat(F.lit("session_"), "user", F.lit("_"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.col("value").alias("mouse_velocity_avg"),
        (F.col("value") / 4).alias("mouse_velocity_std"),
        (k % 7).cast("long").alias("mouse_click_count"),
        (k % 11).cast("long").alias("mouse_positions_count"),
        (F.col("value") * 2 + k).alias("keystroke_flight_avg_ms"),
        (F.lit(1.0) + k / 2).alias("keystroke_flight_std_ms"),
        (k % 50).cast("long").alias("keystroke_count"),
        _pick(APPS, k % len(APPS)).alias("active_app"),
        F.concat(F.lit("Window "), k).alias("window_title"),
        F.concat(F.lit("p"), k).alias("process_id"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_telemetry(events(spark, sf_dir))


def as_payload(ev: DataFrame) -> DataFrame:
    """Nested telemetry payloads as JSON text; every third payload lacks the keyboard part."""
    t = as_telemetry(ev)
    payload = F.struct(
        "user_id",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "session_id",
        F.struct(
            F.col("mouse_velocity_avg").alias("velocity_avg"),
            F.col("mouse_velocity_std").alias("velocity_std"),
            F.col("mouse_click_count").alias("click_count"),
            F.col("mouse_positions_count").alias("positions_count"),
        ).alias("mouse"),
        F.when(
            F.col("id") % 3 != 0,
            F.struct(
                F.col("keystroke_flight_avg_ms").alias("flight_time_avg_ms"),
                F.col("keystroke_flight_std_ms").alias("flight_time_std_ms"),
                F.col("keystroke_count").alias("key_press_count"),
            ),
        ).alias("keyboard"),
        F.struct(
            F.when(F.col("id") % 5 != 0, F.col("active_app")).alias("app_name"),
            F.col("window_title"),
            F.col("process_id").alias("pid"),
        ).alias("active_window"),
    )
    return t.select("id", F.to_json(payload).alias("payload"))


def as_biometrics(ev: DataFrame) -> DataFrame:
    """Raw biometric telemetry: pointer position, key times, application, domain, flags."""
    k, eid = F.col("k"), F.col("event_id")
    press = F.unix_micros("ts") / 1000
    domain = F.when(F.col("event_type") == "view", F.concat(F.lit("site"), k % 13, F.lit(".example")))
    return ev.select(
        eid.alias("id"),
        "user",
        F.col("ts").alias("timestamp"),
        ((eid * 37) % 1920).cast("double").alias("mouse_x"),
        ((eid * 53 + k) % 1080).cast("double").alias("mouse_y"),
        F.when(k % 10 == 0, F.lit(0.0)).otherwise(F.col("value")).alias("mouse_velocity"),
        press.alias("key_press_time"),
        (press + 40 + k).alias("key_release_time"),
        _pick(APP_CATEGORIES, k % len(APP_CATEGORIES)).alias("app_category"),
        F.col("event_type").alias("activity_type"),
        domain.alias("domain"),
        F.when(k < 60, 1).otherwise(0).alias("is_productive_app"),
        F.when(k >= 90, 1).otherwise(0).alias("is_idle"),
        F.when(domain.isNotNull() & (k % 13 >= 10), 1).otherwise(0).alias("is_non_work_http"),
        F.when(F.col("event_type").isin("click", "purchase"), 1).alias("file_operation"),
    )


def biometrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_biometrics(events(spark, sf_dir))

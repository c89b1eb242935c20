"""The tables the queries share, from raw events to scored days and scored telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conductrisk import adapters as A
from conductrisk.operators import daily as daily_ops
from conductrisk.operators import rollup, sequence_models, sequences
from conductrisk.operators import telemetry as live
from conductrisk.operators.scoring import score_daily
from conductrisk.session import stage


KEEP = ["user", "role", "day", "date", "id", "risk_score", "anomaly_score", "mitre_tactic",
        "mitre_technique", "file_copy_count", "usb_count", "explanation"]
#: What the reads on top of the stored telemetry use; texts and parts of the score are neither worked out nor written for them.
LIVE_KEEP = ["id", "user_id", "role", "timestamp", "active_app", "window_title", "keystroke_count", "mouse_click_count",
             "mouse_velocity_avg", "keystroke_flight_avg_ms", "risk_score", "anomaly_score", "productivity_score",
             "mitre_tactic", "mitre_technique"]


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_ops.daily_features(A.activity(spark, sf_dir), A.roster(spark, sf_dir))


def errors(spark: SparkSession, sf_dir: str, latent: int = 0) -> DataFrame:
    """Daily rows with sequence errors. Both steps are read several times, so each is written.

    With `latent` components the errors come from models fitted on the daily rows.
    """
    days = stage(daily(spark, sf_dir), "daily")
    if latent:
        return stage(sequence_models.score(days, sequence_models.fit(days, latent)), "errors")
    return stage(sequences.sequence_errors(days), "errors")


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rows with the anomaly score and the metadata of the model in charge."""
    return anomalies_of(errors(spark, sf_dir))


def anomalies_of(rows: DataFrame) -> DataFrame:
    return sequences.with_model(sequences.anomaly_scores(rows), sequences.model_metadata(rows))


def scored(spark: SparkSession, sf_dir: str, latent: int = 0) -> DataFrame:
    """Scored user-days with a timestamp and a row id."""
    return scored_of(errors(spark, sf_dir, latent))


def scored_of(rows: DataFrame) -> DataFrame:
    return score_daily(anomalies_of(rows)).withColumns({
        "date": F.col("day").cast("timestamp"), "id": F.date_format("day", "yyyyMMdd"),
    })


def report(spark: SparkSession, sf_dir: str, latent: int = 0) -> DataFrame:
    return rollup.user_report(scored_days(spark, sf_dir, latent))


def scored_days(spark: SparkSession, sf_dir: str, latent: int = 0) -> DataFrame:
    """The scored days, written once: roll-ups read them several times."""
    return stage(scored(spark, sf_dir, latent).select(KEEP), "scored")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored telemetry rows, written once for the reads on top of them."""
    rows = A.telemetry(spark, sf_dir)
    return live.score_telemetry(rows, A.roster(spark, sf_dir))


def stored_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(telemetry(spark, sf_dir).select(LIVE_KEEP), "telemetry")


def as_accounts(roster: DataFrame, scored_rows: DataFrame) -> DataFrame:
    """User accounts with the newest risk, productivity and time of their telemetry."""
    state = live.latest_state(scored_rows).withColumnRenamed("user_id", "user")
    return roster.join(state, "user", "left").select(
        F.col("user").alias("user_id"), "name",
        F.concat(F.lower("user"), F.lit("@example.com")).alias("email"), "role", "department",
        (F.col("user_key") % 20 != 0).alias("is_active"),
        F.concat(F.lit("U"), F.floor(F.col("user_key") / 10)).alias("manager_id"),
        "last_seen", "risk_score", "productivity_score",
    )


def live_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(scored telemetry, accounts); each is written once."""
    rows = stored_telemetry(spark, sf_dir)
    return rows, stage(as_accounts(A.roster(spark, sf_dir), rows), "accounts")


def named_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user report with name, role and department."""
    users = A.roster(spark, sf_dir).select("user", "name", "role", "department")
    return report(spark, sf_dir).join(users, "user", "left")

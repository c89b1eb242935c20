"""Writers: tables, reports, appends, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conductrisk.session import fresh_path


def write_table(df: DataFrame, path: str, partition: str | None = None, mode: str = "overwrite") -> DataFrame:
    """Parquet, optionally partitioned, and the table read back."""
    writer = df.write.mode(mode)
    if partition:
        writer = writer.partitionBy(partition)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """CSV with one header per file; nested columns must be flattened before."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_and_read(df: DataFrame, name: str) -> DataFrame:
    """Append to a new table in the shared folder and read the table."""
    path = fresh_path(df.sparkSession, name)
    append(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_feedback(df: DataFrame, path: str) -> None:
    """Analyst feedback as CSV; every part file has its header."""
    df.select("user_id", "day", "is_false_positive").write.mode("append").option("header", True).csv(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def write_timeline(timeline: DataFrame, path: str) -> None:
    """Timeline partitioned by day; rows of a day are ordered inside their files."""
    # rebalance groups rows by day and lets AQE split large days into files of the advisory size
    (
        timeline.withColumn("day", F.to_date("date")).hint("rebalance", F.col("day"))
        .sortWithinPartitions("day", "date", "id").write.mode("overwrite").partitionBy("day").parquet(path)
    )

"""Readers: logs, timelines with a fallback, payloads, artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conductrisk import schemas
from conductrisk.functions.common import after_hours, with_defaults


def read_log(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A raw CSV log with its declared schema. Unparsable values become null."""
    return (
        spark.read.schema(schemas.LOGS[kind]).option("header", True).option("mode", "PERMISSIVE")
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(path)
    )


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """The user dimension from CSV."""
    return spark.read.schema(schemas.USERS).option("header", True).csv(path)


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TIMELINE).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Does the path hold a table? Asked of the file system the path belongs to."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a table, with the file system the path belongs to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def read_featured_or_raw(spark: SparkSession, featured: str, raw: str) -> DataFrame:
    """The featured table if it exists, else the raw timeline with basic time features."""
    if exists(spark, featured):
        return spark.read.parquet(featured)
    rows = read_timeline(spark, raw)
    timed = rows.withColumns({
        "hour": F.hour("date"), "day_of_week": F.weekday("date"),
        "is_after_hours": after_hours(F.hour("date")).cast("int"),
    })
    return with_defaults(timed, {"file_copy_count": 0, "usb_count": 0, "after_hours_ratio": 0.0})


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry payloads, one JSON document per line."""
    return spark.read.text(path).withColumnRenamed("value", "payload")


def artifact_status(spark: SparkSession, folder: str, expected: list[tuple[str, str]]) -> DataFrame:
    """Name, path, existence, size and time of the expected artifacts below a folder."""
    wanted = spark.createDataFrame(expected, "name string, file string")
    if not exists(spark, folder):
        return wanted.select("name", "file", F.lit(False).alias("exists"), F.lit(None).cast("long").alias("size_bytes"),
                             F.lit(None).cast("timestamp").alias("last_modified"))
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        .select("path", "length", "modificationTime")
        .withColumn("file", F.regexp_extract("path", "([^/]+)$", 1))
    )
    return wanted.join(found, "file", "left").select(
        "name", "file", F.col("path").isNotNull().alias("exists"), F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("last_modified"))


def spark_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """A report written with headers, read with a declared schema."""
    return spark.read.schema(schema).option("header", True).csv(path)

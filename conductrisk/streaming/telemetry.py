"""Streams over endpoint telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conductrisk.operators import biometrics
from conductrisk.operators import telemetry as ops
from conductrisk.sources.readers import delete, exists


def live_scores(payloads: DataFrame, roster: DataFrame, baselines: DataFrame) -> DataFrame:
    """Parse payloads and score them against the current roster and baseline tables."""
    rows = ops.with_productivity(ops.with_user_role(ops.flatten_payload(payloads), roster))
    return ops.score(ops.with_baseline(rows, baselines))


def account_writer(spark: SparkSession, base: str):
    """A batch function that appends scored rows and keeps the newest state per user.

    Version n of the state is made from version n - 1 and the rows of batch n, so a batch that is repeated
    writes the same again. A missing version is an error: accounts would be lost without it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        new = ops.latest_state(batch)
        if batch_id:
            old = f"{base}/v{batch_id - 1}"
            if not exists(spark, old):
                raise RuntimeError(f"version {batch_id - 1} of the accounts is missing in {base}")
            new = ops.latest_state(spark.read.parquet(old).withColumnRenamed("last_seen", "timestamp").unionByName(
                new.withColumnRenamed("last_seen", "timestamp")).withColumn("id", F.lit(0)))
        new.write.mode("overwrite").parquet(f"{base}/v{batch_id}")
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch_id={batch_id}")

    return write


class LiveBaselines:
    """A batch function that scores telemetry against baselines that it keeps itself, refreshed at each tenth row.

    Folders below `base`; a batch owns one folder in each and overwrites it when it is repeated:
      in       the rows of the batch with role and productivity
      sums     sums per user and second, by day: only the days of the window are read again
      fresh    the baselines that were refreshed in the batch
      newest   the last refresh of every user, one version per batch; the last two versions stay
      scored   the scored rows
      late     rows that came more than `lateness` after rows that had been seen before; they are not scored
    A row is scored with the user's last refresh before it, in this batch or an earlier one, so never with what comes later.
    """

    def __init__(self, spark: SparkSession, base: str, every: int = 10, days: int = ops.BASELINE_DAYS, lateness: str | None = None):
        self.spark, self.base, self.every, self.days, self.lateness = spark, base, every, days, lateness

    def _folder(self, table: str, batch_id: int) -> str:
        return f"{self.base}/{table}/batch_id={batch_id}"

    def _kept(self, df: DataFrame, table: str, batch_id: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._folder(table, batch_id))
        return self.spark.read.schema(df.schema).parquet(self._folder(table, batch_id))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id and not exists(self.spark, self._folder("newest", batch_id - 1)):
            raise RuntimeError(f"version {batch_id - 1} of the baselines is missing in {self.base}")
        newest = self.spark.read.parquet(self._folder("newest", batch_id - 1)) if batch_id else None
        if self.lateness and newest is not None:
            seen = newest.agg(F.max("seen").alias("s")).scalar()
            marked = self._kept(batch.withColumn("__late", F.coalesce(
                F.col("timestamp") < seen - F.expr(f"INTERVAL {self.lateness}"), F.lit(False))), "in", batch_id)
            self._kept(marked.filter("__late").drop("__late"), "late", batch_id)
            rows = marked.filter("not __late").drop("__late")
        else:
            rows = self._kept(batch, "in", batch_id)
        sums = ops.sums_per_second(rows, self.every)
        sums.withColumn("day", F.floor(F.col("__sec") / 86400)).write.mode("overwrite").partitionBy("day").parquet(
            self._folder("sums", batch_id))
        stored = self._sums(sums.schema)
        fresh = self._kept(ops.refreshed_baselines(
            rows, self.every, self.days, self._history(rows, stored, batch_id), stored.filter(F.col("batch_id") == batch_id)), "fresh", batch_id)
        self._kept(ops.score(ops.with_baseline_as_of(rows, fresh, newest)), "scored", batch_id)
        last = ops.last_refreshes(rows, fresh).withColumn("seen", F.lit(None).cast("timestamp"))
        # a row without a user carries the newest time that was seen
        mark = rows.agg(F.max("timestamp").alias("seen")).select(
            F.lit(None).cast("string").alias("user_id"), F.lit(None).cast(last.schema["last"].dataType).alias("last"), "seen")
        both = last.unionByName(mark)
        if newest is not None:
            both = both.unionByName(newest)
        self._kept(both.groupBy("user_id").agg(F.max("last").alias("last"), F.max("seen").alias("seen")), "newest", batch_id)
        if batch_id > 1:
            delete(self.spark, self._folder("newest", batch_id - 2))

    def _sums(self, day: T.StructType) -> DataFrame:
        """The sums of all batches."""
        schema = T.StructType([*day.fields, T.StructField("batch_id", T.IntegerType()), T.StructField("day", T.LongType())])
        return self.spark.read.schema(schema).parquet(f"{self.base}/sums")

    def _history(self, rows: DataFrame, sums: DataFrame, batch_id: int) -> DataFrame | None:
        """Sums of earlier batches that a refresh in this batch can reach, of the users that are refreshed."""
        points = rows.filter(F.col("id") % self.every == 0)
        first = points.agg(F.min("timestamp").alias("t")).select(
            F.floor(F.unix_seconds("t") / 86400).alias("d")).first()["d"]
        if not batch_id or first is None:
            return None
        old = sums.filter((F.col("batch_id") < batch_id) & (F.col("day") >= first - self.days - 1))
        return old.join(points.select("user_id").distinct(), "user_id", "left_semi")

    def table(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        """All batches of a table."""
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.base}/{name}")


def prepared(payloads: DataFrame, roster: DataFrame) -> DataFrame:
    """Rows of the payloads with role and productivity, as LiveBaselines takes them."""
    return ops.with_productivity(ops.with_user_role(ops.flatten_payload(payloads), roster))


def flush_summary(rows: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Five-second summaries per user.

    This and the other window streams emit closed windows in append mode; in update mode they emit every
    change, and the newest version of a window per key is complete when the input is.
    """
    return biometrics.flush_summary(rows.withWatermark("timestamp", delay))


def activity_counts(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Counts per user, five-minute window and activity type."""
    return rows.withWatermark("timestamp", delay).groupBy(
        "user", F.window("timestamp", "5 minutes").alias("w"), "activity_type"
    ).agg(F.count("*").alias("n")).select("user", F.col("w.start").alias("start"), "activity_type", "n")


def entropy_of_windows(counts: DataFrame) -> DataFrame:
    """Entropy per user and window from the counts of its activity types."""
    return counts.groupBy("user", "start").agg(F.greatest(
        F.lit(0.0), F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("activity_entropy"))


def sliding_baselines(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """Seven-day means per user, refreshed every day."""
    return rows.withWatermark("timestamp", delay).groupBy(
        "user_id", F.window("timestamp", "7 days", "1 day").alias("w")
    ).agg(*[F.avg(c).alias(n) for n, c in ops.MEASURES.items()]).select(
        "user_id", F.col("w.end").alias("as_of"), *ops.MEASURES)


def hourly_heat(scored: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Mean risk and count per user and hour, updated as rows arrive."""
    return scored.withWatermark("timestamp", delay).groupBy(
        "user_id", F.window("timestamp", "1 hour").alias("w")
    ).agg(F.avg("risk_score").alias("avg_risk"), F.count("*").alias("event_count")).select(
        "user_id", F.col("w.start").alias("start"), "avg_risk", "event_count")

"""Streams over activity events: scores from the last ten events, alerts, running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conductrisk import config as C
from conductrisk.functions import riskrules as R
from conductrisk.functions.common import after_hours
from conductrisk.operators.alerts import decide_events
from conductrisk.operators.buffers import event_risk, explained_events, proxy_score
from conductrisk.operators.ordered import HOT_ROWS, framed, limit_if_hot
from conductrisk.sources.readers import delete, exists
from conductrisk.streaming.state import KeyedState


class AlertDecisions:
    """A batch function that decides alerts over scored rows (id, user, date, risk_score) and keeps two values per user.

    Folders below `base`; a batch owns one folder in each and overwrites it when it is repeated:
      decided  the rows with should_alert and alert_severity
      users    the state of the users that occurred in the batch (streaming/state.py)
      work     tables that several steps of the batch read; they go when the next batch is done
    Rows of one batch are taken by time and id; a row that comes in a later batch is taken later, whatever its time.
    No step holds all rows of a user: hot users are cut, see `decide_events`.
    """

    out = "decided"

    def __init__(self, spark: SparkSession, base: str, hot_rows: int = HOT_ROWS, every: int = 16):
        self.spark, self.base, self.hot_rows = spark, base, hot_rows
        self.state = KeyedState(spark, f"{base}/users", "user", every)

    def _staged(self, batch_id: int):
        def write(df: DataFrame, name: str) -> DataFrame:
            path = f"{self.base}/work/{batch_id}/{name}"
            df.write.mode("overwrite").parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)
        return write

    def _opening(self, rows: DataFrame, batch_id: int) -> DataFrame | None:
        """The state of the users of this batch."""
        old = self.state.before(batch_id)
        if old is None:
            return None
        seen = rows.select(F.col("user").alias("__seen")).distinct()
        return old.join(seen, old["user"].eqNullSafe(seen["__seen"]), "left_semi")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        staged = self._staged(batch_id)
        rows = staged(batch.select("id", "user", "date", "risk_score"), "in")
        opening = self._opening(rows, batch_id)
        decided, closing = decide_events(rows, opening, self.hot_rows, staged)
        self._finish(decided, closing, batch_id)

    def _finish(self, decided: DataFrame, closing: DataFrame, batch_id: int) -> None:
        decided.write.mode("overwrite").parquet(f"{self.base}/{self.out}/batch_id={batch_id}")
        self.state.write(closing, batch_id)
        if exists(self.spark, f"{self.base}/work/{batch_id - 1}"):
            delete(self.spark, f"{self.base}/work/{batch_id - 1}")

    def table(self) -> DataFrame:
        """The rows of all batches with their batch_id."""
        return self.spark.read.parquet(f"{self.base}/{self.out}")


class EventScores(AlertDecisions):
    """A batch function that scores events (id, user, date, activity) with the user's last ten events and decides alerts.

    The state of a user is the flags of the last nine events and the alert state. It goes in front of the user's rows as a halo, so
    the windows of a batch are those of the batch form, cut for hot users in the same way. Folder `scored` has the rows with
    window_size, anomaly_score, risk_score, alert and explanation.
    """

    out = "scored"

    def __init__(self, spark: SparkSession, base: str, roster: DataFrame, hot_rows: int = HOT_ROWS, every: int = 16):
        super().__init__(spark, base, hot_rows, every)
        self.roster = roster

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        staged, depth = self._staged(batch_id), C.SEQUENCE_LENGTH - 1
        rows = staged(flagged(batch, self.roster), "in")
        opening = self._opening(rows, batch_id)
        opening = None if opening is None else staged(opening, "opening")
        marked = rows.withColumns({"__at": F.col("date"), "__old": F.lit(False)})
        if opening is not None:
            halo = opening.select("user", F.posexplode("tail").alias("__pos", "t")).select(
                "user", "t.is_odd", "t.is_copy", F.lit("").alias("id"), F.lit(True).alias("__old"),
                # before every event, in their order
                (F.lit("1000-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("__pos"))).alias("__at"))
            marked = marked.unionByName(halo, allowMissingColumns=True)
        frame = lambda w: w.rowsBetween(-depth, 0)
        build = lambda w: {"window_size": F.count("*").over(frame(w)), "__odd": F.count_if("is_odd").over(frame(w)),
                           "__copies": F.count_if("is_copy").over(frame(w))}
        windows = framed(marked, ["user"], "__at", "id", depth, build, limit_if_hot(rows, ["user"], self.hot_rows)).filter("not __old")
        score = proxy_score(F.col("window_size"), F.col("__odd"), F.col("__copies"))
        scored = windows.withColumn("anomaly_score", score).select(
            "id", "user", "date", "role", "activity", "window_size", "anomaly_score",
            event_risk(F.col("anomaly_score"), F.col("role_factor")).alias("risk_score"))
        decided, closing = decide_events(scored, opening, self.hot_rows, staged)
        # Spark keeps nine rows per user in every task before the shuffle
        newest = Window.partitionBy("user").orderBy(F.desc("__at"), F.desc("id"))
        tails = marked.withColumn("__rn", F.row_number().over(newest)).filter(F.col("__rn") <= depth).groupBy("user").agg(
            F.sort_array(F.collect_list(F.struct("__at", "id", "is_odd", "is_copy"))).alias("tail")).select(
            F.col("user").alias("__u"), F.transform("tail", lambda t: F.struct(t["is_odd"].alias("is_odd"), t["is_copy"].alias("is_copy"))).alias("tail"))
        state = closing.join(tails, closing["user"].eqNullSafe(tails["__u"])).select("user", "hits", "last", "tail")
        self._finish(explained_events(decided), state, batch_id)


def flagged(activity: DataFrame, roster: DataFrame) -> DataFrame:
    """Events with the flags of the window and the factor of the user's role."""
    return activity.join(roster.select("user", "role"), "user", "left").select(
        "id", "user", "date", F.coalesce("role", F.lit("Employee")).alias("role"), "activity",
        after_hours(F.hour("date"), closed=True).alias("is_odd"),
        F.col("activity").contains("Copy").alias("is_copy"),
    ).withColumn("role_factor", R.role_multiplier(F.col("role")))


def running_totals(scored: DataFrame, delay: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Events, high-risk events and alerts per time window."""
    return scored.withWatermark("date", delay).groupBy(F.window("date", size).alias("w")).agg(
        F.count("*").alias("events"), F.count_if(F.col("risk_score") > 50).alias("high_risk"),
        F.count_if("should_alert").alias("alerts"),
    ).select(F.col("w.start").alias("start"), "events", "high_risk", "alerts")


def without_duplicates(activity: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop repeated ids that arrive within the delay of each other."""
    return activity.withWatermark("date", delay).dropDuplicatesWithinWatermark(["id"])

"""Alert decisions with persistence and cooldown."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conductrisk import config as C
from conductrisk.functions.riskrules import alert_severity
from conductrisk.operators.ordered import HOT_ROWS, framed, limit_if_hot, previous, sliced
from conductrisk.session import stage

COOLDOWN_MICROS = C.ALERT_COOLDOWN_HOURS * 3600 * 10**6
STATE = "struct<hits int, last timestamp, out array<struct<date timestamp, id string, fired boolean>>>"


def _step(state: Column, row: Column) -> Column:
    """One row of the ordered fold.

    Below the alert line the hit count resets. In the cooldown anything but CRITICAL is silent
    and leaves the count alone. Otherwise the hit counts, and the second one fires.
    """
    risk, date = row["risk_score"], row["date"]
    low = risk < C.ALERT_MEDIUM
    cooling = (F.unix_micros(date) - F.unix_micros(state["last"])) < C.ALERT_COOLDOWN_HOURS * 3600 * 10**6
    silent = F.coalesce(cooling, F.lit(False)) & (risk < C.ALERT_CRITICAL)
    hits = state["hits"] + 1
    fired = ~low & ~silent & (hits >= C.ALERT_PERSISTENCE)
    next_hits = F.when(low, 0).when(silent, state["hits"]).when(fired, 0).otherwise(hits)
    return F.struct(
        next_hits.cast("int").alias("hits"),
        F.when(fired, date).otherwise(state["last"]).alias("last"),
        F.concat(state["out"], F.array(F.struct(date.alias("date"), row["id"].alias("id"), fired.alias("fired")))).alias("out"),
    )


def _fold(daily: DataFrame) -> DataFrame:
    """Final state and all decisions per user. A user has one row per day, so the array is as
    long as the days of history."""
    rows = F.sort_array(F.collect_list(F.struct("date", "id", "risk_score")))
    start = F.struct(
        F.lit(0).alias("hits"), F.lit(None).cast("timestamp").alias("last"),
        F.array().cast("array<struct<date timestamp, id string, fired boolean>>").alias("out"),
    ).cast(STATE)
    return daily.groupBy("user").agg(rows.alias("rows")).select(
        "user", F.aggregate("rows", start, lambda s, r: _step(s, r).cast(STATE)).alias("state")
    )


def decide(daily: DataFrame) -> DataFrame:
    """Add should_alert and alert_severity to daily rows with user, date, id and risk_score."""
    decisions = _fold(daily).select("user", F.explode("state.out").alias("o")).select(
        "user", F.col("o.date").alias("date"), F.col("o.id").alias("id"), F.col("o.fired").alias("should_alert")
    )
    joined = daily.join(decisions, ["user", "date", "id"])
    return joined.withColumn(
        "alert_severity", F.when(F.col("should_alert"), alert_severity(F.col("risk_score"))).otherwise("")
    )


def alert_state_stats(daily: DataFrame) -> DataFrame:
    """How many users hold an open warning, and how many have alerted."""
    return _fold(daily).agg(
        F.count_if(F.col("state.hits") > 0).alias("users_in_warning"),
        F.count_if(F.col("state.last").isNotNull()).alias("users_in_cooldown"),
    )


# --- events: many rows per user ---------------------------------------------------------------------------
def alert_step(hits: int, last, risk: float | None, at, cooldown=dt.timedelta(hours=C.ALERT_COOLDOWN_HOURS)) -> tuple[int, object, bool]:
    """One step of the alert rule: (hits, last alert, fired). Times and cooldown are of one unit. No score counts as low."""
    if risk is None or not risk >= C.ALERT_MEDIUM:
        return 0, last, False
    if last is not None and at - last < cooldown and risk < C.ALERT_CRITICAL:
        return hits, last, False
    if hits + 1 >= C.ALERT_PERSISTENCE:
        return 0, at, True
    return hits + 1, last, False


def _fold_in_order(batches, names: list[str]):
    """The alert rule over Arrow batches that come sorted by user, part and time.

    Only the state of the current user is held, whatever the number of its rows. The first part of a user starts from the
    user's opening state, every later one from an empty state.
    """
    import pyarrow as pa

    key, hits, last, seq = None, 0, None, 0
    for batch in batches:
        fired_of, hits_of, seq_of = [], [], []
        column = lambda n: batch.column(batch.schema.get_field_index(n))
        for user, part, at, risk, hits0, last0 in zip(*[column(n).to_pylist() for n in (
                "user", "__part", "__micros", "risk_score", "__hits0", "__last0")]):
            if key != (user, part):
                key, seq = (user, part), 0
                hits, last = (hits0, last0) if part == 0 else (0, None)
            hits, last, fired = alert_step(hits, last, risk, at, COOLDOWN_MICROS)
            seq += 1
            fired_of.append(fired)
            hits_of.append(hits)
            seq_of.append(seq)
        yield pa.RecordBatch.from_arrays(
            [column(n) for n in names] + [pa.array(fired_of, pa.bool_()), pa.array(hits_of, pa.int32()), pa.array(seq_of, pa.int64())],
            names=[*names, "__fired", "__hits", "__seq"])


def decide_events(rows: DataFrame, opening: DataFrame | None = None, hot_rows: int = HOT_ROWS,
                  staged: Callable[[DataFrame, str], DataFrame] = stage) -> tuple[DataFrame, DataFrame]:
    """Alert decisions over event rows (user, date, id, risk_score, ..), where one user may own a large part of them.

    `opening` holds the state of earlier rows (user, hits, last). Returns the rows with should_alert and alert_severity, and the
    closing state of every user that occurs. A score that is null or NaN counts as low; rows without a user are a user of their own.

    Only rows that can change the state are folded: a low row after a low row is left out before the shuffle. A row that
    follows a low row, with no row above the line in the cooldown before it, finds an empty state whatever came earlier; hot users
    are cut at such rows, about one for every `hot_rows` rows. The fold reads its rows in order and holds one state.
    """
    names, hot_rows = rows.columns, limit_if_hot(rows, ["user"], hot_rows)
    none = F.lit(None).cast("long")
    if opening is None:
        known = rows.withColumns({"__hits0": F.lit(0), "__last0": none})
    else:
        o = opening.select(F.col("user").alias("__u"), F.col("hits").alias("__h"), F.unix_micros("last").alias("__last0"))
        known = rows.join(o, rows["user"].eqNullSafe(o["__u"]), "left").withColumn("__hits0", F.coalesce("__h", F.lit(0))).drop("__u", "__h")
    known = known.withColumns({
        "__low": F.coalesce(F.isnan("risk_score") | (F.col("risk_score") < C.ALERT_MEDIUM), F.lit(True)), "__micros": F.unix_micros("date")})
    ordered = staged(previous(known, ["user"], "date", "id", {"__before": "__low"}, hot_rows), "ordered")
    repeated = F.col("__low") & F.coalesce("__before", F.lit(False))
    build = lambda w: {"__low1": F.lag("__low").over(w), "__micros2": F.lag("__micros", 2).over(w)}
    kept = framed(ordered.filter(~repeated).drop("__before"), ["user"], "date", "id", 2, build, hot_rows)
    over = lambda since: F.col("__micros") - F.col(since) >= COOLDOWN_MICROS
    # the row two before is the last one above the line, as a low row stays only behind such a row
    empty = ~F.col("__low") & F.col("__low1") & over("__micros2") & (F.col("__last0").isNull() | over("__last0"))
    place = F.struct("__micros", "id")
    kept = sliced(kept.withColumn("__empty", F.coalesce(empty, F.lit(False))), ["user"], "date", hot_rows)
    if hot_rows is None:
        parts = kept.withColumn("__part", F.lit(0))
    else:
        starts = kept.filter("__hot and __empty").groupBy("user", "__slice").agg(F.min(place).alias("s")).groupBy("user").agg(
            F.collect_list("s").alias("__starts"))
        parts = kept.join(F.broadcast(starts), "user", "left").withColumn(
            "__part", F.coalesce(F.size(F.filter("__starts", lambda s: s <= place)), F.lit(0)))
    carried = [*names, "__part", "__last0"]
    sorted_rows = parts.select(*carried, "__micros", "__hits0").repartition("user", "__part").sortWithinPartitions(
        "user", "__part", "__micros", "id")
    schema = T.StructType([*sorted_rows.select(*carried).schema.fields, T.StructField("__fired", T.BooleanType()),
                           T.StructField("__hits", T.IntegerType()), T.StructField("__seq", T.LongType())])
    folded = staged(sorted_rows.mapInArrow(lambda batches: _fold_in_order(batches, carried), schema), "folded")
    level = F.when(F.col("__fired"), alert_severity(F.col("risk_score"))).otherwise("")
    decided = folded.select(*names, F.col("__fired").alias("should_alert"), level.alias("alert_severity")).unionByName(
        ordered.filter(repeated).select(*names, F.lit(False).alias("should_alert"), F.lit("").alias("alert_severity")))
    closing = folded.groupBy("user").agg(
        F.max_by("__hits", F.struct("__part", "__seq")).alias("hits"),
        F.timestamp_micros(F.greatest(F.max("__last0"), F.max(F.when(F.col("__fired"), F.unix_micros("date"))))).alias("last"))
    return decided, closing

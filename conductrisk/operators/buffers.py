"""The last ten events of a user and the anomaly proxy they give (batch form)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conductrisk import config as C
from conductrisk.functions import riskrules as R
from conductrisk.functions.common import after_hours
from conductrisk.operators.ordered import framed


def proxy_score(size: Column, odd: Column, copies: Column) -> Column:
    """Burst, after-hours share and copy spike of a window; 0 below two events."""
    score = (
        F.least(F.lit(0.3), size / 30) + ratio_of(odd, size) * 0.2
        + F.least(F.lit(1.0), copies / 5) * 0.3
    )
    return F.when(size < 2, 0.0).otherwise(score)


def ratio_of(a: Column, b: Column) -> Column:
    return a / F.greatest(F.lit(1), b)


def buffered_scores(activity: DataFrame, length: int = C.SEQUENCE_LENGTH) -> DataFrame:
    """Add window_size and anomaly_score from the user's trailing events."""
    odd = after_hours(F.hour("date"), closed=True)
    build = lambda w: {
        "window_size": F.count("*").over(w.rowsBetween(-(length - 1), 0)),
        "__odd": F.count_if(odd).over(w.rowsBetween(-(length - 1), 0)),
        "__copies": F.count_if(F.col("activity").contains("Copy")).over(w.rowsBetween(-(length - 1), 0)),
    }
    rows = framed(activity, ["user"], "date", "id", length - 1, build)
    return rows.withColumn("anomaly_score", proxy_score(F.col("window_size"), F.col("__odd"), F.col("__copies"))).drop("__odd", "__copies")


def event_risk(score: Column, role_factor: Column) -> Column:
    """Risk of a single event: without metadata and counts only the role matters."""
    none = F.lit(None).cast("double")
    return F.least(F.lit(C.MAX_RISK), R.base_risk(score, none, none, none) * role_factor)


def explained_events(rows: DataFrame) -> DataFrame:
    """Add the explanation text to event rows with anomaly_score, role and risk_score."""
    none = F.lit(None).cast("double")
    base = R.base_risk(F.col("anomaly_score"), none, none, none)
    factor = R.role_multiplier(F.col("role"))
    never = F.lit(False)
    zero = F.lit(0)
    counts = {"copies": zero, "usb": zero, "removable": zero, "ah_ratio": F.lit(0.0), "ah_count": zero}
    defaults = {n: F.lit(v) for n, v in R.INTEGRITY_DEFAULTS.items() if n not in rows.columns}
    rows = rows.withColumns(defaults)
    factors = R.factor_list(base, F.col("anomaly_score"), F.col("role"), factor, never, counts, F.lit(1.0),
                            F.lit(None).cast("string"), F.lit(1.0), never)
    no_tactic = F.lit(None).cast("struct<tactic string, tactic_name string, technique string, technique_name string>")
    return rows.withColumn("factors", factors).withColumn(
        "explanation", R.explanation(F.col("risk_score"), F.col("factors"), no_tactic)
    ).withColumn("mitre_tactic", F.lit("")).drop(*defaults)

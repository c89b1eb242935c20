"""Explained daily risk scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conductrisk.functions import riskrules as R
from conductrisk.functions.common import with_defaults


def score_daily(df: DataFrame, role: str = "role", model: str = "sequence") -> DataFrame:
    """Score daily rows that carry `anomaly_score`, the counts and the model metadata.

    Adds base_risk, the multipliers, risk_score, factors, primary_factor, tactic columns,
    alert_severity and explanation. Missing telemetry features take neutral defaults.
    """
    df = with_defaults(df, R.INTEGRITY_DEFAULTS)
    extra = [c for c in R.INTEGRITY_DEFAULTS]
    role_col = F.coalesce(F.nullif(F.col(role), F.lit("Unknown")), F.lit("Employee"))
    copies, usb = F.col("file_copy_count"), F.col("usb_count")
    removable, deletes = F.col("removable_media_count"), F.col("delete_count")
    ah_ratio, ah_count = F.col("after_hours_ratio"), F.col("after_hours_count")
    score = F.col("anomaly_score")

    act_mult, act_reason = R.activity_multiplier(copies, usb, deletes)
    df = df.withColumns({
        "base_risk": R.base_risk(score, F.col("error_mean"), F.col("error_std"), F.col("threshold"), model),
        "role_multiplier": R.role_multiplier(role_col),
        "is_after_hours_day": R.is_after_hours_day(ah_ratio, ah_count),
        "activity_multiplier": act_mult,
        "activity_reason": act_reason,
        "integrity_multiplier": R.integrity_multiplier(),
    })
    ah_day = F.col("is_after_hours_day")
    df = df.withColumns({
        "time_multiplier": F.when(ah_day, R.C.AFTER_HOURS_MULTIPLIER).otherwise(1.0),
        "behaviour_multiplier": R.behaviour_boost(copies, usb, removable, ah_day),
        "is_pattern": R.is_pattern(copies, usb, ah_day),
        "tactic_entry": R.tactic(copies, usb, deletes, ah_day),
    })
    product = (
        F.col("base_risk") * F.col("role_multiplier") * F.col("time_multiplier")
        * F.col("activity_multiplier") * F.col("behaviour_multiplier")
        * F.greatest(F.lit(1.0), F.col("integrity_multiplier"))
    )
    counts = {"copies": copies, "usb": usb, "removable": removable, "ah_ratio": ah_ratio, "ah_count": ah_count}
    df = df.withColumns({
        "risk_score": R.final_risk(product, F.col("is_pattern")),
        "factors": R.factor_list(
            F.col("base_risk"), score, role_col, F.col("role_multiplier"), ah_day, counts,
            F.col("activity_multiplier"), F.col("activity_reason"), F.col("integrity_multiplier"),
            F.col("is_pattern"),
        ),
    })
    return df.withColumns({
        "primary_factor": R.primary_factor(F.col("factors")),
        "mitre_tactic": F.coalesce(F.col("tactic_entry.tactic"), F.lit("")),
        "mitre_technique": F.coalesce(F.col("tactic_entry.technique"), F.lit("")),
        "alert_level": R.alert_severity(F.col("risk_score")),
        "explanation": R.explanation(F.col("risk_score"), F.col("factors"), F.col("tactic_entry")),
    }).drop("tactic_entry", "activity_reason", *extra)

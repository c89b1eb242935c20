"""Rules that turn an anomaly score and the day's counts into an explained 0-100 risk.

All builders return columns, so a whole score is one projection with generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from conductrisk import config as C
from conductrisk.functions.common import clamp, half_even, lookup, percent_text


def base_risk(score: Column, mean: Column, std: Column, threshold: Column,
              model: str = "sequence") -> Column:
    """0-100 from an anomaly score, relative to the error distribution of the user's model.

    The role threshold maps to a moderate base, the slope goes on beyond it. Without a usable
    threshold a z-score is used, and without any metadata a fixed line.
    """
    if model == "baseline":
        return F.when(score < 0, F.least(F.lit(C.MAX_RISK), F.abs(score) * C.BASELINE_MODEL_SLOPE)).otherwise(0.0)
    span = threshold - mean
    fixed = F.least(F.lit(C.MAX_RISK), F.greatest(F.lit(0.0), score - C.ANOMALY_MEAN) * C.BASE_MULTIPLIER)
    return (
        F.when(span > 1e-6, clamp((score - mean) / span * C.THRESHOLD_BASE_RISK, 0, C.MAX_RISK))
        .when(std > 1e-6, clamp((score - mean) / std * C.Z_SCORE_SLOPE, 0, C.MAX_RISK))
        .otherwise(fixed)
    )


def role_multiplier(role: Column) -> Column:
    return lookup(role, C.ROLE_MULTIPLIERS, 1.0)


def is_after_hours_day(ah_ratio: Column, ah_count: Column) -> Column:
    """High after-hours share, gated by volume."""
    return (ah_ratio > C.AFTER_HOURS_RATIO) & (ah_count >= C.AFTER_HOURS_MIN_EVENTS)


def activity_multiplier(copies: Column, usb: Column, deletes: Column) -> tuple[Column, Column]:
    """(multiplier, activity behind it): the strongest activity that happened."""
    m = C.ACTIVITY_MULTIPLIERS
    factor = (
        F.when(copies > 0, m["File Copy"]).when(usb > 0, m["Connect"])
        .when(deletes > 0, m["File Delete"]).otherwise(1.0)
    )
    reason = F.when(copies > 0, "File Copy").when(usb > 0, "Connect").when(deletes > 0, "File Delete")
    return factor, reason


def _times(*pairs) -> Column:
    """Product of the factors whose condition holds."""
    out = F.lit(1.0)
    for condition, factor in pairs:
        out = out * F.when(condition, F.lit(float(factor))).otherwise(1.0)
    return out


def behaviour_boost(copies: Column, usb: Column, removable: Column, ah_day: Column) -> Column:
    return _times(
        (usb > 0, C.USB_BOOST), (removable > 0, C.REMOVABLE_BOOST),
        (copies > C.COPY_VOLUME, C.COPY_VOLUME_BOOST), (ah_day, C.AFTER_HOURS_BOOST),
    )


INTEGRITY_DEFAULTS = {
    "productive_app_ratio": 1.0, "file_op_velocity": 0.0, "baseline_file_velocity": 1.0,
    "entropy_risk_level": "Low", "mouse_tortuosity_index": 1.0, "keystroke_anomaly_score": 0.0,
}


def _integrity_conditions():
    velocity = (F.col("baseline_file_velocity") > 0) & (
        F.col("file_op_velocity") > F.col("baseline_file_velocity") * 5
    )
    return {
        "unproductive": F.col("productive_app_ratio") < 0.5,
        "velocity": velocity,
        "critical": F.col("entropy_risk_level") == "Critical",
        "high": F.col("entropy_risk_level") == "High",
        "medium": F.col("entropy_risk_level") == "Medium",
        "mouse": F.col("mouse_tortuosity_index") > C.TORTUOSITY_LIMIT,
        "keys": F.col("keystroke_anomaly_score") > C.KEYSTROKE_LIMIT,
    }


def integrity_multiplier() -> Column:
    """Work-integrity factor from the telemetry features (see INTEGRITY_DEFAULTS)."""
    c = _integrity_conditions()
    return _times(
        (c["unproductive"], C.PRODUCTIVITY_PENALTY), (c["velocity"], C.VELOCITY_MULTIPLIER),
        (c["critical"], C.ENTROPY_CRITICAL_MULTIPLIER), (c["high"], C.ENTROPY_HIGH_MULTIPLIER),
        (c["medium"], C.ENTROPY_MEDIUM_MULTIPLIER), (c["mouse"], 1.3), (c["keys"], 1.3),
    )


def integrity_factors() -> list[Column]:
    c = _integrity_conditions()
    return [
        F.when(c["unproductive"], F.concat(
            F.lit("Low productivity ratio ("), percent_text(F.col("productive_app_ratio")), F.lit(")"))),
        F.when(c["velocity"], F.concat(
            F.lit("Anomalous file velocity ("), half_even(F.col("file_op_velocity"), 1), F.lit("x baseline)"))),
        F.when(c["critical"] | c["high"], F.format_string(
            "High session entropy (%s)", F.col("entropy_risk_level"))),
        F.when(c["mouse"], F.concat(
            F.lit("Erratic mouse pattern (tortuosity="), half_even(F.col("mouse_tortuosity_index"), 1), F.lit(")"))),
        F.when(c["keys"], F.concat(
            F.lit("Abnormal keystroke rhythm (anomaly="), half_even(F.col("keystroke_anomaly_score"), 2), F.lit(")"))),
    ]


def is_pattern(copies: Column, usb: Column, ah_day: Column) -> Column:
    return (copies > 0) & (usb > 0) & ah_day


def final_risk(product: Column, pattern: Column) -> Column:
    floored = F.when(pattern, F.greatest(product, F.lit(C.PATTERN_FLOOR))).otherwise(product)
    return F.least(F.lit(C.MAX_RISK), floored)


def tactic(copies: Column, usb: Column, deletes: Column, ah_day: Column) -> Column:
    """Struct(tactic, tactic_name, technique, technique_name); null where nothing applies."""
    def entry(name):
        names = ("tactic", "tactic_name", "technique", "technique_name")
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, C.TACTICS[name])])

    return (
        F.when(copies > 0, entry("File Copy")).when(usb > 0, entry("Connect"))
        .when(deletes > 0, entry("File Delete")).when(ah_day, entry("After Hours Logon"))
    )


def _plus(factor: Column) -> Column:
    """'+50%' for 1.5."""
    return F.concat(F.lit("+"), ((factor - 1) * 100).cast("int"), F.lit("%"))


def factor_list(base: Column, score: Column, role: Column, role_mult: Column, ah_day: Column,
                counts: dict[str, Column], act_mult: Column, act_reason: Column,
                integrity: Column, pattern: Column) -> Column:
    """Array of the reasons that raised the risk, in the order they are applied."""
    copies, usb, removable = counts["copies"], counts["usb"], counts["removable"]
    ah_ratio, ah_count = counts["ah_ratio"], counts["ah_count"]
    n = lambda c: c.cast("bigint")
    parts = [
        F.when(base > 10, F.concat(
            F.lit("Anomaly score "), half_even(score, 3), F.lit(" (role-normalised)"))),
        F.when(role_mult > 1, F.concat(role, F.lit(" role ("), _plus(role_mult), F.lit(")"))),
        F.when(ah_day, F.concat(F.lit("After-hours activity pattern ("), percent_text(ah_ratio),
                                F.lit(", "), n(ah_count), F.lit(" events)"))),
        F.when(act_mult > 1, F.concat(act_reason, F.lit(" activity ("), _plus(act_mult), F.lit(")"))),
        F.when(usb > 0, F.concat(F.lit("USB connect activity ("), n(usb), F.lit(" events)"))),
        F.when(removable > 0, F.concat(F.lit("Removable-media writes ("), n(removable), F.lit(" files)"))),
        F.when(copies > C.COPY_VOLUME, F.concat(F.lit("High file-copy volume ("), n(copies), F.lit(" files)"))),
        F.when(ah_day, F.concat(F.lit("Elevated after-hours ratio ("), percent_text(ah_ratio), F.lit(")"))),
        *[F.when(integrity > 1, f) for f in integrity_factors()],
        F.when(pattern, F.lit("PATTERN: File copy + USB + After-hours exfil")),
    ]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def primary_factor(factors: Column) -> Column:
    return F.coalesce(F.try_element_at(factors, F.lit(1)), F.lit("Normal activity"))


def explanation(risk: Column, factors: Column, tactic_struct: Column) -> Column:
    top = F.array_join(F.slice(factors, 1, 3), "; ")
    text = F.concat(
        F.lit("Risk score "), half_even(risk), F.lit("/100. "),
        F.when(F.size(factors) > 0, F.concat(F.lit("Contributing factors: "), top, F.lit(". "))).otherwise(""),
        F.when(tactic_struct.isNotNull(), F.concat(
            F.lit("Maps to MITRE "), tactic_struct["tactic"], F.lit(" - "),
            tactic_struct["tactic_name"], F.lit("."))).otherwise(""),
    )
    return F.when(risk < 50, F.lit("Low risk - normal activity pattern.")).otherwise(text)


def alert_severity(risk: Column) -> Column:
    """MEDIUM, HIGH or CRITICAL; empty below the alert line."""
    return (
        F.when(risk >= C.ALERT_CRITICAL, "CRITICAL").when(risk >= C.ALERT_HIGH, "HIGH")
        .when(risk >= C.ALERT_MEDIUM, "MEDIUM").otherwise("")
    )


def live_severity(risk: Column) -> Column:
    return F.when(risk >= 80, "Critical").when(risk >= 60, "High").otherwise("Medium")


def alert_id(row_id: Column) -> Column:
    return F.format_string("ALT-%05d", row_id)


def alert_text(app: Column, window: Column) -> Column:
    name, title = F.coalesce(F.nullif(app, F.lit("")), F.lit("unknown")), F.coalesce(window, F.lit(""))
    tail = F.when((title != "") & (title != name), F.concat(F.lit(" — "), title)).otherwise("")
    return F.concat(F.lit("Anomalous behaviour detected in "), name, tail)

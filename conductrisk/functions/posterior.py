"""Beta posterior of the risk of one event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from conductrisk import config as C
from conductrisk.functions.common import after_hours, clamp, lookup


def anomaly_likelihood(score: Column, model: str = "sequence") -> Column:
    if model != "sequence":
        return score + 1.0
    low = score / C.ANOMALY_MEAN * 0.7 + 0.3
    high = F.least(F.lit(3.0), (score - C.ANOMALY_MEAN) / C.ANOMALY_STD * 2.0 + 1.0)
    return F.when(score < C.ANOMALY_MEAN, low).otherwise(high)


def time_factor(hour: Column, weekday: Column) -> Column:
    t = C.TIME_LIKELIHOODS
    return (
        F.when(after_hours(hour, closed=True), t["after_hours"])
        .when(weekday >= 5, t["weekend"]).otherwise(t["normal"])
    )


def activity_factor(activity: Column) -> Column:
    """First known name that the activity contains."""
    out = F.lit(1.0)
    for name, factor in C.ACTIVITY_LIKELIHOODS[::-1]:
        out = F.when(activity.contains(name), factor).otherwise(out)
    return out


def behaviour_evidence(usb_7d: Column, velocity: Column, base_velocity: Column, ah_ratio: Column) -> Column:
    speed = F.try_divide(velocity, base_velocity)
    return F.least(
        F.lit(3.0),
        F.lit(1.0)
        + F.when(usb_7d > 3, F.least(F.lit(2.0), usb_7d / 3) * 0.25).otherwise(0.0)
        + F.when((base_velocity > 0) & (speed > 2), F.least(F.lit(1.5), speed / 2) * 0.20).otherwise(0.0)
        + F.when(ah_ratio > 0.3, ah_ratio / 0.3 * 0.15).otherwise(0.0),
    )


def integrity_evidence(productive: Column, entropy_level: Column, tortuosity: Column, keys: Column) -> Column:
    base = F.lit(1.0) + F.when(productive < 0.5, (F.lit(0.5) - productive) / 0.5 * 0.3).otherwise(0.0)
    level = F.when(entropy_level == "Critical", 1.5).when(entropy_level == "High", 1.3).otherwise(1.0)
    biometric = F.when((tortuosity > 3) | (keys > 0.5), 1.2).otherwise(1.0)
    return F.least(F.lit(3.0), base * level * biometric)


def beta_parameters(role: Column, evidence: Column) -> tuple[Column, Column]:
    alpha = lookup(role, {r: p[0] for r, p in C.ROLE_PRIORS.items()}, C.DEFAULT_PRIOR[0])
    beta = lookup(role, {r: p[1] for r, p in C.ROLE_PRIORS.items()}, C.DEFAULT_PRIOR[1])
    one = F.lit(1.0)
    return F.greatest(one, alpha * evidence), F.greatest(one, beta * (F.lit(2.0) - evidence))


def combined_evidence(parts: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for name, weight in C.EVIDENCE_WEIGHTS.items():
        out = out + parts[name] * weight
    return out


def beta_mean(alpha: Column, beta: Column) -> Column:
    return alpha / (alpha + beta) * 100


def beta_std(alpha: Column, beta: Column) -> Column:
    total = alpha + beta
    return F.sqrt(alpha * beta / (total * total * (total + 1))) * 100


def confidence(score: Column, *required: Column) -> Column:
    missing = sum((F.when(c.isNull(), 0.1).otherwise(0.0) for c in required), F.lit(0.0))
    return clamp(F.lit(0.8) - missing - F.when(F.isnan(score), 0.2).otherwise(0.0), 0.1, 1.0)

"""Rules for live telemetry: productivity, signature deviation, role-weighted live risk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from conductrisk import config as C
from conductrisk.functions.common import after_hours, clamp, contains_any, lookup


def _permitted(app: Column, role: Column, table: dict[str, list[str]]) -> Column:
    out = F.lit(False)
    for name, apps in table.items():
        out = F.when(role == name, contains_any(app, apps)).otherwise(out)
    return out


def productivity(app: Column, role: Column, low: Column | None = None) -> Column:
    """Struct(score, category, text) of how well an application fits the role.

    `low` is the lower-case application where a column holds it; an expression would be evaluated again for every word.
    """
    low = F.lower(app) if low is None else low
    classes = [
        (_permitted(low, role, C.ROLE_APPS) | contains_any(low, C.PRODUCTIVE_APPS), 1.0, "productive", C.PRODUCTIVITY_TEXTS["permitted"]),
        (contains_any(low, C.NEUTRAL_APPS), 0.7, "neutral", C.PRODUCTIVITY_TEXTS["neutral"]),
        (contains_any(low, C.DISTRACTED_APPS), 0.2, "distracted", C.PRODUCTIVITY_TEXTS["distracted"]),
    ]
    make = lambda s, c, t: F.struct(
        F.lit(s).alias("score"), F.lit(c).alias("category"), F.concat(F.lit(t), app).alias("text"))
    out = make(0.5, "neutral", C.PRODUCTIVITY_TEXTS["unknown"])
    for condition, score, category, text in classes[::-1]:
        out = F.when(condition, make(score, category, text)).otherwise(out)
    return out


def deviation(velocity: Column, flight: Column, base: dict[str, Column], has_baseline: Column) -> Column:
    """Struct(score, sigma, text): mean of two z-scores against the user's own baseline."""
    z_mouse = F.abs(velocity - base["mv_avg"]) / (base["mv_std"] + 1e-6)
    z_keys = F.abs(flight - base["kf_avg"]) / (base["kf_std"] + 1e-6)
    z = (z_mouse + z_keys) / 2
    sigma = F.when(z > 3, 3.0).when(z > 2, 2.0).when(z > 1.5, 1.5).otherwise(z)
    text = (
        F.when(z > 3, C.DEVIATION_TEXTS["critical"])
        .when(z > 2, C.DEVIATION_TEXTS["high"])
        .when(z > 1.5, C.DEVIATION_TEXTS["moderate"])
        .otherwise(C.DEVIATION_TEXTS["normal"])
    )
    return F.when(
        has_baseline,
        F.struct(F.least(F.lit(1.0), z / 3).alias("score"), sigma.alias("sigma"), text.alias("text")),
    ).otherwise(F.struct(
        F.lit(0.0).alias("score"), F.lit(0.0).alias("sigma"), F.lit(C.DEVIATION_TEXTS["no_baseline"]).alias("text")))


def clock(ts: Column) -> tuple[Column, Column]:
    """Hour and weekend; the rules below take them as columns, if these exist, instead of working them out for every condition."""
    return F.hour(ts), F.weekday(ts) >= 5


def integrity_multiplier(productivity_score: Column, sigma: Column, ts: Column, at: tuple[Column, Column] | None = None) -> Column:
    hour, weekend = at or clock(ts)
    product = (
        F.when(productivity_score < 0.5, 1.5).when(productivity_score < 0.7, 1.2).otherwise(1.0)
        * F.when(sigma > 2, 2.0).when(sigma > 1.5, 1.5).when(sigma > 1, 1.2).otherwise(1.0)
        * F.when(after_hours(hour, closed=True), 1.3).otherwise(1.0)
        * F.when(weekend, 1.2).otherwise(1.0)
    )
    return F.least(product, F.lit(5.0))


def time_multiplier(ts: Column, at: tuple[Column, Column] | None = None) -> Column:
    """Night, early morning, evening, weekend, work time: tested in this order."""
    hour, weekend = at or clock(ts)
    return (
        F.when((hour >= 22) | (hour < 6), 2.5).when(hour < 9, 1.5).when(hour >= 17, 1.8)
        .when(weekend, 2.0).otherwise(1.0)
    )


def live_components(app: Column, role: Column, velocity: Column, flight: Column,
                    base: dict[str, Column], has_baseline: Column, ts: Column, low: Column | None = None,
                    at: tuple[Column, Column] | None = None) -> dict[str, Column]:
    """The four 0-100 components of the role-weighted live risk."""
    low, (hour, weekend) = F.lower(app) if low is None else low, at or clock(ts)
    z = (
        F.abs(velocity - base["mv_avg"]) / (base["mv_std"] + 1)
        + F.abs(flight - base["kf_avg"]) / (base["kf_std"] + 1)
    ) / 2
    return {
        "productivity": (
            F.when(_permitted(low, role, C.LIVE_ROLE_APPS), 0.0)
            .when(contains_any(low, C.LIVE_PRODUCTIVE_APPS), 10.0)
            .when(contains_any(low, C.LIVE_DISTRACTED_APPS), 80.0).otherwise(40.0)
        ),
        "behaviour": (
            F.when(~has_baseline, 20.0).when(z < 1, 10.0).when(z < 2, 40.0).when(z < 3, 70.0)
            .otherwise(90.0)
        ),
        "entropy": F.lit(20.0),
        "context": (
            F.when(after_hours(hour, 6, 22, closed=True), 60.0)
            .when(weekend, 40.0).otherwise(10.0)
        ),
    }


def live_risk(components: dict[str, Column], role: Column, ts: Column, at: tuple[Column, Column] | None = None) -> Column:
    total = F.lit(0.0)
    for name, value in components.items():
        weights = {r: p[name] for r, p in C.ROLE_PROFILES.items()}
        total = total + value * lookup(role, weights, C.ROLE_PROFILES["Employee"][name])
    return clamp(total * time_multiplier(ts, at), 0, 100)


def live_factors(components: dict[str, Column]) -> Column:
    return F.filter(
        F.array(*[F.when(components[n] > 50, F.lit(t)) for n, t in C.LIVE_FACTOR_TEXTS.items()]),
        lambda x: x.isNotNull(),
    )


def app_tactic(app: Column, low: Column | None = None) -> Column:
    """Struct(tactic, technique) of the first keyword list that matches the application."""
    low = F.coalesce(F.lower(app) if low is None else low, F.lit(""))
    out = F.lit(None).cast("struct<tactic string, technique string>")
    for words, tactic, technique in C.APP_TACTICS[::-1]:
        pair = F.struct(F.lit(tactic).alias("tactic"), F.lit(technique).alias("technique"))
        out = F.when(contains_any(low, words), pair).otherwise(out)
    return out


def live_tactic(app: Column, risk: Column, hour: Column, low: Column | None = None) -> Column:
    """By application first, then by context."""
    pair = lambda a, b: F.struct(F.lit(a).alias("tactic"), F.lit(b).alias("technique"))
    return F.coalesce(
        app_tactic(app, low),
        F.when(after_hours(hour, 8, 20, closed=True) & (risk >= 60), pair("TA0003", "T1078"))
        .when(risk >= 80, pair("TA0009", "T1119")),
    )

"""Entropy of activity: sessions, composite entropy, role baselines, percentile ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conductrisk import config as C
from conductrisk.functions.common import clamp, lookup
from conductrisk.operators.ordered import cumulative, previous

SESSION_SECONDS = 300
LEVELS = ["Low", "Medium", "High", "Critical"]


def normalised_entropy(df: DataFrame, group: list[str], key: str, name: str = "entropy") -> DataFrame:
    """Base-2 entropy of the key's shares per group over log2 of the number of keys.

    0 for a single key. Null keys do not count. Rows are reduced to one per (group, key) before
    the shuffle, so a hot group costs no more than its distinct keys.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(*group, key).agg(F.count("*").alias("__n"))
    plain = F.log2(F.sum("__n")) - F.sum(F.col("__n") * F.log2("__n")) / F.sum("__n")
    value = F.when(F.count("*") > 1, plain / F.log2(F.count("*"))).otherwise(0.0)
    return counts.groupBy(*group).agg(F.greatest(F.lit(0.0), value).alias(name))


def _counts_of_kinds(df: DataFrame, group: list[str], keys: dict[str, str], extra: dict | None = None) -> DataFrame:
    """(group.., kind, key, n): how often each key of each kind occurs, in one pass over the rows.

    `extra` are sums that are taken once per row, with the rows of the first kind.
    """
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("key")) for kind, c in keys.items()])
    rows = df.select(*group, *[v.alias(n) for n, v in (extra or {}).items()], F.explode(pairs).alias("p"))
    first = F.col("p.kind") == next(iter(keys))
    return rows.groupBy(*group, F.col("p.kind").alias("kind"), F.col("p.key").alias("key")).agg(
        F.count("*").alias("n"), *[F.sum(F.when(first, F.col(n))).alias(n) for n in (extra or {})])


def _of(kind: str, value):
    return F.when(F.col("kind") == kind, value)


def _plain_entropy(kind: str):
    n, total = F.col("n"), F.sum(_of(kind, F.col("n")))
    return F.greatest(F.lit(0.0), F.log2(total) - F.sum(_of(kind, n * F.log2(n))) / total)


def component_entropies(df: DataFrame, group: list[str]) -> DataFrame:
    """activity, app, domain and temporal entropy per group, and their weighted composite.

    Null keys do not count; groups without any activity type are left out. One pass: counts per (group, kind, key), then sums.
    """
    keys = {"activity": "activity_type", "app": "app_category", "domain": "domain", "temporal": "__hour"}
    counts = _counts_of_kinds(df.withColumn("__hour", F.hour("timestamp")), group, keys).filter("key is not null")
    several = lambda kind: F.count(_of(kind, F.lit(1)))
    parts = counts.groupBy(*group).agg(several("activity").alias("__activities"), *[
        F.when(several(k) > 1, _plain_entropy(k) / F.log2(several(k))).otherwise(0.0).alias(f"{k}_entropy") for k in keys])
    total = reduce(lambda a, b: a + b, [F.col(f"{n}_entropy") * w for n, w in C.ENTROPY_WEIGHTS.items()])
    return parts.filter("__activities > 0").drop("__activities").withColumn("composite_entropy", clamp(total, 0, 1))


def percentile_rank(current: DataFrame, baseline: DataFrame, value: str) -> DataFrame:
    """Share (0-100) of baseline values at or below each current value; 50 without a baseline.

    Both sides are reduced to distinct values, ranked together over value ranges, and the rank
    is joined back by value.
    """
    n = baseline.agg(F.count(value).alias("n")).scalar()
    both = current.select(F.col(value).alias("__v"), F.lit(0).alias("__b")).unionByName(
        baseline.select(F.col(value).alias("__v"), F.lit(1).alias("__b"))
    )
    ranks = cumulative(both, "__v", {"__base": F.sum("__b")}).select(
        "__v", (F.col("below___base") + F.col("__base")).alias("__upto")
    )
    rank = F.when(n == 0, 50.0).otherwise(F.col("__upto") / n * 100)
    return current.join(ranks, current[value] == ranks["__v"], "left").withColumn(
        "entropy_percentile", F.coalesce(rank, F.lit(50.0))
    ).drop("__v", "__upto")


def entropy_level(percentile, role):
    """Low to Critical by percentile; roles of naturally high entropy have higher cuts."""
    factor = lookup(role, C.ROLE_ENTROPY_MULTIPLIERS, 1.0)
    low, medium, high = [F.least(F.lit(100.0), factor * c) for c in C.ENTROPY_CUTS]
    return (
        F.when(percentile >= high, "Critical").when(percentile >= medium, "High")
        .when(percentile >= low, "Medium").otherwise("Low")
    )


def entropy_anomaly(df: DataFrame, multiplier: float = 2.0) -> DataFrame:
    """Flag and text where the composite exceeds twice the role's baseline (0.5 if unknown)."""
    base = F.coalesce("baseline_composite", F.lit(0.5))
    hit = F.col("composite_entropy") > base * multiplier
    text = F.concat(
        F.lit(C.ENTROPY_TEXT[0]),
        F.format_string("%.2f", F.col("composite_entropy")), F.lit(C.ENTROPY_TEXT[1].format(multiplier=multiplier)),
        F.format_string("%.2f", base),
        F.lit(C.ENTROPY_TEXT[2]),
    )
    return df.withColumns({
        "is_entropy_anomaly": hit, "entropy_text": F.when(hit, text).otherwise(""),
    })


def _switched(rows: DataFrame) -> DataFrame:
    """Rows with their five-minute bucket and whether the application is another than in the row before."""
    bucketed = rows.withColumn("time_window", F.floor(F.unix_seconds("timestamp") / SESSION_SECONDS))
    lagged = previous(bucketed, ["user", "time_window"], "timestamp", "id", {"__app": "app_category"})
    return lagged.withColumn("__switch", F.coalesce(F.col("app_category") != F.col("__app"), F.lit(False)).cast("long"))


def app_switches(rows: DataFrame) -> DataFrame:
    """Application switches per user and five-minute bucket (the first row is no switch)."""
    return _switched(rows).groupBy("user", "time_window").agg(F.sum("__switch").alias("app_transitions"))


def session_entropy(rows: DataFrame) -> DataFrame:
    """Per user and five-minute bucket: base-2 activity entropy, app switches, distinct domains, in one pass over the rows."""
    keys = ["user", "time_window"]
    counts = _counts_of_kinds(_switched(rows), keys, {"activity": "activity_type", "domain": "domain"}, {"__switch": F.col("__switch")})
    return counts.groupBy(*keys).agg(
        _plain_entropy("activity").alias("activity_entropy"), F.sum("__switch").alias("app_transitions"),
        F.count(_of("domain", F.col("key"))).alias("domain_diversity"))


def user_entropy_summary(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("user").agg(
        F.avg("activity_entropy").alias("mean_activity_entropy"),
        F.coalesce(F.stddev_samp("activity_entropy"), F.lit(0.0)).alias("entropy_variance"),
        F.avg("app_transitions").alias("avg_app_transitions"),
        F.avg("domain_diversity").alias("avg_domain_diversity"),
    )

"""Detection quality against a labelled user, and comparison of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conductrisk import config as C
from conductrisk.functions.common import ratio
from conductrisk.operators.ordered import cumulative


def confusion(rows: DataFrame, threshold: float = C.DETECTION_THRESHOLD, score: str = "risk_score",
              label: str = "label") -> DataFrame:
    """Counts, precision, recall and F1 at one threshold, as one row."""
    hit, true = F.col(score) >= threshold, F.col(label) == 1
    return with_rates(rows.agg(
        F.count_if(true & hit).alias("tp"), F.count_if(~true & hit).alias("fp"),
        F.count_if(true & ~hit).alias("fn"), F.count_if(~true & ~hit).alias("tn"),
    ))


def with_rates(counts: DataFrame) -> DataFrame:
    one = F.lit(1)
    rates = counts.withColumns({
        "precision": F.col("tp") / F.greatest(one, F.col("tp") + F.col("fp")),
        "recall": F.col("tp") / F.greatest(one, F.col("tp") + F.col("fn")),
    })
    both = F.col("precision") + F.col("recall")
    return rates.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(0.001), both))


def detection(rows: DataFrame, user: str = C.TRUTH_USER, start: int = C.TRUTH_START_OFFSET,
              threshold: float = C.DETECTION_THRESHOLD) -> DataFrame:
    """Was the labelled user found, on which day, and how late."""
    first = rows.agg(F.min("date").alias("m")).scalar()
    high = F.col("risk_score") >= threshold
    found = rows.filter(F.col("user") == user).agg(
        F.min(F.when(high, F.col("date"))).alias("first_detection"),
        F.max("risk_score").alias("max_risk_score"),
        F.count_if(high).alias("high_risk_events"), F.count("*").alias("total_events"),
    )
    day = F.floor((F.unix_micros("first_detection") - F.unix_micros(first)) / (86400 * 1e6)).cast("int")
    return found.select(
        F.lit(user).alias("threat_user"), (F.col("high_risk_events") > 0).alias("detected"),
        day.alias("detection_day"), F.greatest(F.lit(0), day - start).alias("detection_delay"),
        F.coalesce("max_risk_score", F.lit(0.0)).alias("max_risk_score"), "high_risk_events", "total_events",
    )


def false_positives(rows: DataFrame, user: str = C.TRUTH_USER, threshold: float = C.DETECTION_THRESHOLD) -> DataFrame:
    """High-risk rows of all other users: affected users, total, mean and maximum per user, rate."""
    per_user = rows.filter(F.col("user") != user).groupBy("user").agg(
        F.count_if(F.col("risk_score") >= threshold).alias("n"))
    hit = F.when(F.col("n") > 0, F.col("n"))
    return per_user.agg(
        F.count("*").alias("total_normal_users"), F.count(hit).alias("users_with_false_positives"),
        F.coalesce(F.sum(hit), F.lit(0)).alias("total_false_positive_events"),
        F.coalesce(F.avg(hit), F.lit(0.0)).alias("avg_fp_per_user"),
        F.coalesce(F.max(hit), F.lit(0)).alias("max_fp_single_user"),
    ).withColumn("fp_rate", ratio(F.col("users_with_false_positives"), F.greatest(F.lit(1), F.col("total_normal_users"))))


def threat_rank(report: DataFrame, user: str = C.TRUTH_USER) -> DataFrame:
    """Rank of the labelled user and the five riskiest users. Only two scans, no global sort."""
    mine = report.filter(F.col("user") == user).agg(F.max("total_risk_score").alias("s")).scalar()
    top = report.orderBy(F.desc("total_risk_score"), "user").limit(5)
    listed = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("total_risk_score")).alias("s"), "user"))).alias("l"))
    users = listed.select(F.array_join(F.transform("l", lambda e: e["user"]), ",")).scalar()
    return report.agg(
        F.count("*").alias("total_users"),
        (F.count_if(F.col("total_risk_score") > mine) + 1).alias("threat_user_rank"),
    ).withColumn("top_users", users)


def summary(rows: DataFrame, report: DataFrame, user: str = C.TRUTH_USER) -> DataFrame:
    """The evaluation result as one nested row."""
    pack = lambda df: df.select(F.struct("*")).scalar()
    return threat_rank(report, user).withColumns({
        "detection": pack(detection(rows, user)), "precision_recall": pack(confusion(rows)),
        "false_positives": pack(false_positives(rows, user)),
    })


def roc_auc(rows: DataFrame, score: str, label: str = "label") -> DataFrame:
    """Area under the curve by average ranks, over distinct scores."""
    table = cumulative(rows, score, {"pos": F.count_if(F.col(label) == 1), "neg": F.count_if(F.col(label) != 1)})
    wins = F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2))
    return table.agg((wins / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))


def deviation_cut(rows: DataFrame, score: str, sigmas: float = 2.0) -> Column:
    """mean + sigmas * population deviation of a score column, as a one-value subquery."""
    return rows.agg((F.avg(score) + sigmas * F.stddev_pop(score)).alias("cut")).scalar()


def model_metrics(rows: DataFrame, model: str, score: str, cut: Column | float, label: str = "label",
                  below: bool = False) -> DataFrame:
    """Confusion, precision, recall, F1 and AUC of one model; `below` flags low scores."""
    cut = F.lit(float(cut)) if isinstance(cut, (int, float)) else cut
    flagged = rows.withColumn("__cut", cut).withColumn(
        "__pred", F.when((F.col(score) < F.col("__cut")) if below else (F.col(score) > F.col("__cut")), 1).otherwise(0))
    oriented = rows.withColumn("__s", -F.col(score) if below else F.col(score))
    auc = roc_auc(oriented.select("__s", label), "__s", label).scalar()
    return confusion(flagged, 1, "__pred", label).select(
        F.lit(model).alias("model"), "tp", "fp", "fn", "tn", "precision", "recall", "f1"
    ).withColumn("roc_auc", auc)


def best_models(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.max_by("model", F.struct("f1", "model")).alias("best_f1"),
        F.max_by("model", F.struct("roc_auc", "model")).alias("best_auc"),
    )


def compare_scores(rows: DataFrame, production: str, shadow: str, label: str = "label", cut: float = 0.5) -> DataFrame:
    """Two score columns side by side: distribution, accuracy, verdict at +-0.02."""
    aggs = []
    for name, c in (("production", production), ("shadow", shadow)):
        right = (F.col(c) >= cut).cast("int") == F.col(label)
        aggs += [
            F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std"),
            F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"),
            F.avg(right.cast("int")).alias(f"{name}_accuracy"),
        ]
    out = rows.agg(*aggs)
    diff = F.col("shadow_accuracy") - F.col("production_accuracy")
    return out.withColumns({
        "mean_diff": F.col("shadow_mean") - F.col("production_mean"),
        "accuracy_diff": diff,
        "recommendation": F.when(diff > 0.02, "shadow model is better")
        .when(diff < -0.02, "shadow model is worse")
        .otherwise("no clear difference"),
    })

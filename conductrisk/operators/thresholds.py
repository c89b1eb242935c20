"""Adaptive anomaly thresholds and drift of score distributions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conductrisk import config as C
from conductrisk.functions.common import ratio
from conductrisk.operators.ordered import cumulative, percentiles, smallest
from conductrisk.session import stage

DEFAULT_THRESHOLD = C.ANOMALY_MEAN + C.STD_MULTIPLIER * C.ANOMALY_STD
COLUMNS = ["threshold", "method", "confidence"]


def _gated(out: DataFrame, n: Column) -> DataFrame:
    """Below the minimum number of samples every method gives the default."""
    few = n < C.MIN_SAMPLES
    return out.withColumns({
        "threshold": F.when(few, F.lit(DEFAULT_THRESHOLD)).otherwise(F.col("threshold")),
        "method": F.when(few, "default").otherwise(F.col("method")),
        "confidence": F.when(few, 0.5).otherwise(F.col("confidence")),
    })


def by_percentile(scores: DataFrame, score: str = "score", target: float = C.TARGET_PERCENTILE) -> DataFrame:
    cuts = percentiles(scores, score, [target])
    moments = scores.agg(F.struct(F.avg(score).alias("m"), F.stddev_pop(score).alias("s")).alias("x")).scalar()
    out = cuts.withColumn("__x", moments).select(
        F.col("p")[0].alias("threshold"), F.lit("percentile").alias("method"),
        F.least(F.lit(1.0), F.col("n") / (C.MIN_SAMPLES * 10)).alias("confidence"),
        F.col("n").alias("sample_size"), F.col("__x.m").alias("score_mean"), F.col("__x.s").alias("score_std"),
    )
    return _gated(out, F.col("sample_size"))


def by_iqr(scores: DataFrame, score: str = "score") -> DataFrame:
    cuts = percentiles(scores, score, [0.25, 0.75])
    q1, q3 = F.col("p")[0], F.col("p")[1]
    out = cuts.select((q3 + (q3 - q1) * C.IQR_MULTIPLIER).alias("threshold"), F.lit("iqr").alias("method"),
                      F.lit(0.8).alias("confidence"), "n", q1.alias("q1"), q3.alias("q3"))
    return _gated(out, F.col("n")).withColumnRenamed("n", "sample_size")


def by_deviation(scores: DataFrame, score: str = "score") -> DataFrame:
    out = scores.agg(
        (F.avg(score) + C.STD_MULTIPLIER * F.stddev_pop(score)).alias("threshold"), F.count(score).alias("sample_size"),
    ).withColumns({"method": F.lit("std"), "confidence": F.lit(0.7)})
    return _gated(out, F.col("sample_size"))


def confusion_by_threshold(rows: DataFrame, grid: Column, score: str = "score", label: str = "label") -> DataFrame:
    """tp, fp, fn, tn for each threshold of an array column of fixed size.

    Every row is put into the gap between two thresholds, gaps are counted, and the counts are
    summed up over the few gaps: no row meets more than one threshold.
    """
    placed = rows.withColumn("__g", grid).withColumn("__grid", F.sort_array("__g")).withColumn(
        "__gap", F.size(F.filter("__grid", lambda t: t < F.col(score))))
    gaps = placed.groupBy("__gap").agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"), F.first("__grid").alias("__grid"))
    one = gaps.agg(
        F.max("__grid").alias("grid"), F.collect_list(F.struct("__gap", "pos", "neg")).alias("gaps"),
        F.sum("pos").alias("p"), F.sum("neg").alias("q"),
    )
    each = one.select("gaps", "p", "q", F.posexplode("grid").alias("i", "threshold"))
    above = lambda f: F.aggregate(
        F.filter("gaps", lambda g: g["__gap"] > F.col("i")), F.lit(0).cast("long"), lambda a, g: a + g[f])
    return each.select("i", "threshold", above("pos").alias("tp"), above("neg").alias("fp"), "p", "q").select(
        "i", "threshold", "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("q") - F.col("fp")).alias("tn"))


def by_cost(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """The cheapest of 100 percentile cuts from 90 to 99.9; the first of equal ones."""
    grid = percentiles(rows, score, [float(p) / 100 for p in np.linspace(90, 99.9, 100)])
    options = confusion_by_threshold(rows, grid.select("p").scalar(), score, label)
    cost = F.col("fp") * C.FALSE_POSITIVE_COST + F.col("fn") * C.FALSE_NEGATIVE_COST
    best = options.withColumn("total_cost", cost).agg(
        F.min_by(F.struct("threshold", "tp", "fp", "fn", "tn", "total_cost"), F.struct("total_cost", "i")).alias("b")
    ).select("b.*")
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    worst = max(C.FALSE_POSITIVE_COST, C.FALSE_NEGATIVE_COST)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = best.withColumns({
        "method": F.lit("cost"), "confidence": 1.0 - F.col("total_cost") / (n * worst),
        "precision": p, "recall": r, "f1": ratio(2 * p * r, p + r), "sample_size": n,
    })
    return _gated(out, F.col("sample_size"))


def tail_grid() -> list[tuple[str, float]]:
    """Candidates for the tail parameter, relative to 1/maximum (below 0) or 1/mean (above)."""
    return [("max", -i / 20) for i in range(19, 0, -1)] + [("mean", i / 20) for i in range(1, 41)]


def by_tail(scores: DataFrame, score: str = "score") -> DataFrame:
    """Pareto fit of the excesses over the 95th percentile, cut at 99.9 % of the tail.

    The likelihood depends on one parameter once the others are profiled out. All candidates are
    summed in one pass over the tail; the best is taken. Fewer than 20 tail rows: percentile.
    """
    cutoff = percentiles(scores, score, [C.TAIL_PERCENTILE]).select(F.col("p")[0]).scalar()
    # the tail is read by several steps, so it is written once
    tail = stage(scores.withColumn("__cut", cutoff).filter(F.col(score) > F.col("__cut")).select(
        (F.col(score) - F.col("__cut")).alias("x"), "__cut"), "tail")
    shape = tail.agg(F.struct(F.max("x").alias("max"), F.avg("x").alias("mean"), F.count("*").alias("n"),
                              F.max("__cut").alias("cut")).alias("s")).scalar()
    grid = tail_grid()
    sized = tail.withColumn("s", shape)
    theta = [F.lit(u) / F.col(f"s.{unit}") for unit, u in grid]
    sums = sized.groupBy("s").agg(*[F.avg(F.log1p(t * F.col("x"))).alias(f"g{i}") for i, t in enumerate(theta)])
    options = sums.select("s", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), t.alias("theta"), F.col(f"g{i}").alias("xi")) for i, t in enumerate(theta)
    ])).alias("o")).select("s", "o.*")
    likelihood = -(F.ln(F.col("xi") / F.col("theta")) + F.col("xi") + 1)
    best = options.agg(F.max_by(F.struct("s", "theta", "xi"), F.struct(F.round(likelihood, 9), -F.col("i"))).alias("b")).select("b.*")
    scale = F.col("xi") / F.col("theta")
    quantile = scale / F.col("xi") * (F.pow(F.lit(1 - C.TAIL_CONFIDENCE), -F.col("xi")) - 1)
    fitted = best.select(
        (F.col("s.cut") + quantile).alias("threshold"), F.col("xi").alias("shape"), scale.alias("scale"),
        F.col("s.cut").alias("tail_cutoff"), F.col("s.n").alias("tail_size"))
    model = fitted.select(F.struct("shape", "scale").alias("m")).scalar()
    steps = cumulative(tail, "x", {"c": F.count("*")}).withColumn("m", model).withColumn("n", F.lit(1))
    total = tail.agg(F.count("*").alias("n")).scalar()
    cdf = 1 - F.pow(1 + F.col("m.shape") * F.col("x") / F.col("m.scale"), -1 / F.col("m.shape"))
    gap = F.greatest(F.abs(cdf - F.col("below_c") / F.col("t")), F.abs(cdf - (F.col("below_c") + F.col("c")) / F.col("t")))
    ks = steps.withColumn("t", total).agg(F.max(gap).alias("d")).scalar()
    usual = by_percentile(scores, score).select(F.struct(*COLUMNS).alias("u")).scalar()
    few = F.col("tail_size") < C.MIN_TAIL_ROWS
    out = fitted.withColumns({"ks_statistic": ks, "__u": usual})
    p = kolmogorov_p(F.col("ks_statistic"), F.sqrt(F.col("tail_size").cast("double")))
    return out.withColumns({
        "threshold": F.when(few, F.col("__u.threshold")).otherwise(F.col("threshold")),
        "method": F.when(few, F.col("__u.method")).otherwise("evt"),
        "confidence": F.when(few, F.col("__u.confidence")).otherwise(p),
    }).drop("__u")


METHODS = {"percentile": by_percentile, "evt": by_tail, "iqr": by_iqr, "std": by_deviation}


def adaptive_threshold(rows: DataFrame, method: str = "percentile", score: str = "score",
                       label: str | None = None) -> DataFrame:
    """threshold, method, confidence of a score table by the named method."""
    if method == "cost":
        out = by_cost(rows, score, label) if label else by_percentile(rows, score)
    elif method in METHODS:
        out = METHODS[method](rows, score)
    else:
        raise ValueError(f"unknown threshold method {method}")
    return out.select(COLUMNS)


def rolling_thresholds(rows: DataFrame, ts: str, score: str, days: int = C.ROLLING_DAYS) -> DataFrame:
    """Threshold history: one row per update day, from the trailing days or, if those hold fewer
    than 50 scores, from everything so far. The newest 2 * days updates are kept.
    """
    daily = rows.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("c"))
    # one row per calendar day: bounded by the length of the history
    order = Window.partitionBy(F.lit(0)).orderBy(F.unix_date("day"))
    recent = F.sum("c").over(order.rangeBetween(-(days - 1), 0))
    newest = daily.agg(F.max("day").alias("d")).scalar()
    updates = daily.select("day", (recent < C.ROLLING_MIN_RECENT).alias("use_all")).withColumn("__last", newest).filter(
        F.col("day") > F.date_sub("__last", 2 * days))
    points = updates.agg(F.collect_list(F.struct("day", "use_all")).alias("u")).scalar()
    tagged = rows.select(F.to_date(ts).alias("__d"), F.col(score).alias("score")).withColumn("__u", points)
    chosen = F.filter("__u", lambda u: (u["day"] >= F.col("__d")) & (
        u["use_all"] | (F.date_diff(u["day"], F.col("__d")) < days)))
    spread = tagged.select("score", F.explode(chosen).alias("u")).select("score", F.col("u.day").alias("update_day"))
    cuts = percentiles(spread, "score", [C.TARGET_PERCENTILE], ["update_day"], max_groups=2 * days)
    value = F.when(F.col("n") < C.MIN_SAMPLES, DEFAULT_THRESHOLD).otherwise(F.col("p")[0])
    return cuts.select("update_day", F.col("n").alias("sample_size"), value.alias("threshold"))


def kolmogorov_p(statistic: Column, root: Column) -> Column:
    """Asymptotic p-value of a Kolmogorov statistic; `root` is the root of the effective size."""
    lam = (root + 0.12 + F.lit(0.11) / root) * statistic
    total = F.lit(0.0)
    for k in range(1, 9):
        total = total + F.exp(lam * lam * (-2.0 * k * k)) * (2.0 if k % 2 else -2.0)
    return F.when(lam < 0.3, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


@F.pandas_udf(T.DoubleType())
def _cramer_p(statistic: pd.Series) -> pd.Series:
    """Limiting upper tail of the Cramer-von Mises statistic (series of Bessel functions)."""
    import math

    t = np.linspace(0, 12, 4001)

    def bessel(order, z):
        return np.trapezoid(np.exp(-z * np.cosh(t)) * np.cosh(order * t), t)

    def upper(x):
        if x <= 0:
            return 1.0
        total, gamma = 0.0, 1.7724538509055159
        for k in range(12):
            y = 4 * k + 1
            z = y * y / (16 * x)
            weight = math.exp(math.lgamma(k + 0.5) - math.lgamma(k + 1)) / gamma
            total += weight * np.sqrt(y) * np.exp(-z) * bessel(0.25, z)
        return float(min(1.0, max(0.0, 1 - total / (np.pi * np.sqrt(x)))))

    return statistic.map(upper)


def distribution_drift(reference: DataFrame, current: DataFrame, score: str, key: str, test: str = "ks") -> DataFrame:
    """Two-sample test of score distributions on equally large, hash-chosen samples."""
    pick = lambda df: df.select(
        F.col(score).cast("double").alias("v"), F.md5(F.col(key).cast("string")).alias("h"))
    ref, cur = pick(reference), pick(current)
    size = ref.agg(F.count("*").alias("n")).scalar()
    other = cur.agg(F.count("*").alias("n")).scalar()
    wanted = F.least(size, other)
    ref, cur = smallest(ref, "h", wanted), smallest(cur, "h", wanted)
    # the two samples are read by several steps, so they are written once
    both = stage(ref.select("v", F.lit(1).alias("r")).unionByName(cur.select("v", F.lit(0).alias("r"))), "samples")
    steps = cumulative(both, "v", {"a": F.count_if(F.col("r") == 1), "b": F.count_if(F.col("r") == 0)})
    gap = (F.col("below_a") + F.col("a") - F.col("below_b") - F.col("b")) / F.col("n")
    drawn = both.agg(F.count_if(F.col("r") == 1).alias("n")).scalar()
    stats = steps.withColumn("n", drawn).agg(
        F.max("n").alias("sample_size"), F.max(F.abs(gap)).alias("ks"),
        (F.sum((F.col("a") + F.col("b")) * gap * gap) / 4).alias("cvm"),
    )
    moments = lambda part: both.filter(F.col("r") == part).agg(
        F.struct(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).alias("x")).scalar()
    out = stats.withColumns({"__r": moments(1), "__c": moments(0)})
    half = F.sqrt(F.col("sample_size") / 2)
    p = kolmogorov_p(F.col("ks"), half) if test == "ks" else _cramer_p("cvm")
    out = out.select(
        "sample_size", F.col("ks" if test == "ks" else "cvm").alias("statistic"), p.alias("p_value"),
        (F.col("__c.m") - F.col("__r.m")).alias("mean_difference"),
        (F.col("__c.s") - F.col("__r.s")).alias("std_difference"),
        F.col("__r.m").alias("reference_mean"), F.col("__c.m").alias("current_mean"),
    )
    hit = F.col("p_value") < C.DRIFT_P_VALUE
    advice = F.concat_ws(
        " ",
        F.when(F.col("mean_difference") > 0.1, "The mean score rose by more than 0.1: fit the model again on newer rows."),
        F.when(F.col("std_difference") > 0.05, "Scores spread wider than in the reference period: look at what users do differently."),
    )
    minor = "The distributions differ, but neither mean nor spread moved much: adjust the threshold first."
    return out.withColumns({
        "drift_detected": hit, "confidence": 1.0 - F.col("p_value"),
        "recommendation": F.when(~hit, "The two periods do not differ by more than chance.").otherwise(
            F.when(advice == "", minor).otherwise(advice)),
    })

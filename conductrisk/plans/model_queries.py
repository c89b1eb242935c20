"""Queries that fit or apply models. Fits are not expressible in SQL, so most have no twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from conductrisk import adapters as A
from conductrisk import config as C
from conductrisk.operators import models as M
from conductrisk.operators import alerts, evaluation, heldout, sequence_models, sequences, timeline
from conductrisk.plans import tables as T0
from conductrisk.plans.registry import D, R, query, rounded, text_time


def _daily(spark, sf):
    return T0.stage(T0.daily(spark, sf), "daily")


def _labelled(spark, sf):
    return timeline.with_truth_by_date(_daily(spark, sf).withColumn("date", F.col("day"))).drop("date")


@query("standardised_features", f"""
SELECT "user", {D("day")}, {R("(far - (SELECT avg(far) FROM daily)) / (SELECT stddev_pop(far) FROM daily)", "far_scaled")}, {R("(oaf - (SELECT avg(oaf) FROM daily)) / (SELECT stddev_pop(oaf) FROM daily)", "oaf_scaled")},
  {R("email_count - (SELECT avg(email_count) FROM daily)", "email_count_scaled")} FROM daily""")
def standardised_features(spark, sf):
    rows = M.standardised(_daily(spark, sf), ["far", "oaf", "email_count"]).select("user", "day", "far_scaled", "oaf_scaled", "email_count_scaled")
    return text_time(rounded(rows, "far_scaled", "oaf_scaled", "email_count_scaled"), "day")


@query("feature_vector_contract", f"""SELECT "user", {D("day")}, 7 AS core_size, 15 AS full_size, {R("far", "first_value")} FROM daily""")
def feature_vector_contract(spark, sf):
    from pyspark.ml.functions import vector_to_array
    rows = M.feature_vectors(M.feature_vectors(_daily(spark, sf), C.CORE_FEATURES, "core"), C.DAILY_FEATURES, "full")
    out = rows.select("user", "day", F.size(vector_to_array("core")).alias("core_size"), F.size(vector_to_array("full")).alias("full_size"),
                      vector_to_array("core")[0].alias("first_value"))
    return text_time(rounded(out, "first_value"), "day")


@query("class_weights", """
SELECT id, CASE WHEN label = 1 THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END AS boosted, round(n / (2.0::DOUBLE * greatest(1, CASE WHEN label = 1 THEN p ELSE n - p END)), 6) + 0.0 AS balanced FROM (
SELECT id, CAST("user" = 'U5' AND day >= DATE '2024-01-20' AS INTEGER) AS label, count(*) OVER () AS n, sum(CAST("user" = 'U5' AND day >= DATE '2024-01-20' AS INTEGER)) OVER () AS p FROM act)""")
def class_weights(spark, sf):
    rows = timeline.with_truth_by_date(A.activity(spark, sf)).select("id", "label")
    boosted = M.positive_weights(rows).withColumnRenamed("weight", "boosted")
    return rounded(M.balanced_weights(boosted).withColumnRenamed("weight", "balanced").drop("label"), "balanced")


@query("role_sequence_model_errors")
def role_sequence_model_errors(spark, sf):
    days = _daily(spark, sf)
    scored = sequence_models.score(days, sequence_models.fit(days), with_latent=True).filter("global_error is not null")
    model = F.when(F.col("own_error").isNotNull(), F.col("role")).otherwise(C.GLOBAL_MODEL)
    return scored.select("user", "day", "role", model.alias("model"), F.coalesce("own_error", "global_error").alias("error"), "latent")


@query("role_sequence_model_metadata")
def role_sequence_model_metadata(spark, sf):
    return sequences.model_metadata(T0.errors(spark, sf, C.LATENT_SIZE))


@query("sequence_errors_without_components", f"""
SELECT "user", {D("day")}, {R("coalesce(own_error, -1)", "own_error")}, {R("coalesce(global_error, -1)", "global_error")} FROM errors""")
def sequence_errors_without_components(spark, sf):
    """The fitted path with no component: the errors of the scalers."""
    days = _daily(spark, sf)
    rows = sequence_models.score(days, sequence_models.fit(days, 0)).select(
        "user", "day", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("own_error", "global_error")])
    return text_time(rounded(rows, "own_error", "global_error"), "day")


_ENDS = ", ".join(f"'{r}'" for r in C.MODEL_ROLES)
_MOMENTS = {
    # every value of every sequence, by model: sequence, place and feature
    "seq_values": """
SELECT model, seq, place * 100 + f AS p, v FROM (
  SELECT e.model, e."user" || ' ' || e.day AS seq, d.i - e.i + 9 AS place, unnest(range(15)) AS f,
    unnest([""" + ", ".join(f"d.{f}::DOUBLE" for f in C.DAILY_FEATURES) + f"""]) AS v
  FROM (SELECT *, unnest(CASE WHEN role IN ({_ENDS}) THEN [role, 'global'] ELSE ['global'] END) AS model FROM weighted WHERE i >= 10) e
  JOIN weighted d ON d."user" = e."user" AND d.i BETWEEN e.i - 9 AND e.i)""",
    "seq_scale": """
SELECT model, p % 100 AS f, CASE WHEN var_pop(v) > 1e-12::DOUBLE * (1 + avg(v) * avg(v)) THEN stddev_pop(v) ELSE 1.0::DOUBLE END AS s
FROM seq_values GROUP BY 1, 2""",
    "seq_scaled": """SELECT v.model, v.seq, v.p, v.v / s.s AS x FROM seq_values v JOIN seq_scale s ON s.model = v.model AND s.f = v.p % 100""",
    "seq_cells": """
SELECT a.model, a.p AS p, b.p AS q, covar_pop(a.x, b.x) AS c FROM seq_scaled a JOIN seq_scaled b ON a.model = b.model AND a.seq = b.seq AND a.p <= b.p
GROUP BY 1, 2, 3""",
}


@query("sequence_model_moments", f"""
SELECT c.model, n_sequences, {R("sum(c.c) FILTER (WHERE p = q)", "total_variance", 4)}, {R("sum(CASE WHEN p = q THEN c.c * c.c ELSE 2 * c.c * c.c END)", "squared_variance", 2)}
FROM seq_cells c JOIN (SELECT model, count(DISTINCT seq) AS n_sequences FROM seq_values GROUP BY 1) n USING (model) GROUP BY 1, 2""", **_MOMENTS)
def sequence_model_moments(spark, sf):
    """Sums of the eigenvalues and of their squares: trace and squared norm of the covariance of all places and features."""
    models = sequence_models.fit(_daily(spark, sf))
    total = lambda f: F.aggregate("eigenvalues", F.lit(0.0), lambda s, v: s + f(v))
    rows = models.select("model", "n_sequences", total(lambda v: v).alias("total_variance"), total(lambda v: v * v).alias("squared_variance"))
    return rounded(rounded(rows, "total_variance", digits=4), "squared_variance", digits=2)


@query("fitted_user_days")
def fitted_user_days(spark, sf):
    """Explained scores of user-days under the fitted models."""
    rows = T0.scored(spark, sf, C.LATENT_SIZE)
    return text_time(rows.select("user", "role", "day", "anomaly_score", "base_risk", "risk_score", "primary_factor", "mitre_tactic", "explanation"), "day")


@query("fitted_score_coverage", """
SELECT role, count(*) AS days, count_if(own_error IS NOT NULL) AS own_days, count_if(global_error IS NOT NULL) AS sequence_days,
  0::BIGINT AS outside_range, round(sum(activity_multiplier), 6) + 0.0 AS activity_total, count_if(is_pattern) AS pattern_days
FROM (SELECT s.*, e.own_error, e.global_error FROM scored s JOIN errors e ON e."user" = s."user" AND e.day = s.day) GROUP BY 1""")
def fitted_score_coverage(spark, sf):
    """What a fitted model must leave as it is: the scored days per role, and the parts of the score that no model decides."""
    rows = T0.errors(spark, sf, C.LATENT_SIZE)
    seen = rows.select("user", "day", "own_error", "global_error")
    scored = T0.scored_of(rows).join(seen, ["user", "day"])
    return rounded(scored.groupBy("role").agg(
        F.count("*").alias("days"), F.count("own_error").alias("own_days"), F.count("global_error").alias("sequence_days"),
        F.count_if(~F.col("risk_score").between(0, 100)).alias("outside_range"),
        F.sum("activity_multiplier").alias("activity_total"), F.count_if("is_pattern").alias("pattern_days")), "activity_total")


@query("fitted_alert_decisions")
def fitted_alert_decisions(spark, sf):
    rows = alerts.decide(T0.scored_days(spark, sf, C.LATENT_SIZE))
    return text_time(rows.select("user", "day", "risk_score", "should_alert", "alert_severity"), "day")


@query("fitted_risk_report")
def fitted_risk_report(spark, sf):
    return T0.report(spark, sf, C.LATENT_SIZE)


@query("event_sequence_model_errors")
def event_sequence_model_errors(spark, sf):
    _, scored = M.event_model(A.activity(spark, sf))
    return scored.select("id", "user", "error")


@query("isolation_forest_events")
def isolation_forest_events(spark, sf):
    rows = timeline.with_date_parts(A.activity(spark, sf)).select("id", "user", "hour", "day_of_week")
    forest = M.fit_forest(rows, ["hour", "day_of_week"], "id")
    return M.score_forest(rows, forest, ["hour", "day_of_week"], 0.05)


@query("isolation_forest_days")
def isolation_forest_days(spark, sf):
    rows = _daily(spark, sf).withColumn("key", F.concat_ws(":", "user", "day"))
    forest = M.fit_forest(rows, C.CORE_FEATURES, "key")
    return M.score_forest(rows, forest, C.CORE_FEATURES, 0.04).select("user", "day", "decision", "prediction")


@query("one_class_kernel_days")
def one_class_kernel_days(spark, sf):
    return M.kernel_scores(_daily(spark, sf), C.CORE_FEATURES).select("user", "day", "decision", "prediction")


@query("boosted_tree_history")
def boosted_tree_history(spark, sf):
    rows = _labelled(spark, sf)
    model = M.fit_boosted(rows, C.CORE_FEATURES)
    return M.risk_history(model, rows, C.CORE_FEATURES).select("user", "day", "risk_score", "far", "oaf", "file_count").orderBy("user", F.desc("day"))


@query("forest_classifier_scores")
def forest_classifier_scores(spark, sf):
    rows = _labelled(spark, sf)
    model = M.fit_forest_classifier(rows, C.CORE_FEATURES)
    return M.probability(model, rows, C.CORE_FEATURES).select("user", "day", "label", "probability_1")


@query("sequence_classifier_scores")
def sequence_classifier_scores(spark, sf):
    seqs = sequences.labelled_sequences(_labelled(spark, sf), C.LABELLED_SEQUENCE_LENGTH)
    seqs = T0.stage(seqs.select("user", "day", "sequence", "sequence_label"), "sequences")
    return M.score_sequences(M.fit_sequence_classifier(seqs), seqs)


def _attributed(spark, sf):
    rows = _labelled(spark, sf)
    model = M.fit_forest_classifier(rows, C.CORE_FEATURES, trees=50)
    return M.attributions(model, rows, C.CORE_FEATURES, ["user", "day"])


@query("risk_attributions")
def risk_attributions(spark, sf):
    return _attributed(spark, sf)


@query("global_feature_importance")
def global_feature_importance(spark, sf):
    return M.global_importance(_attributed(spark, sf), C.CORE_FEATURES)


@query("top_risk_attributions")
def top_risk_attributions(spark, sf):
    return M.top_attributions(_attributed(spark, sf), C.CORE_FEATURES, ["user", "day"])


# --- all models on held-out days ------------------------------------------------------------
def _held_out(spark, sf):
    return heldout.scores(heldout.split_days(_labelled(spark, sf)))


@query("held_out_scores")
def held_out_scores(spark, sf):
    """Scores of all fitted models on the days they have not learned from."""
    return text_time(_held_out(spark, sf), "day")


@query("held_out_metrics")
def held_out_metrics(spark, sf):
    """A row of metrics for each fitted model."""
    return heldout.metrics(_held_out(spark, sf))


@query("best_held_out_models")
def best_held_out_models(spark, sf):
    return evaluation.best_models(T0.stage(heldout.metrics(_held_out(spark, sf)), "metrics"))


_DAY_KEY = """concat("user", ':', strftime(day, '%Y-%m-%d'))"""


@query("held_out_coverage", f"""
SELECT label, count(*) AS days, count_if(in_train) AS train_days, count_if(NOT in_train) AS held_out_days, count_if(NOT in_train AND i >= 10) AS held_out_sequences FROM (
 SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5({_DAY_KEY}), {_DAY_KEY}) <= floor(count(*) OVER (PARTITION BY label) * 0.8) AS in_train FROM (
  SELECT *, CAST("user" = 'U5' AND day >= DATE '2024-01-20' AS INTEGER) AS label FROM weighted)) GROUP BY 1""")
def held_out_coverage(spark, sf):
    """Which days the models learn from, and how many days and sequences each kind of model has to score."""
    days = heldout.split_days(_labelled(spark, sf))
    place = F.row_number().over(Window.partitionBy("user").orderBy("day"))
    return days.withColumn("i", place).groupBy(F.col("label").cast("int").alias("label")).agg(
        F.count("*").alias("days"), F.count_if("in_train").alias("train_days"), F.count_if(~F.col("in_train")).alias("held_out_days"),
        F.count_if(~F.col("in_train") & (F.col("i") >= C.SEQUENCE_LENGTH)).alias("held_out_sequences"))

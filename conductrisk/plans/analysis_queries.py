"""Queries for evaluation, thresholds, drift, posterior, privacy and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from conductrisk import adapters as A
from conductrisk.functions import posterior as PF
from conductrisk.functions.pseudonym import secret, token
from conductrisk.operators import evaluation as E
from conductrisk.operators import posterior, privacy, rollup, sampling, timeline
from conductrisk.operators import thresholds as H
from conductrisk.operators.ordered import total_rank
from conductrisk.plans import tables as T0
from conductrisk.plans.registry import D, R, T, query, rounded, text_time
from conductrisk.sources import sinks

# --- evaluation ------------------------------------------------------------------------
_LABELLED = """
SELECT *, CAST("user" = 'U5' AND date_diff('day', (SELECT min(date) FROM scored), date) >= 25 AS INTEGER) AS label FROM scored"""
_RATES = """precision_ AS precision, recall, 2 * precision_ * recall / greatest(0.001::DOUBLE, precision_ + recall) AS f1"""
_CONF = """
SELECT *, tp::DOUBLE / greatest(1, tp + fp) AS precision_, tp::DOUBLE / greatest(1, tp + fn) AS recall FROM (
SELECT count_if(label = 1 AND hit) AS tp, count_if(label = 0 AND hit) AS fp, count_if(label = 1 AND NOT hit) AS fn, count_if(label = 0 AND NOT hit) AS tn FROM (SELECT *, risk_score >= 70 AS hit FROM labelled))"""


def _labelled_days(spark, sf):
    return timeline.with_truth_by_offset(T0.scored_days(spark, sf))


@query("confusion_at_threshold", f"SELECT tp, fp, fn, tn, {R('precision_', 'precision')}, {R('recall')}, {R('2 * precision_ * recall / greatest(0.001::DOUBLE, precision_ + recall)', 'f1')} FROM conf", labelled=_LABELLED, conf=_CONF)
def confusion_at_threshold(spark, sf):
    return rounded(E.confusion(_labelled_days(spark, sf)), "precision", "recall", "f1")


_DETECT = """
SELECT 'U5' AS threat_user, n > 0 AS detected, day AS detection_day, greatest(0, day - 25) AS detection_delay, m AS max_risk_score, n AS high_risk_events, total_events
FROM (SELECT count_if(risk_score >= {t}) AS n, CAST(date_diff('day', (SELECT min(date) FROM scored), min(date) FILTER (WHERE risk_score >= {t})) AS INTEGER) AS day, max(risk_score) AS m, count(*) AS total_events FROM scored WHERE "user" = 'U5')"""


@query("detection_metrics", f"SELECT threat_user, detected, coalesce(detection_day, -1) AS detection_day, coalesce(CASE WHEN detected THEN detection_delay END, -1) AS detection_delay, {R('max_risk_score')}, high_risk_events, total_events FROM det", det=_DETECT.format(t=70))
def detection_metrics(spark, sf):
    return _detection(spark, sf, 70.0)


@query("detection_metrics_low_threshold", f"SELECT threat_user, detected, coalesce(detection_day, -1) AS detection_day, coalesce(CASE WHEN detected THEN detection_delay END, -1) AS detection_delay, {R('max_risk_score')}, high_risk_events, total_events FROM det", det=_DETECT.format(t=20))
def detection_metrics_low_threshold(spark, sf):
    """A threshold that fires on the test tables."""
    return _detection(spark, sf, 20.0)


def _detection(spark, sf, threshold):
    rows = E.detection(T0.scored_days(spark, sf), threshold=threshold)
    delay = F.when(F.col("detected"), F.col("detection_delay"))
    return rounded(rows.withColumn("detection_delay", delay).fillna(-1, ["detection_day", "detection_delay"]), "max_risk_score")


_FP = """
SELECT count(*) AS total_normal_users, count_if(n > 0) AS users_with_false_positives, CAST(sum(n) AS BIGINT) AS total_false_positive_events, coalesce(avg(n) FILTER (WHERE n > 0), 0) AS avg_fp_per_user, max(n) AS max_fp_single_user,
  count_if(n > 0)::DOUBLE / greatest(1, count(*)) AS fp_rate FROM (SELECT "user", count_if(risk_score >= 70) AS n FROM scored WHERE "user" <> 'U5' GROUP BY 1)"""


@query("false_positive_profile", f"SELECT total_normal_users, users_with_false_positives, total_false_positive_events, {R('avg_fp_per_user')}, max_fp_single_user, {R('fp_rate')} FROM fpt", fpt=_FP)
def false_positive_profile(spark, sf):
    return rounded(E.false_positives(T0.scored_days(spark, sf)), "avg_fp_per_user", "fp_rate")


_RANK = """
SELECT count(*) AS total_users, count_if(s > (SELECT s FROM rr WHERE "user" = 'U5')) + 1 AS threat_user_rank, (SELECT array_to_string(list("user" ORDER BY s DESC, "user"), ',') FROM (SELECT * FROM rr ORDER BY s DESC, "user" LIMIT 5)) AS top_users FROM rr"""
_RR = 'SELECT "user", round(total_risk_score, 6) AS s FROM report'


@query("threat_user_rank", "SELECT * FROM trank", rr=_RR, trank=_RANK)
def threat_user_rank(spark, sf):
    return E.threat_rank(T0.stage(rounded(T0.report(spark, sf), "total_risk_score"), "report"))


@query("evaluation_summary", f"SELECT total_users, threat_user_rank, {R('conf.precision_', 'precision')}, {R('conf.recall', 'recall')}, users_with_false_positives, high_risk_events > 0 AS detected FROM trank, conf, fpt, (SELECT count_if(risk_score >= 70) AS high_risk_events FROM scored WHERE \"user\" = 'U5') x",
       labelled=_LABELLED, conf=_CONF, fpt=_FP, rr=_RR, trank=_RANK)
def evaluation_summary(spark, sf):
    from conductrisk.operators import rollup
    days = T0.scored_days(spark, sf)
    report = T0.stage(rounded(rollup.user_report(days), "total_risk_score"), "report")
    rows = E.summary(timeline.with_truth_by_offset(days), report)
    return rounded(rows.select("total_users", "threat_user_rank", "precision_recall.precision", "precision_recall.recall",
                               "false_positives.users_with_false_positives", "detection.detected"), "precision", "recall")


_EVAL = "SELECT event_id, value / 500 AS a, k / 100.0::DOUBLE AS b, CAST(event_type = 'purchase' AND k > 40 AS INTEGER) AS label FROM ev"


def _scored_events(spark, sf):
    ev = A.events(spark, sf)
    label = ((F.col("event_type") == "purchase") & (F.col("k") > 40)).cast("int")
    return ev.select("event_id", "user", "ts", (F.col("value") / 500).alias("a"), (F.col("k") / 100).alias("b"), label.alias("label"))


def _metric_sql(model: str, score: str, cut: str, below: bool) -> str:
    op, sign = ("<", "-") if below else (">", "")
    return f"""
SELECT '{model}' AS model, tp, fp, fn, tn, tp::DOUBLE / greatest(1, tp + fp) AS p, tp::DOUBLE / greatest(1, tp + fn) AS r,
  (SELECT (sum(rk) FILTER (WHERE label = 1) - count_if(label = 1) * (count_if(label = 1) + 1) / 2.0::DOUBLE) / (count_if(label = 1) * count_if(label = 0)::DOUBLE)
   FROM (SELECT label, rank() OVER (ORDER BY {sign}{score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0::DOUBLE AS rk FROM se)) AS roc_auc
FROM (SELECT count_if(label = 1 AND hit) AS tp, count_if(label = 0 AND hit) AS fp, count_if(label = 1 AND NOT hit) AS fn, count_if(label = 0 AND NOT hit) AS tn
  FROM (SELECT *, {score} {op} {cut} AS hit FROM se))"""


_CUT_A = "(SELECT avg(a) + 2 * stddev_pop(a) FROM se)"
_CUT_B = "(SELECT avg(b) - 2 * stddev_pop(b) FROM se)"
_METRICS = _metric_sql("value", "a", _CUT_A, False) + " UNION ALL " + _metric_sql("k", "b", "0.9", False) + " UNION ALL " + _metric_sql("low_k", "b", "0.05", True)


def _model_metrics(spark, sf):
    rows = _scored_events(spark, sf)
    return (
        E.model_metrics(rows, "value", "a", E.deviation_cut(rows, "a"))
        .unionByName(E.model_metrics(rows, "k", "b", 0.9))
        .unionByName(E.model_metrics(rows, "low_k", "b", 0.05, below=True))
    )


@query("model_metrics", f"SELECT model, tp, fp, fn, tn, {R('p', 'precision')}, {R('r', 'recall')}, {R('2 * p * r / greatest(0.001::DOUBLE, p + r)', 'f1')}, {R('roc_auc')} FROM mm", se=_EVAL, mm=_METRICS)
def model_metrics(spark, sf):
    return rounded(_model_metrics(spark, sf), "precision", "recall", "f1", "roc_auc")


@query("best_models", "SELECT arg_max(model, 2 * p * r / greatest(0.001::DOUBLE, p + r)) AS best_f1, arg_max(model, roc_auc) AS best_auc FROM mm", se=_EVAL, mm=_METRICS)
def best_models(spark, sf):
    return E.best_models(_model_metrics(spark, sf))


@query("deviation_cuts", f"SELECT event_id, a > {_CUT_A} AS above, b < {_CUT_B} AS below FROM se", se=_EVAL)
def deviation_cuts(spark, sf):
    rows = _scored_events(spark, sf)
    return rows.select("event_id", (F.col("a") > E.deviation_cut(rows, "a")).alias("above"), (F.col("b") < E.deviation_cut(rows, "b", -2.0)).alias("below"))


@query("model_score_comparison", f"""
SELECT {R("avg(a)", "production_mean")}, {R("stddev_pop(a)", "production_std")}, {R("min(a)", "production_min")}, {R("max(a)", "production_max")}, {R("avg(CAST(CAST(a >= 0.5 AS INTEGER) = label AS INTEGER))", "production_accuracy")},
  {R("avg(b)", "shadow_mean")}, {R("stddev_pop(b)", "shadow_std")}, {R("min(b)", "shadow_min")}, {R("max(b)", "shadow_max")}, {R("avg(CAST(CAST(b >= 0.5 AS INTEGER) = label AS INTEGER))", "shadow_accuracy")},
  {R("avg(b) - avg(a)", "mean_diff")}, {R("avg(CAST(CAST(b >= 0.5 AS INTEGER) = label AS INTEGER)) - avg(CAST(CAST(a >= 0.5 AS INTEGER) = label AS INTEGER))", "accuracy_diff")},
  'shadow model is worse' AS recommendation FROM se""", se=_EVAL)
def model_score_comparison(spark, sf):
    rows = E.compare_scores(_scored_events(spark, sf), "a", "b")
    return rounded(rows, *[c for c in rows.columns if c != "recommendation"])


# --- thresholds -------------------------------------------------------------------------
_SC = "SELECT event_id, ts, value / 500 AS score, CAST(event_type = 'purchase' AND k > 40 AS INTEGER) AS label FROM ev"


def _scores(spark, sf):
    return _scored_events(spark, sf).select("event_id", "ts", F.col("a").alias("score"), "label")


@query("percentile_threshold", f"SELECT {R('quantile_cont(score, 0.995)', 'threshold')}, 'percentile' AS method, {R('least(1.0, count(*) / 1000.0)', 'confidence')}, count(*) AS sample_size, {R('avg(score)', 'score_mean')}, {R('stddev_pop(score)', 'score_std')} FROM sc", sc=_SC)
def percentile_threshold(spark, sf):
    return rounded(H.by_percentile(_scores(spark, sf)), "threshold", "confidence", "score_mean", "score_std")


@query("iqr_threshold", f"SELECT {R('quantile_cont(score, 0.75) + 1.5 * (quantile_cont(score, 0.75) - quantile_cont(score, 0.25))', 'threshold')}, 'iqr' AS method, 0.8::DOUBLE AS confidence, {R('quantile_cont(score, 0.25)', 'q1')}, {R('quantile_cont(score, 0.75)', 'q3')} FROM sc", sc=_SC)
def iqr_threshold(spark, sf):
    return rounded(H.by_iqr(_scores(spark, sf)).drop("sample_size"), "threshold", "q1", "q3")


@query("deviation_threshold", f"SELECT {R('avg(score) + 3 * stddev_pop(score)', 'threshold')}, 'std' AS method, 0.7::DOUBLE AS confidence FROM sc", sc=_SC)
def deviation_threshold(spark, sf):
    return rounded(H.by_deviation(_scores(spark, sf)).drop("sample_size"), "threshold")


_GRID100 = "SELECT i, (SELECT quantile_cont(score, 0.9 + i * 0.001) FROM sc) AS t FROM range(100) r(i)"
_COSTS = """
SELECT i, t, tp, fp, p - tp AS fn, q - fp AS tn, fp * 1.0::DOUBLE + (p - tp) * 10.0::DOUBLE AS cost FROM (
 SELECT g.i, g.t, count_if(s.label = 1 AND s.score > g.t) AS tp, count_if(s.label = 0 AND s.score > g.t) AS fp, count_if(s.label = 1) AS p, count_if(s.label = 0) AS q
 FROM grid100 g CROSS JOIN sc s GROUP BY 1, 2)"""
_GRID100 = "SELECT i, quantile_cont(score, [" + ", ".join(f"{0.9 + 0.099 * i / 99:.17g}" for i in range(100)) + "])[i + 1] AS t FROM sc, range(100) r(i) GROUP BY i"


@query("threshold_grid_confusion", f"SELECT i, {R('t', 'threshold')}, tp, fp, fn, tn FROM costs", sc=_SC, grid100=_GRID100, costs=_COSTS)
def threshold_grid_confusion(spark, sf):
    from conductrisk.operators.ordered import percentiles
    rows = _scores(spark, sf)
    probs = [0.9 + 0.099 * i / 99 for i in range(100)]
    grid = percentiles(rows, "score", probs).select("p").scalar()
    return rounded(H.confusion_by_threshold(rows, grid).withColumn("i", F.col("i").cast("long")), "threshold")


@query("cost_threshold", f"SELECT {R('t', 'threshold')}, 'cost' AS method, tp, fp, fn, tn, {R('cost', 'total_cost')} FROM costs ORDER BY costs.cost, i LIMIT 1", sc=_SC, grid100=_GRID100, costs=_COSTS)
def cost_threshold(spark, sf):
    rows = H.by_cost(_scores(spark, sf)).select("threshold", "method", "tp", "fp", "fn", "tn", "total_cost")
    return rounded(rows, "threshold", "total_cost")


_THETAS = ", ".join(f"({i}, '{u}', {v!r}::DOUBLE)" for i, (u, v) in enumerate(H.tail_grid()))
_TAIL = "SELECT score - c AS x, c FROM sc, (SELECT quantile_cont(score, 0.95) AS c FROM sc) WHERE score > c"
_TSTAT = "SELECT max(x) AS xmax, avg(x) AS xmean, count(*) AS n, max(c) AS c FROM tail"
_TFIT = f"""
SELECT theta, xi, s.n, s.c, -(ln(xi / theta) + xi + 1) AS ll, i FROM (
 SELECT i, theta, avg(ln(1 + theta * x)) AS xi FROM tail CROSS JOIN (SELECT i, v / (CASE u WHEN 'max' THEN xmax ELSE xmean END) AS theta FROM (VALUES {_THETAS}) g(i, u, v), tstat) GROUP BY 1, 2) CROSS JOIN tstat s"""
_TBEST = "SELECT * FROM tfit ORDER BY round(tfit.ll, 9) DESC, i LIMIT 1"


@query("tail_threshold", f"""
SELECT {R("b.c + (b.xi / b.theta) / b.xi * (pow(1 - 0.999::DOUBLE, -b.xi) - 1)", "threshold")}, 'evt' AS method, {R("b.xi", "shape")}, {R("b.xi / b.theta", "scale")}, {R("b.c", "tail_cutoff")}, b.n AS tail_size,
 {R("(SELECT max(greatest(abs(f - lo), abs(f - hi))) FROM (SELECT 1 - pow(1 + b2.theta * x, -1 / b2.xi) AS f, (rank() OVER (ORDER BY x) - 1) / b2.n::DOUBLE AS lo, (rank() OVER (ORDER BY x) - 1 + count(*) OVER (PARTITION BY x)) / b2.n::DOUBLE AS hi FROM tail, tbest b2))", "ks_statistic")}
FROM tbest b""", sc=_SC, tail=_TAIL, tstat=_TSTAT, tfit=_TFIT, tbest=_TBEST)
def tail_threshold(spark, sf):
    rows = H.by_tail(_scores(spark, sf)).drop("confidence")
    return rounded(rows, "threshold", "shape", "scale", "tail_cutoff", "ks_statistic")


_TKS = """
SELECT b.n, max(greatest(abs(f - lo), abs(f - hi))) AS d FROM tbest b, (
 SELECT 1 - pow(1 + c.theta * x, -1 / c.xi) AS f, (rank() OVER (ORDER BY x) - 1) / c.n::DOUBLE AS lo,
   (rank() OVER (ORDER BY x) - 1 + count(*) OVER (PARTITION BY x)) / c.n::DOUBLE AS hi FROM tail, tbest c) GROUP BY 1"""
_TLAM = "SELECT (sqrt(n) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(n)) * d AS lam FROM tks"
_TP = """SELECT CASE WHEN lam < 0.3 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE,
  (SELECT sum(CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0::DOUBLE * k * k * lam * lam)) FROM range(1, 9) r(k)))) END AS p FROM tlam"""


@query("threshold_dispatch", f"""
SELECT 'percentile' AS asked, 'percentile' AS method, {R("quantile_cont(score, 0.995)", "threshold")}, {R("least(1.0::DOUBLE, count(*) / 1000.0::DOUBLE)", "confidence")} FROM sc
UNION ALL SELECT 'evt', 'evt', {R("b.c + (b.xi / b.theta) / b.xi * (pow(1 - 0.999::DOUBLE, -b.xi) - 1)", "t")}, {R("p", "k")} FROM tbest b, tp
UNION ALL SELECT 'iqr', 'iqr', {R("quantile_cont(score, 0.75) + 1.5 * (quantile_cont(score, 0.75) - quantile_cont(score, 0.25))", "t")}, 0.8::DOUBLE FROM sc
UNION ALL SELECT 'std', 'std', {R("avg(score) + 3 * stddev_pop(score)", "t")}, 0.7::DOUBLE FROM sc
UNION ALL (SELECT 'cost', 'cost', {R("t", "t")}, {R("1 - cost / ((tp + fp + fn + tn) * 10.0::DOUBLE)", "k")} FROM costs ORDER BY costs.cost, i LIMIT 1)
UNION ALL SELECT 'few_samples', 'default', 0.52::DOUBLE, 0.5::DOUBLE""",
       sc=_SC, grid100=_GRID100, costs=_COSTS, tail=_TAIL, tstat=_TSTAT, tfit=_TFIT, tbest=_TBEST, tks=_TKS, tlam=_TLAM, tp=_TP)
def threshold_dispatch(spark, sf):
    """Every method by its name, the tail fit and the labelled cost among them, with confidence."""
    rows = T0.stage(_scores(spark, sf), "scores")
    few = A.events(spark, sf).filter("user = 'U5'").select((F.col("value") / 500).alias("score"))
    parts = [H.adaptive_threshold(rows, m, label="label" if m == "cost" else None).withColumn("asked", F.lit(m))
             for m in ("percentile", "evt", "iqr", "std", "cost")]
    parts.append(H.adaptive_threshold(few, "evt").withColumn("asked", F.lit("few_samples")))
    return rounded(reduce(lambda a, b: a.unionByName(b), parts), "threshold", "confidence")


@query("adaptive_thresholds", f"""
SELECT 'percentile' AS asked, 'percentile' AS method, {R("quantile_cont(score, 0.995)", "threshold")} FROM sc UNION ALL SELECT 'iqr', 'iqr', {R("quantile_cont(score, 0.75) + 1.5 * (quantile_cont(score, 0.75) - quantile_cont(score, 0.25))", "t")} FROM sc
UNION ALL SELECT 'std', 'std', {R("avg(score) + 3 * stddev_pop(score)", "t")} FROM sc UNION ALL SELECT 'cost_without_labels', 'percentile', {R("quantile_cont(score, 0.995)", "t")} FROM sc
UNION ALL SELECT 'few_samples', 'default', 0.52::DOUBLE""", sc=_SC)
def adaptive_thresholds(spark, sf):
    rows = _scores(spark, sf)
    # scores of one user: fewer than the minimum number of samples
    few = A.events(spark, sf).filter("user = 'U5'").select((F.col("value") / 500).alias("score"))
    named = lambda df, name: df.select(F.lit(name).alias("asked"), "method", "threshold")
    out = named(H.adaptive_threshold(rows, "percentile"), "percentile")
    for name, df in (("iqr", H.adaptive_threshold(rows, "iqr")), ("std", H.adaptive_threshold(rows, "std")),
                     ("cost_without_labels", H.adaptive_threshold(rows, "cost")), ("few_samples", H.adaptive_threshold(few, "percentile"))):
        out = out.unionByName(named(df, name))
    return rounded(out, "threshold")


@query("rolling_thresholds", f"""
SELECT {D("d", "update_day")}, n AS sample_size, {R("CASE WHEN n < 100 THEN 0.52 ELSE t END", "threshold")} FROM (
 SELECT d, CASE WHEN rn < 50 THEN an ELSE rn END AS n, CASE WHEN rn < 50 THEN aq ELSE rt END AS t FROM (
  SELECT u.d, count_if(s.d > u.d - 7) AS rn, count(*) AS an, quantile_cont(s.score, 0.995) FILTER (WHERE s.d > u.d - 7) AS rt, quantile_cont(s.score, 0.995) AS aq
  FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM sc) u JOIN (SELECT CAST(ts AS DATE) AS d, score FROM sc) s ON s.d <= u.d WHERE u.d > (SELECT max(CAST(ts AS DATE)) FROM sc) - 14 GROUP BY 1))""", sc=_SC)
def rolling_thresholds(spark, sf):
    return text_time(rounded(H.rolling_thresholds(_scores(spark, sf), "ts", "score"), "threshold"), "update_day")


_DRIFT_A = "SELECT value / 500 AS v, md5(CAST(event_id AS VARCHAR)) AS h FROM ev WHERE ts < (SELECT max(ts) FROM ev) - INTERVAL 18 DAY"
_DRIFT_B = "SELECT value / 500 AS v, md5(CAST(event_id AS VARCHAR)) AS h FROM ev WHERE ts >= (SELECT max(ts) FROM ev) - INTERVAL 18 DAY"
_SIZE = "SELECT least((SELECT count(*) FROM dra), (SELECT count(*) FROM drb)) AS n"
_PICK = "SELECT v FROM {t} QUALIFY row_number() OVER (ORDER BY h) <= (SELECT n FROM dsize)"
_CUM = """
SELECT v, a, b, (sum(a) OVER (ORDER BY v) - sum(b) OVER (ORDER BY v)) / (SELECT n FROM dsize)::DOUBLE AS gap
FROM (SELECT v, count_if(r = 1) AS a, count_if(r = 0) AS b FROM (SELECT v, 1 AS r FROM pa UNION ALL SELECT v, 0 FROM pb) GROUP BY 1)"""


def _two_periods(rows):
    """What is older than 18 days before the newest row, and the rest."""
    since = rollup.latest(rows, "ts") - F.expr("INTERVAL 18 DAYS")
    return rows.filter(F.col("ts") < since), rows.filter(F.col("ts") >= since)


@query("distribution_drift", f"""
SELECT (SELECT n FROM dsize) AS sample_size, {R("max(abs(gap))", "ks_statistic")}, {R("sum((a + b) * gap * gap) / 4", "cvm_statistic")},
  {R("(SELECT avg(v) FROM pb) - (SELECT avg(v) FROM pa)", "mean_difference")}, {R("(SELECT stddev_pop(v) FROM pb) - (SELECT stddev_pop(v) FROM pa)", "std_difference")} FROM dcum""",
       dra=_DRIFT_A, drb=_DRIFT_B, dsize=_SIZE, pa=_PICK.format(t="dra"), pb=_PICK.format(t="drb"), dcum=_CUM)
def distribution_drift(spark, sf):
    rows = _scores(spark, sf)
    old, new = _two_periods(rows)
    ks = H.distribution_drift(old, new, "score", "event_id", "ks")
    cvm = H.distribution_drift(old, new, "score", "event_id", "cvm").select("statistic").scalar()
    out = ks.select("sample_size", F.col("statistic").alias("ks_statistic"), cvm.alias("cvm_statistic"), "mean_difference", "std_difference")
    return rounded(out, "ks_statistic", "cvm_statistic", "mean_difference", "std_difference")


@query("distribution_drift_verdict")
def distribution_drift_verdict(spark, sf):
    """p-values are asymptotic, so this one has no SQL twin."""
    rows = _scores(spark, sf)
    old, new = _two_periods(rows)
    return H.distribution_drift(old, new, "score", "event_id", "ks").unionByName(
        H.distribution_drift(old, new, "score", "event_id", "cvm"))


# --- posterior ---------------------------------------------------------------------------
_POST = """
SELECT a.id, a.date, a.activity, r.role, a.hour, isodow(a.date) - 1 AS dow, (a.k + 3.0::DOUBLE) / 200 AS score, a.k FROM act a JOIN roster r USING ("user")"""
_INPUTS = """
SELECT *, CAST(k % 8 AS INTEGER) AS usb_events_7d, (k % 9) / 2.0::DOUBLE AS velocity, (k % 10) / 10.0::DOUBLE AS ahr, 1 - (k % 12) / 12.0::DOUBLE AS prod, (['Low', 'Medium', 'High', 'Critical'])[k % 4 + 1] AS lvl, (k % 5) * 0.9::DOUBLE AS mt, (k % 6) / 8.0::DOUBLE AS ka FROM post"""
_TIME = "CASE WHEN {h} < 7 OR {h} > 20 THEN 2.0::DOUBLE WHEN dow >= 5 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END"
_EVID = f"""
SELECT *, CASE WHEN score < 0.16 THEN 0.3::DOUBLE + 0.7::DOUBLE * (score / 0.16::DOUBLE) ELSE least(3.0::DOUBLE, 1 + 2 * ((score - 0.16::DOUBLE) / 0.12::DOUBLE)) END AS e_anomaly,
  {_TIME.format(h="hour")} AS e_time, {_TIME.format(h="15")} AS e_time2,
  CASE WHEN contains(activity, 'File Copy') THEN 4.0::DOUBLE WHEN contains(activity, 'Connect') THEN 3.0::DOUBLE WHEN contains(activity, 'File Delete') THEN 2.5::DOUBLE WHEN contains(activity, 'File Write') THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS e_activity,
  least(3.0::DOUBLE, 1 + CASE WHEN usb_events_7d > 3 THEN 0.25::DOUBLE * least(2.0::DOUBLE, usb_events_7d / 3.0::DOUBLE) ELSE 0 END + CASE WHEN velocity > 2 THEN 0.2::DOUBLE * least(1.5::DOUBLE, velocity / 2) ELSE 0 END + CASE WHEN ahr > 0.3::DOUBLE THEN 0.15::DOUBLE * (ahr / 0.3::DOUBLE) ELSE 0 END) AS e_behaviour,
  least(3.0::DOUBLE, (1 + CASE WHEN prod < 0.5 THEN 0.3::DOUBLE * (0.5 - prod) / 0.5 ELSE 0 END) * CASE lvl WHEN 'Critical' THEN 1.5::DOUBLE WHEN 'High' THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN mt > 3 OR ka > 0.5 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END) AS e_integrity,
  CASE role WHEN 'Admin' THEN 7.0::DOUBLE WHEN 'Contractor' THEN 6.0::DOUBLE ELSE 5.0::DOUBLE END AS pa, CASE role WHEN 'Admin' THEN 3.0::DOUBLE WHEN 'Contractor' THEN 4.0::DOUBLE ELSE 5.0::DOUBLE END AS pb FROM inp"""
_BETA = """
SELECT *, greatest(1.0::DOUBLE, pa * ev1) AS alpha, greatest(1.0::DOUBLE, pb * (2 - ev1)) AS beta, greatest(1.0::DOUBLE, pa * ev2) AS alpha2, greatest(1.0::DOUBLE, pb * (2 - ev2)) AS beta2 FROM (
 SELECT *, e_anomaly * 0.3::DOUBLE + e_time * 0.2::DOUBLE + e_activity * 0.25::DOUBLE + e_behaviour * 0.15::DOUBLE + e_integrity * 0.1::DOUBLE AS ev1,
  e_anomaly * 0.3::DOUBLE + e_time2 * 0.2::DOUBLE + e_activity * 0.25::DOUBLE + e_behaviour * 0.15::DOUBLE + e_integrity * 0.1::DOUBLE AS ev2 FROM evid)"""
_PT = {"post": _POST, "inp": _INPUTS, "evid": _EVID, "betas": _BETA}


def _posterior_rows(spark, sf):
    k = F.col("k")
    act = A.activity(spark, sf).join(A.roster(spark, sf).select("user", "role"), "user")
    return act.select(
        "id", "date", "activity", "role", F.hour("date").alias("hour"), F.lit(15).alias("other_hour"), F.weekday("date").alias("day_of_week"),
        ((k + 3.0) / 200).alias("anomaly_score"), (k % 8).alias("usb_events_7d"), ((k % 9) / 2).alias("file_op_velocity"),
        F.lit(1.0).alias("baseline_file_velocity"), ((k % 10) / 10).alias("after_hours_ratio"), (F.lit(1.0) - (k % 12) / 12).alias("productive_app_ratio"),
        F.element_at(F.array(*[F.lit(x) for x in ("Low", "Medium", "High", "Critical")]), (k % 4 + 1).cast("int")).alias("entropy_risk_level"),
        ((k % 5) * 0.9).alias("mouse_tortuosity_index"), ((k % 6) / 8).alias("keystroke_anomaly_score"))


@query("posterior_evidence", f"SELECT id, {R('e_anomaly')}, {R('e_time')}, {R('e_activity')}, {R('e_behaviour')}, {R('e_integrity')} FROM evid", **_PT)
def posterior_evidence(spark, sf):
    names = ["e_anomaly", "e_time", "e_activity", "e_behaviour", "e_integrity"]
    return rounded(posterior.risk_distribution(_posterior_rows(spark, sf)).select("id", *names), *names)


@query("posterior_risk", f"SELECT id, {R('alpha', digits=9)}, {R('beta', digits=9)}, {R('alpha / (alpha + beta) * 100', 'risk_mean', 9)}, {R('sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) * 100', 'risk_std', 9)} FROM betas", **_PT)
def posterior_risk(spark, sf):
    names = ["alpha", "beta", "risk_mean", "risk_std"]
    return rounded(posterior.risk_distribution(_posterior_rows(spark, sf)).select("id", *names), *names, digits=9)


@query("posterior_confidence", f"""
SELECT event_id, {R("greatest(0.1::DOUBLE, least(1.0::DOUBLE, 0.8::DOUBLE - CASE WHEN k % 5 = 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN k % 3 = 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN k % 7 = 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END))", "confidence")} FROM ev""")
def posterior_confidence(spark, sf):
    k = F.col("k")
    score = F.when(k % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    user, act = F.when(k % 5 != 0, F.col("user")), F.when(k % 3 != 0, F.col("event_type"))
    return rounded(A.events(spark, sf).select("event_id", PF.confidence(score, user, act, F.col("ts")).alias("confidence")), "confidence")


@query("what_if_comparison", f"""
SELECT id, {R("m2 - m1", "risk_difference")}, {R("m2 / greatest(0.01::DOUBLE, m1)", "risk_ratio")}, abs(m2 - m1) > 10 AS significant FROM (SELECT id, alpha / (alpha + beta) * 100 AS m1, alpha2 / (alpha2 + beta2) * 100 AS m2 FROM betas)""", **_PT)
def what_if_comparison(spark, sf):
    rows = posterior.compare_scenarios(_posterior_rows(spark, sf), "other_hour").select("id", "risk_difference", "risk_ratio", "significant")
    return rounded(rows, "risk_difference", "risk_ratio")


@query("posterior_sampled_percentiles")
def posterior_sampled_percentiles(spark, sf):
    rows = posterior.risk_distribution(_posterior_rows(spark, sf)).select("id", "alpha", "beta")
    q = posterior.posterior_percentiles("alpha", "beta").alias("q")
    pairs = rows.select("alpha", "beta").distinct().select("alpha", "beta", q)
    return rows.join(pairs, ["alpha", "beta"]).select("id", "q.p90", "q.p95", "q.p99")


# --- privacy -------------------------------------------------------------------------------
_SALT, _KEY = "example-salt", b"example-key-0123456789"


@query("masked_activity", f"""SELECT id, substring(sha256(concat('{_SALT}', "user")), 1, 32) AS "user", substring(sha256(concat('{_SALT}', pc)), 1, 32) AS pc FROM act""")
def masked_activity(spark, sf):
    return privacy.masked(A.activity(spark, sf), _SALT).select("id", "user", "pc")


@query("role_views", f"""SELECT id, "user", 'Admin' AS viewer FROM act UNION ALL SELECT id, substring(sha256(concat('{_SALT}', "user")), 1, 32), 'Analyst' FROM act""")
def role_views(spark, sf):
    act = A.activity(spark, sf).select("id", "user")
    views = [privacy.role_view(act, role, _SALT).withColumn("viewer", F.lit(role)) for role in ("Admin", "Analyst")]
    return views[0].unionByName(views[1])


_PAD = (_KEY.ljust(64, b"\0"))
_INNER = f"""unhex(sha256(unhex('{bytes(b ^ 0x36 for b in _PAD).hex()}') || encode(concat("user", ':day'))))"""
_HMAC = f"""translate(base64(unhex(sha256(unhex('{bytes(b ^ 0x5C for b in _PAD).hex()}') || {_INNER}))), '+/', '-_')"""


@query("pseudonymised_activity", f'SELECT id, {_HMAC} AS "user" FROM act')
def pseudonymised_activity(spark, sf):
    return privacy.pseudonymised(A.activity(spark, sf), _KEY, "day").select("id", "user")


@query("token_map", f'SELECT "user", {_HMAC} AS token FROM (SELECT DISTINCT "user" FROM act)')
def token_map(spark, sf):
    return privacy.token_map(A.activity(spark, sf), _KEY, "day")


def _requests(spark, sf):
    users = A.roster(spark, sf)
    key = F.col("user_key")
    real = token(F.col("user"), secret(spark, _KEY), "day")
    return users.select(
        "user_key", F.when(key % 5 == 0, "unknown-token").otherwise(real).alias("token"),
        F.when(key % 3 == 0, F.col("user")).when(key % 7 == 0, "U-other").alias("claimed_id"),
        F.concat(F.lit("operator"), key % 4).alias("operator"), F.when(key % 4 != 0, "approver").alias("approver"),
        F.lit("case").alias("justification"))


_REVERSE = """
SELECT user_key, CASE WHEN user_key % 4 = 0 THEN 'Dual-control approval required' WHEN user_key % 5 = 0 THEN 'De-pseudonymization not supported: token not found in reverse map'
  WHEN user_key % 3 <> 0 AND user_key % 7 = 0 THEN 'Verification failed: recovered ID does not match claimed original ID' END AS error, "user" FROM roster"""


@query("token_reverse_lookup", """SELECT user_key, error, error IS NULL AS success, CASE WHEN error IS NULL THEN "user" END AS recovered_id FROM rev""", rev=_REVERSE)
def token_reverse_lookup(spark, sf):
    tokens = privacy.token_map(A.roster(spark, sf), _KEY, "day")
    return privacy.reverse_lookup(_requests(spark, sf), tokens).select("user_key", "error", "success", "recovered_id")


@query("privacy_audit_trail", """SELECT 'depseudonymize' AS operation, concat('operator', user_key % 4) AS operator, CASE WHEN user_key % 4 <> 0 THEN 'approver' END AS approved_by, error IS NULL AS success, count(*) AS entries FROM rev GROUP BY ALL""", rev=_REVERSE)
def privacy_audit_trail(spark, sf):
    tokens = privacy.token_map(A.roster(spark, sf), _KEY, "day")
    answers = privacy.reverse_lookup(_requests(spark, sf), tokens)
    audit = privacy.audit_rows(answers, "depseudonymize", F.to_timestamp(F.lit("2024-02-01 00:00:00")))
    written = sinks.append_and_read(audit, "audit")
    return written.groupBy("operation", "operator", "approved_by", "success").agg(F.count("*").alias("entries"))


@query("encryption_round_trip", """SELECT id, "user", activity FROM act""")
def encryption_round_trip(spark, sf):
    act = A.activity(spark, sf).select("id", "user", "activity")
    keys = privacy.user_keys(act, _KEY)
    return privacy.decrypted(privacy.encrypted(act, keys, ["activity"]), keys, ["activity"])


@query("erased_users_unreadable", """SELECT id, "user", CASE WHEN r.role = 'Contractor' THEN NULL ELSE activity END AS activity FROM act JOIN roster r USING ("user")""")
def erased_users_unreadable(spark, sf):
    act = A.activity(spark, sf).select("id", "user", "activity")
    keys = privacy.user_keys(act, _KEY)
    gone = A.roster(spark, sf).filter("role = 'Contractor'").select("user")
    left, _ = privacy.erase(keys, gone)
    return privacy.decrypted(privacy.encrypted(act, keys, ["activity"]), left, ["activity"])


@query("access_decisions", """
SELECT user_key, role, action, reason IS NULL AS allowed, reason FROM (SELECT *, CASE WHEN role = 'Guest' THEN 'Unknown role: Guest' WHEN action = 'deanonymize' AND role NOT IN ('Admin', 'Compliance') THEN concat('Role ', role, ' cannot de-anonymize')
  WHEN action = 'erase' AND role <> 'Compliance' THEN concat('Role ', role, ' cannot erase') WHEN action <> 'read' AND user_key % 2 = 0 THEN 'Justification required' END AS reason
 FROM (SELECT user_key, (['Admin', 'Analyst', 'Viewer', 'Compliance', 'Guest'])[user_key % 5 + 1] AS role, (['read', 'deanonymize', 'erase'])[user_key % 3 + 1] AS action FROM roster))""")
def access_decisions(spark, sf):
    key = F.col("user_key")
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (key % len(names) + 1).cast("int"))
    requests = A.roster(spark, sf).select(
        "user_key", pick(["Admin", "Analyst", "Viewer", "Compliance", "Guest"]).alias("role"), F.lit("report").alias("resource"),
        pick(["read", "deanonymize", "erase"]).alias("action"), F.when(key % 2 == 1, "case").alias("justification"))
    return privacy.access_decisions(requests, privacy.policy_table(spark)).select("user_key", "role", "action", "allowed", "reason")


@query("erasure_audit", """SELECT 'erase' AS operation, "user" AS subject, "user" IN (SELECT "user" FROM act) AS success FROM people WHERE role = 'Contractor'""")
def erasure_audit(spark, sf):
    """Every request leaves an audit row, also for people without a key."""
    keys = privacy.user_keys(A.activity(spark, sf).select("user"), _KEY)
    _, audit = privacy.erase(keys, A.people(spark, sf).filter("role = 'Contractor'").select("user"))
    rows = audit.select(F.lit("erase").alias("operation"), F.col("user").alias("subject"), "success")
    return sinks.append_and_read(rows, "audit")


@query("access_audit", """
SELECT action AS operation, reason IS NULL AS success, reason AS error, count(*) AS entries FROM (SELECT *, CASE WHEN role = 'Guest' THEN 'Unknown role: Guest' WHEN action = 'deanonymize' AND role NOT IN ('Admin', 'Compliance') THEN concat('Role ', role, ' cannot de-anonymize')
  WHEN action = 'erase' AND role <> 'Compliance' THEN concat('Role ', role, ' cannot erase') WHEN action <> 'read' AND user_key % 2 = 0 THEN 'Justification required' END AS reason
 FROM (SELECT user_key, (['Admin', 'Analyst', 'Viewer', 'Compliance', 'Guest'])[user_key % 5 + 1] AS role, (['read', 'deanonymize', 'erase'])[user_key % 3 + 1] AS action FROM roster)) GROUP BY ALL""")
def access_audit(spark, sf):
    """Every access decision leaves an audit row."""
    decisions = access_decisions(spark, sf)
    rows = decisions.select(F.col("action").alias("operation"), F.col("role").alias("operator"),
                            F.col("allowed").alias("success"), F.col("reason").alias("error"))
    return sinks.append_and_read(rows, "audit").groupBy("operation", "success", "error").agg(F.count("*").alias("entries"))


# --- sampling --------------------------------------------------------------------------------
_VECS = "SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings"
_PAIRS = """
SELECT a.label, a.id, b.id AS neighbour, sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance
FROM vecs a JOIN vecs b ON a.label = b.label AND a.id <> b.id"""
_NEAR = "SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS nth FROM pairs QUALIFY nth <= 5"


def _vectors(spark, sf):
    return A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec"))


@query("nearest_in_class", f"SELECT label, id, nth, neighbour, {R('distance')} FROM nearest", vecs=_VECS, pairs=_PAIRS, nearest=_NEAR)
def nearest_in_class(spark, sf):
    rows = sampling.nearest_in_class(_vectors(spark, sf), 5)
    return rounded(rows.withColumn("nth", F.col("nth").cast("long")), "distance")


_MIN = "SELECT id, vec, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) AS position, count(*) OVER () AS n FROM vecs WHERE label = 0"
_NEED = "SELECT greatest(0, CAST(floor(count_if(label <> 0) * (0.3::DOUBLE / 0.7::DOUBLE) + 1e-9) AS BIGINT) - count_if(label = 0)) AS wanted FROM vecs"
_SMOTE = """
SELECT s.sample, s.id AS base, nr.neighbour, s.gap, s.vec, o.vec AS other FROM (
  SELECT m.*, j.sample, (('0x' || substring(md5(concat('near:', j.sample)), 1, 8))::BIGINT) % least(5, m.n - 1) + 1 AS pick, (('0x' || substring(md5(concat('gap:', j.sample)), 1, 8))::BIGINT) / 4294967296.0::DOUBLE AS gap
  FROM minr m JOIN (SELECT unnest(range(1, wanted + 1)) AS sample FROM need) j ON (j.sample - m.position) % m.n = 0 AND j.sample >= m.position) s
JOIN nearest nr ON nr.id = s.id AND nr.nth = s.pick JOIN vecs o ON o.id = nr.neighbour"""
_SM = {"vecs": _VECS, "pairs": _PAIRS, "nearest": _NEAR, "minr": _MIN, "need": _NEED, "smote": _SMOTE}


def _binary(spark, sf):
    return _vectors(spark, sf).withColumn("label", (F.col("label") == 0).cast("int"))


@query("synthetic_minority", f"""SELECT sample, base, neighbour, {R("gap")}, {R("vec[1] + gap * (other[1] - vec[1])", "first_value")} FROM smote""", **_SM)
def synthetic_minority(spark, sf):
    rows = T0.stage(_binary(spark, sf), "vectors")
    made = sampling.synthetic_minority(rows.filter("label = 1").select("id", "vec"), sampling.rows_needed(rows, "label", 0.3))
    return rounded(made.select("sample", "base", "neighbour", "gap", F.col("vec")[0].alias("first_value")), "gap", "first_value")


@query("balanced_classes", "SELECT CAST(label = 0 AS INTEGER) AS label, FALSE AS is_synthetic, count(*) AS n FROM vecs GROUP BY ALL UNION ALL SELECT 1, TRUE, wanted FROM need", vecs=_VECS, need=_NEED)
def balanced_classes(spark, sf):
    return sampling.balanced(T0.stage(_binary(spark, sf), "vectors")).groupBy("label", "is_synthetic").agg(F.count("*").alias("n"))


@query("stratified_split", "SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) <= floor(count(*) OVER (PARTITION BY label) * 0.8::DOUBLE) AS in_train FROM se", se=_EVAL)
def stratified_split(spark, sf):
    return sampling.stratified_split(_scored_events(spark, sf).select("event_id", "label"), "event_id", "label")


@query("user_split", """SELECT id, in_train FROM act JOIN (SELECT "user", row_number() OVER (ORDER BY md5("user"), "user") <= floor(count(*) OVER () * 0.8::DOUBLE) AND "user" <> 'U5' AS in_train FROM (SELECT DISTINCT "user" FROM act)) USING ("user")""")
def user_split(spark, sf):
    return sampling.user_split(A.activity(spark, sf).select("id", "user"), "U5").select("id", "in_train")

"""All models on rows they have not learned from: one split, one table of scores, one row of metrics per model."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conductrisk import config as C
from conductrisk.operators import evaluation as E
from conductrisk.operators import models as M
from conductrisk.operators import sampling, sequence_models, sequences
from conductrisk.session import stage

#: Trees of the boosted model: they are fitted one after the other.
BOOSTED_TREES = 20
CLASSIFIERS = ["boosted_trees", "random_forest", "sequence_classifier"]
DETECTORS = ["isolation_forest", "kernel_density", "sequence_model"]
OUTLIER_SIGMAS = 2.0


def split_days(labelled: DataFrame, share: float = 0.8) -> DataFrame:
    """Days with `key` and `in_train`, chosen by the key's hash with the same share of both labels; written once."""
    keyed = labelled.withColumn("key", F.concat_ws(":", "user", "day"))
    return stage(sampling.stratified_split(keyed, "key", "label", share), "split-days")


def scores(days: DataFrame, trees: int = BOOSTED_TREES) -> DataFrame:
    """model, user, day, label, score (higher: label 1 is likelier) of the held-out days; written once.

    Classifiers and the forests of the detectors are fitted on the training days only. A sequence belongs to the part of its
    last day. The density and the sequence model see no label; their moments are those of all days.
    """
    train, held = days.filter("in_train"), days.filter("not in_train")
    out = lambda df, model, score: df.select(
        F.lit(model).alias("model"), "user", "day", F.col("label").cast("int").alias("label"), F.expr(score).alias("score"))
    has_both = train.agg(F.min("label") != F.max("label")).first()[0]
    parts = []
    if has_both:  # a classifier needs both labels
        for name, fit in (("boosted_trees", lambda: M.fit_boosted(train, C.CORE_FEATURES, trees=trees)),
                          ("random_forest", lambda: M.fit_forest_classifier(train, C.CORE_FEATURES, trees=trees))):
            parts.append(out(M.probability(fit(), held, C.CORE_FEATURES, "p"), name, "p"))
        built = sequences.labelled_sequences(days, C.LABELLED_SEQUENCE_LENGTH)
        seqs = stage(built.select("user", "day", "in_train", "sequence", "sequence_label"), "split-sequences")
        learned = seqs.filter("in_train")
        if learned.agg(F.min("sequence_label") != F.max("sequence_label")).first()[0]:
            parts.append(out(M.score_sequences(M.fit_sequence_classifier(learned), seqs.filter("not in_train")).withColumn(
                "label", F.col("sequence_label")), "sequence_classifier", "p"))
    forest = M.fit_forest(train, C.CORE_FEATURES, "key")
    parts.append(out(M.score_forest(held, forest, C.CORE_FEATURES), "isolation_forest", "-decision"))
    parts.append(out(M.kernel_scores(days, C.CORE_FEATURES).filter("not in_train"), "kernel_density", "-decision"))
    errors = sequence_models.score(days, sequence_models.fit(days))
    parts.append(out(errors.filter("not in_train and global_error is not null"), "sequence_model", "coalesce(own_error, global_error)"))
    return stage(reduce(lambda a, b: a.unionByName(b), parts), "held-out-scores")


def metrics(scored: DataFrame) -> DataFrame:
    """Confusion, rates and AUC per model of `scores`. Classifiers are cut at one half, detectors at the mean and two deviations.

    Each model's scores are ranked by short jobs that wait for each other, so the models are handled side by side.
    """

    def of_model(model: str) -> DataFrame | None:
        rows = scored.filter(F.col("model") == model).select("label", "score")
        if rows.isEmpty():
            return None
        cut = 0.5 if model in CLASSIFIERS else E.deviation_cut(rows, "score", OUTLIER_SIGMAS)
        return E.model_metrics(rows, model, "score", cut)

    models = [*CLASSIFIERS, *DETECTORS]
    with ThreadPoolExecutor(len(models)) as pool:
        found = list(pool.map(inheritable_thread_target(scored.sparkSession)(of_model), models))
    return reduce(lambda a, b: a.unionByName(b), [x for x in found if x is not None])

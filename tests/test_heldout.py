"""Models on held-out days: nothing is learned from them, and metrics follow from the stored scores."""

import datetime as dt
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from conductrisk import config as C
from conductrisk.operators import heldout


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(0)
    rows = []
    for u in range(12):
        for d in range(30):
            bad = u == 5 and d >= 10
            values = rng.normal(5 + 20 * bad, 1, len(C.DAILY_FEATURES))
            rows.append((f"U{u}", ["Admin", "Employee"][u % 2], dt.date(2024, 1, 1) + dt.timedelta(days=d), int(bad), *map(float, values)))
    schema = "user string, role string, day date, label int, " + ", ".join(f"{f} double" for f in C.DAILY_FEATURES)
    return spark.createDataFrame(rows, schema)


def test_scores_and_metrics(labelled):
    days = heldout.split_days(labelled)
    held = {(r.user, r.day): r.label for r in days.filter("not in_train").collect()}
    assert len(held) == 360 - int(340 * 0.8) - int(20 * 0.8) and sum(held.values()) == 4
    table = heldout.scores(days, trees=5)
    by_model = {}
    for r in table.collect():
        assert held[r.user, r.day] == r.label
        by_model.setdefault(r.model, {})[r.user, r.day] = (r.score, r.label)
    assert set(by_model) == {*heldout.CLASSIFIERS, *heldout.DETECTORS}
    for model in ("boosted_trees", "random_forest", "isolation_forest", "kernel_density"):
        assert set(by_model[model]) == set(held)
    for r in heldout.metrics(table).collect():
        score, label = map(np.array, zip(*by_model[r.model].values(), strict=True))
        cut = 0.5 if r.model in heldout.CLASSIFIERS else score.mean() + 2 * score.std()
        hit = score > cut
        assert (r.tp, r.fp, r.fn, r.tn) == tuple(int(x.sum()) for x in (hit & (label == 1), hit & (label == 0), ~hit & (label == 1), ~hit & (label == 0)))
        pairs = score[label == 1][:, None] - score[label == 0][None]
        assert r.roc_auc == pytest.approx(((pairs > 0) + 0.5 * (pairs == 0)).mean())
        assert r.roc_auc > 0.9 or r.model not in ("boosted_trees", "random_forest", "sequence_classifier")


def test_held_out_labels_teach_nothing(labelled):
    """Labels of held-out days may be anything: their scores stay."""
    days = heldout.split_days(labelled)
    other = days.withColumn("label", F.when(F.col("in_train"), F.col("label")).otherwise(1 - F.col("label")))
    found = [{(r.model, r.user, r.day): r.score for r in heldout.scores(x, trees=3).collect()} for x in (days, other)]
    assert set(found[0]) == set(found[1])
    for key, score in found[0].items():
        assert score == pytest.approx(found[1][key], abs=1e-9), key


def test_without_positives_only_detectors_score(labelled):
    table = heldout.scores(heldout.split_days(labelled.withColumn("label", F.lit(0))), trees=3)
    assert {r.model for r in table.select("model").distinct().collect()} == set(heldout.DETECTORS)


def test_models_are_measured_side_by_side(spark, monkeypatch):
    """The short jobs of one model don't wait for those of another."""
    together = threading.Barrier(2, timeout=30)
    whole = heldout.E.model_metrics

    def measured(*args):
        together.wait()
        return whole(*args)

    monkeypatch.setattr(heldout.E, "model_metrics", measured)
    rows = [(m, i % 2, float(i % 2) + 0.1 * (i % 3)) for m in ("random_forest", "kernel_density") for i in range(20)]
    found = heldout.metrics(spark.createDataFrame(rows, "model string, label int, score double")).collect()
    assert [r.model for r in found] == ["random_forest", "kernel_density"] and all(r.roc_auc == 1 for r in found)

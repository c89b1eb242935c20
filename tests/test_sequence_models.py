"""One-pass sequence models against models of sequences that are really built."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conductrisk import config as C
from conductrisk.operators import sequence_models as M
from conductrisk.operators import sequences

LENGTH = 4
FEATURES = ["f0", "f1", "f2"]
SCHEMA = "user string, role string, day date, note string, f0 double, f1 double, f2 double"


def build(rng, users):
    """(rows, series by user); series shorter, as long as and much longer than a sequence."""
    rows, series = [], {}
    for u, (role, days) in enumerate(users):
        x = rng.normal(size=(days, 3)).cumsum(axis=0) + [0, 100, -3]
        x[:, 2] = 7  # a constant feature
        series[f"U{u}"] = (role, x)
        rows += [(f"U{u}", role, dt.date(2024, 1, 1) + dt.timedelta(days=2 * d), "n", *map(float, x[d])) for d in range(days)]
    return rows, series


def plainly(series, latent, roles):
    """(models, {(user, index of the day): (own, global)}) from sequences that are built."""
    windows = [(u, role, i, x[i - LENGTH + 1:i + 1]) for u, (role, x) in series.items() for i in range(LENGTH - 1, len(x))]
    models, errors = {}, {}
    for name in [*roles, "global"]:
        own = [w for _, role, _, w in windows if name in ("global", role)]
        if not own:
            continue
        flat = np.stack(own)
        mean, scale = flat.mean(axis=(0, 1)), flat.std(axis=(0, 1))
        scale[scale < 1e-5] = 1.0
        z = ((flat - mean) / scale).reshape(len(own), -1)
        value, vector = np.linalg.eigh(np.cov(z.T, bias=True).reshape(z.shape[1], -1))
        models[name] = (len(own), mean, scale, np.sort(value)[::-1], vector[:, np.argsort(-value)[:latent]])
    for u, role, i, w in windows:
        for at, name in ((0, role if role in roles else None), (1, "global")):
            if name in models:
                _, mean, scale, _, v = models[name]
                z = ((w - mean) / scale).ravel()
                errors.setdefault((u, i), [None, None])[at] = ((z - v @ (v.T @ z)) ** 2).mean()
    return models, errors


@pytest.mark.parametrize("batch", [7, 10_000])
@pytest.mark.parametrize("latent", [0, 3])
def test_equals_built_sequences(spark, batch, latent):
    rng = np.random.default_rng(1)
    users = [("Admin", 30), ("Admin", 3), ("Employee", 4), ("Employee", 5), ("Employee", 9), ("Guest", 12), (None, 8), ("Contractor", 2),
             ("Admin", 1), ("Employee", 60)]
    rows, series = build(rng, users)
    daily = spark.createDataFrame(rows, SCHEMA).repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)  # users are cut by the ends of batches
    try:
        table = M.fit(daily, latent, FEATURES, LENGTH)
        scored = M.score(daily, table, FEATURES, LENGTH, with_latent=True).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    models, errors = plainly(series, latent, C.MODEL_ROLES)
    got = {r.model: r for r in table.collect()}
    assert set(got) == set(models) == {"Admin", "Employee", "global"}
    for name, (n, mean, scale, value, _) in models.items():
        assert got[name].n_sequences == n and len(got[name].components) <= latent
        assert np.allclose(got[name].mean, mean) and np.allclose(got[name].scale, scale)
        assert np.allclose(got[name].eigenvalues, value, atol=1e-8)
    assert len(scored) == len(rows) and all(r.note == "n" for r in scored)
    for r in scored:
        own, everyone = errors.get((r.user, (r.day - dt.date(2024, 1, 1)).days // 2), (None, None))
        for mine, want in ((r.own_error, own), (r.global_error, everyone)):
            assert (mine is None) == (want is None)
            assert want is None or mine == pytest.approx(want, abs=1e-8)
        assert (r.latent is None) == (everyone is None)


def test_variance_law_and_more_components(spark):
    """The mean error is what the components leave of the total variance, and of the means of the places."""
    rows, series = build(np.random.default_rng(2), [("Admin", 40), ("Employee", 50), ("Guest", 20)])
    daily = spark.createDataFrame(rows, SCHEMA)
    last = None
    for latent in (0, 2, 5):
        table = M.fit(daily, latent, FEATURES, LENGTH)
        model = table.filter("model = 'global'").first()
        flat = np.stack([x[i - LENGTH + 1:i + 1] for _, x in series.values() for i in range(LENGTH - 1, len(x))])
        mu = ((flat - model.mean) / model.scale).reshape(len(flat), -1).mean(axis=0)
        w = np.array(model.components).reshape(latent, -1) if latent else np.zeros((0, LENGTH * 3))
        left = sum(model.eigenvalues) + mu @ mu - sum(model.eigenvalues[:latent]) - ((w @ mu) ** 2).sum()
        mean = M.score(daily, table, FEATURES, LENGTH).agg(F.avg("global_error")).first()[0]
        assert mean == pytest.approx(left / (LENGTH * 3), rel=1e-9)
        assert last is None or mean < last
        last = mean


def test_no_components_equal_the_scaler_errors(spark):
    rows, _ = build(np.random.default_rng(3), [("Admin", 25), ("Employee", 3), ("Guest", 14)])
    daily = spark.createDataFrame(rows, SCHEMA)
    mine = M.score(daily, M.fit(daily, 0, FEATURES, LENGTH), FEATURES, LENGTH)
    key = lambda r: (r.user, r.day)
    for a, b in zip(sorted(mine.collect(), key=key), sorted(sequences.sequence_errors(daily, FEATURES, LENGTH).collect(), key=key), strict=True):
        assert (a.own_error, a.global_error) == pytest.approx((b.own_error, b.global_error), nan_ok=True)


def test_empty_and_short(spark):
    empty = spark.createDataFrame([], SCHEMA)
    table = M.fit(empty, 3, FEATURES, LENGTH)
    assert table.collect() == [] and M.score(empty, table, FEATURES, LENGTH).collect() == []
    rows, _ = build(np.random.default_rng(4), [("Admin", 3), ("Employee", 2)])
    daily = spark.createDataFrame(rows, SCHEMA)
    table = M.fit(daily, 3, FEATURES, LENGTH)
    assert table.collect() == []
    assert {(r.own_error, r.global_error) for r in M.score(daily, table, FEATURES, LENGTH).collect()} == {(None, None)}

"""Skew-safe operators against plain windows, with one key holding a third of all rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conductrisk.operators import ordered as O


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        user = "hot" if i % 3 == 0 else f"u{int(rng.integers(40))}"
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=float(rng.integers(0, 9 * 86400)) + (i % 7) * 0.25)
        rows.append((i, user, ts, float(np.round(rng.lognormal(3, 1), 1)), ["view", "click"][i % 2]))
    return spark.createDataFrame(rows, "id long, user string, ts timestamp, value double, kind string").cache()


def same(a, b):
    b = b.select(a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("hot_rows", [7, 50, 10_000])
def test_lag_across_slices(events, hot_rows):
    got = O.previous(events, ["user"], "ts", "id", {"before": "id"}, hot_rows)
    want = events.withColumn("before", F.lag("id").over(W.partitionBy("user").orderBy("ts", "id")))
    assert same(got, want)


@pytest.mark.parametrize("hot_rows", [5, 40])
def test_frames_across_slices(events, hot_rows):
    build = lambda w: {"n": F.count("*").over(w.rowsBetween(-9, 0)), "ids": F.collect_list("id").over(w.rowsBetween(-9, 0))}
    got = O.framed(events, ["user"], "ts", "id", 9, build, hot_rows)
    assert same(got, events.withColumns(build(W.partitionBy("user").orderBy("ts", "id"))))


def test_a_burst_is_cut_by_count(spark, monkeypatch):
    """One key has nearly all its rows within ten minutes, and single rows days before and after."""
    import datetime as dt
    start = dt.datetime(2024, 1, 1)
    rows = [("hot", i, start + dt.timedelta(seconds=(i * 37 % 600) + i / 1000)) for i in range(3000)]
    rows += [("hot", 5000 + i, start + dt.timedelta(days=i - 20)) for i in range(40)]
    rows += [("cold", 9000 + i, start + dt.timedelta(hours=i)) for i in range(50)]
    df = spark.createDataFrame(rows, "user string, id long, ts timestamp")
    seen = []

    def build(w):
        slice_size = F.count("*").over(W.partitionBy("user", "__slice"))
        return {"before": F.lag("id").over(w), "third": F.lag("id", 3).over(w), "slice_size": slice_size}

    got = O.framed(df, ["user"], "ts", "id", 3, build, hot_rows=100)
    seen = got.groupBy("user").agg(F.max("slice_size").alias("m"), F.count("*").alias("n")).collect()
    order = W.partitionBy("user").orderBy("ts", "id")
    want = df.withColumns({"before": F.lag("id").over(order), "third": F.lag("id", 3).over(order)})
    assert same(got.drop("slice_size"), want)
    sizes = {r.user: (r.m, r.n) for r in seen}
    assert sizes["hot"][1] == 3040 and sizes["hot"][0] <= 2 * 100 + 3 and sizes["cold"] == (50, 50)


def test_rolling_counts(events):
    measures = {"v1": (F.col("kind") == "view", 1), "v24": (F.col("kind") == "view", 24), "all7d": (F.lit(True), 168)}
    got = O.rolling_counts(events, "user", "ts", measures)
    frame = lambda h: W.partitionBy("user").orderBy(F.unix_seconds("ts")).rangeBetween(-h * 3600, 0)
    want = events.withColumns({n: F.count_if(c).over(frame(h)) for n, (c, h) in measures.items()})
    assert same(got, want)


@pytest.mark.parametrize("accuracy", [50, 100_000])
def test_percentiles_are_exact(events, accuracy):
    probs = [0.0, 0.25, 0.5, 0.9, 0.995, 1.0]
    values = np.array([r.value for r in events.select("value").collect()])
    got = O.percentiles(events, "value", probs, accuracy=accuracy).first()
    assert got.n == 900 and got.p == pytest.approx(list(np.percentile(values, [100 * p for p in probs])))


@pytest.mark.parametrize("max_groups", [None, 50])
def test_percentiles_by_group(events, max_groups):
    got = {r.user: r.p for r in O.percentiles(events, "value", [0.1, 0.5], ["user"], max_groups, accuracy=50).collect()}
    rows = events.select("user", "value").collect()
    for user in got:
        mine = [r.value for r in rows if r.user == user]
        assert got[user] == pytest.approx(list(np.percentile(mine, [10, 50])))


@pytest.mark.parametrize("by", [None, ["g"]])
def test_percentiles_of_many_values_in_bounded_tasks(spark, by):
    """Two million distinct values and a coarse sketch: the remainder is dealt in ranges, no task gets a large part of it."""
    n, task = 2_000_000, 20_000
    df = spark.range(n).select(  # one group has a third of the rows, another is null
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, None).otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"),
        ((F.xxhash64("id") % 1_000_003) / 7 + F.col("id") / 1e9).alias("v"))
    probs = [0.001, 0.25, 0.5, 0.501, 0.995]
    seen, plain = [], O._in_ranges

    def watched(runs, by, value, task_rows):
        placed = plain(runs, by, value, task_rows)
        seen.append((placed.count(), placed.groupBy("__range").count().agg(F.max("count")).first()[0]))
        return placed

    O._in_ranges = watched
    try:
        got = {r["g"] if by else "": r for r in O.percentiles(df, "v", probs, by, accuracy=100, task_rows=task).collect()}
    finally:
        O._in_ranges = plain
    rows, largest = seen[0]
    assert rows > 10 * task and largest <= 3 * task
    pdf = df.toPandas()
    groups = pdf.groupby(pdf.g.fillna("null")) if by else [("", pdf)]
    want = {None if k == "null" else k: (len(x), np.percentile(x.v, [100 * p for p in probs])) for k, x in groups}
    assert set(got) == set(want)
    for k, (size, p) in want.items():
        assert got[k].n == size and got[k].p == pytest.approx(list(p), rel=1e-12)


def test_percentiles_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, v double")
    nulls = spark.createDataFrame([("a", None)], "g string, v double")
    for df in (empty, nulls):
        assert [(r.n, r.p) for r in O.percentiles(df, "v", [0.5]).collect()] == [(None, [])]
        assert O.percentiles(df, "v", [0.5], ["g"]).collect() == []


def test_cumulative_counts(events):
    got = {r.value: (r.c, r.below_c) for r in O.cumulative(events, "value", {"c": F.count("*")}, 8).collect()}
    values = np.array([r.value for r in events.select("value").collect()])
    assert got == {v: (int((values == v).sum()), int((values < v).sum())) for v in set(values.tolist())}


def test_total_rank_with_a_hot_score(events):
    df = events.withColumn("score", F.when(F.col("user") == "hot", 0.0).otherwise(F.floor(F.col("value") / 20).cast("double")))
    order = [F.desc("score"), F.md5(F.col("id").cast("string"))]
    want = df.withColumns({
        "rank": F.rank().over(W.orderBy(F.desc("score"))).cast("long"),
        "position": F.row_number().over(W.orderBy(*order)).cast("long")})
    assert same(O.total_rank(df, "score", "id", 8), want)


def test_smallest_hashes(events):
    df = events.withColumn("h", F.md5(F.col("id").cast("string")))
    got = {r.id for r in O.smallest(df, "h", F.lit(123)).collect()}
    assert got == {r.id for r in df.orderBy("h").limit(123).collect()}


def test_split_is_exact_per_group(events):
    rows = O.split(events, "id", 0.8, ["user"]).groupBy("user").agg(F.count("*").alias("n"), F.count_if("in_first").alias("k")).collect()
    assert all(r.k == int(r.n * 0.8) for r in rows)


def test_no_single_partition_exchange_of_rows(events):
    """The lag of a hot key is cut into slices: the window is keyed by user and slice."""
    plan = O.previous(events, ["user"], "ts", "id", {"before": "id"}, 10)._jdf.queryExecution().toString()
    assert "__slice" in plan and "SinglePartition" not in plan

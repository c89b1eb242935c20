"""Work that must not grow faster than the input."""

import math
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conductrisk.llm import lm
from conductrisk.operators import models as M
from conductrisk.operators import sampling as S
from conductrisk.operators import telemetry as L
from conductrisk.plans import stream_queries
from conductrisk.plans import tables as T0
from conductrisk.streaming import runner


@pytest.mark.parametrize("shard_bytes", [10_000, 16_000_000])
def test_a_row_goes_once_to_a_shard(spark, monkeypatch, shard_bytes):
    """Vectors without structure: nearly all blocks are in reach, but a row is sent once per shard, and the result is exact."""
    rng = np.random.default_rng(4)
    pts = rng.normal(size=(600, 12))
    df = spark.createDataFrame([(0, i, p.tolist()) for i, p in enumerate(pts)], "label int, id long, vec array<double>").repartition(3)
    written, plain = {}, S.stage
    monkeypatch.setattr(S, "stage", lambda d, name: written.setdefault(name, plain(d, name)))
    got = {}
    for r in S.nearest_in_class(df, 3, block_rows=25, shard_bytes=shard_bytes).collect():
        got.setdefault(r.id, []).append((r.nth, r.neighbour, r.distance))
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for i in range(600):
        want = np.argsort(d[i])[:3]
        assert [n for _, n, _ in sorted(got[i])] == want.tolist()
        assert [x for *_, x in sorted(got[i])] == pytest.approx(d[i][want].tolist())
    assert "vec" not in written["asked"].columns
    if shard_bytes == 16_000_000:
        assert written["asked"].count() <= 600


def test_kernel_maps_are_made_by_batch(spark):
    """Densities of the definition; no row-by-row lambda, and the percentile reads written densities."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double").repartition(4)
    out = M.kernel_scores(df, ["a", "b", "c"], 0.1, size=16)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "density_of" not in plan
    again = np.random.default_rng(M.SEED)
    w, shift = again.normal(0, math.sqrt(2 / 3), (16, 3)), again.uniform(0, 2 * math.pi, 16)
    z = np.cos((x - x.mean(axis=0)) / x.std(axis=0) @ w.T + shift) * math.sqrt(2 / 16)
    density = z @ z.mean(axis=0)
    want = density - np.quantile(density, 0.1)
    got = {r.id: (r.decision, r.prediction) for r in out.collect()}
    assert [got[i][0] for i in range(500)] == pytest.approx(want.tolist(), abs=1e-9)
    assert sum(p for _, p in got.values()) == 400


def test_kernel_scores_of_no_rows(spark):
    df = spark.createDataFrame([], "id long, a double")
    assert M.kernel_scores(df, ["a"]).count() == 0


def test_large_slices_are_several_files_and_batches_whole_slices(spark, tmp_path, monkeypatch):
    """Slices of many rows are written and read by several tasks; batches end where slices do, also after a slice with few rows."""
    monkeypatch.setattr(runner, "FILE_ROWS", 50)
    # half of the rows have one time, so some slices are tiny
    at = lambda i: datetime(2024, 1, 1) + timedelta(seconds=i if i < 300 else 300 if i < 598 else i)
    df = spark.createDataFrame([(i, at(i)) for i in range(600)], "id long, date timestamp").repartition(3)
    path = str(tmp_path / "replay")
    files = runner.stage_replay(df, path, 4, unit=1_000_000)
    assert files == 3
    found = runner.run_to_table(runner.replay(spark, path, "id long, date timestamp", files), "again", path=str(tmp_path / "out"),
                                state=str(tmp_path / "state"))
    batches = found.groupBy("batch_id").agg(F.min("date").alias("a"), F.max("date").alias("b"), F.count("*").alias("n")).orderBy("batch_id").collect()
    assert sum(r.n for r in batches) == 600 and found.select("id").distinct().count() == 600
    assert all(x.b < y.a for x, y in zip(batches, batches[1:]))
    assert max(r.n for r in batches) >= 298
    read = spark.read.parquet(path).withColumn("f", F.input_file_name()).groupBy("f").count()
    assert read.count() > len(batches)


def test_small_replays_keep_one_file_per_slice(spark, tmp_path):
    df = spark.range(40).select(F.timestamp_seconds("id").alias("date"))
    assert runner.stage_replay(df, str(tmp_path / "small"), 4) == 1
    assert len(list((tmp_path / "small").glob("*.parquet"))) == 4


def test_rows_without_a_feature_leave_the_kernel_density_alone(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(70)] + [(70, None, 1.0)], "id long, a double, b double")
    got = {r.id: r for r in M.kernel_scores(df, ["a", "b"], 0.1, size=8).collect()}
    assert got[70].decision is None and got[70].prediction is None
    assert all(got[i].decision is not None and got[i].prediction in (-1, 1) for i in range(70))


def test_codes_of_a_block_are_made_a_megabyte_at_a_time(monkeypatch):
    """The codes do not depend on the pieces, and no piece is larger than what is counted at once."""
    texts = [f"some words of text {i} and a few more" for i in range(200)]
    table = pa.table({"row": pa.array([{"doc_id": i, "text": x} for i, x in enumerate(texts)]), "block": pa.array([0] * 200)})
    whole = lm._codes_of_block(3, 1)(table)
    seen, plain = [], lm.symbols
    monkeypatch.setattr(lm, "COUNT_BYTES", 500)
    monkeypatch.setattr(lm, "symbols", lambda t: seen.append(sum(map(len, t.to_pylist()))) or plain(t))
    assert lm._codes_of_block(3, 1)(table) == whole
    assert len(seen) > 1 and max(seen) <= 500


def _telemetry_rows(spark, n=400):
    return spark.range(n).select(
        "id", F.concat(F.lit("U"), F.col("id") % 3).alias("user_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 4001).alias("timestamp"),
        F.element_at(F.array(*[F.lit(a) for a in ("Excel.exe", "Netflix", "Terminal", "Telegram")]), (F.col("id") % 4 + 1).cast("int")).alias("active_app"),
        F.lit("Developer").alias("role"), *[(F.col("id") % m).cast("double").alias(c) for m, c in zip((7, 5, 11, 13), list(L.MEASURES.values())[:4])])


def test_an_application_is_lowered_once_per_row(spark):
    """Fifty words are looked for in a column, not in an expression that each of them evaluates again."""
    rows = L.with_productivity(_telemetry_rows(spark))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    scored = L.score(rows.withColumns({"has_baseline": F.col("id") > 5, **{n: F.lit(2.0) for n in L.MEASURES}}))
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 2
    assert not [c for c in scored.columns if c.startswith("__")]
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_stored_telemetry_has_what_is_read(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(T0, "telemetry", lambda *_: L.score(L.with_productivity(_telemetry_rows(spark)).withColumns({
        "has_baseline": F.lit(False), **{n: F.lit(2.0) for n in L.MEASURES}, **{c: F.lit(None).cast("string") for c in ("window_title", "process_id")},
        "keystroke_count": F.lit(1), "mouse_click_count": F.lit(1)})))
    monkeypatch.setattr(T0, "stage", lambda df, name: kept.setdefault(name, df))
    assert "live_factors" not in T0.stored_telemetry(spark, "").columns and "deviation_text" not in kept["telemetry"].columns
    assert kept["telemetry"].count() == 400


def test_refreshes_of_written_sums(spark):
    """Sums that are written already give the refreshes of the rows, also where seconds repeat."""
    rows = L.with_productivity(_telemetry_rows(spark)).withColumn(
        "timestamp", F.when(F.col("id") % 10 == 1, F.col("timestamp") - F.expr("INTERVAL 4001 SECONDS")).otherwise(F.col("timestamp")))
    want = {r.id: r for r in L.refreshed_baselines(rows, days=2).collect()}
    got = {r.id: r for r in L.refreshed_baselines(rows, days=2, sums=L.sums_per_second(rows)).collect()}
    assert got == want and len(want) == 40
    data = rows.select("id", "user_id", F.unix_seconds("timestamp").alias("s"), "mouse_velocity_avg").collect()
    for r in (x for x in data if x.id % 10 == 0):
        near = [x.mouse_velocity_avg for x in data if x.user_id == r.user_id and 0 <= r.s - x.s <= 2 * 86400]
        assert want[r.id].n == len(near) and want[r.id].mv_avg == pytest.approx(sum(near) / len(near))


def test_micro_batches_join_a_written_roster(spark, tmp_path):
    """The roster of a stream reads no events: each batch would work it out again."""
    spark.range(6).select((F.col("id") % 3).alias("user_id")).write.parquet(str(tmp_path / "events.parquet"))
    spark.range(3).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit(0).alias("c_nationkey"),
                          F.lit("MACHINERY").alias("c_mktsegment")).write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(0, "x")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    roster = stream_queries._roster(spark, str(tmp_path))
    assert "Join" not in roster._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, roster.collect())) == [(f"U{i}", "Admin") for i in range(3)]

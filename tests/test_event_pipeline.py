"""The full feature contract per event and its quality warnings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conductrisk import config as C
from conductrisk.operators import featurestore as S

BIO = ("id long, user string, timestamp timestamp, mouse_x double, mouse_y double, mouse_velocity double, key_press_time double, "
       "key_release_time double, app_category string, activity_type string, domain string, is_productive_app int, is_idle int")


def biometric(spark, at):
    rows = []
    for u, user in enumerate(["a", "b"]):
        for i in range(6):
            t = at(9 + i + 24 * (i // 4))
            rows.append((u * 10 + i, user, t, 3.0 * i, 4.0 * i, 2.0 + u, 1000.0 * i, 1000.0 * i + 50, ["x", "y"][i % 2],
                         "click" if u == 0 else ["click", "view", "buy"][i % 3], None, int(i < 2), int(i == 2)))
    rows.append((99, "c", at(9), 0.0, 0.0, 1.0, 0.0, 10.0, "x", "click", None, 1, 0))
    return spark.createDataFrame(rows, BIO)


def test_session_features_per_day(spark, at):
    got = {(r.user, r.day): r for r in S.session_features(biometric(spark, at)).collect()}
    first = got["a", dt.date(2024, 1, 1)]
    assert first.session_duration == 3 * 3600 and first.idle_time == 3600
    assert first.productive_app_ratio == 0.5 and first.mouse_velocity == 2.0
    assert first.mouse_tortuosity == pytest.approx(1.0, abs=1e-5) and first.keystroke_flight_time == 950.0
    alone = got["c", dt.date(2024, 1, 1)]
    assert (alone.session_duration, alone.idle_time, alone.keystroke_flight_time, alone.keystroke_anomaly_score) == (0.0, 0.0, None, 0.0)


def test_every_feature_of_the_contract(spark, at):
    events = spark.createDataFrame(
        [("1", "a", at(9), "Logon", "Logon"), ("2", "a", at(10), "Device", "Connect"), ("3", "a", at(23), "File", "File Copy"),
         ("4", "nobody", at(9), "Http", "Visit")], "id string, user string, date timestamp, source string, activity string")
    roster = spark.createDataFrame([("a", "Admin")], "user string, role string")
    rows = S.event_pipeline(events, biometric(spark, at), roster)
    assert [n for n, _, _ in C.EVENT_FEATURES] == rows.columns[3:-4] and len(C.EVENT_FEATURES) == 21
    got = {r.id: r for r in rows.collect()}
    assert len(got) == 4 and got["2"].usb_events_7d == 1 and got["3"].usb_events_7d == 1 and got["3"].file_copy_count_24h == 1
    assert got["3"].after_hours_ratio == pytest.approx(1 / 3) and got["3"].is_after_hours == 1
    assert got["1"].session_duration == 3 * 3600 and got["1"].entropy_risk_level in S.LEVELS
    # events without biometric rows are missing, not zero
    assert got["4"].session_duration is None and got["4"].entropy_risk_level is None and got["4"].http_count_1h == 1


def contract_rows(spark, n, shift=0.0, gaps=False):
    cols = [F.lit(None).cast("double").alias(m) if gaps and m == "idle_time" else F.lit("Low").alias(m) if m == "entropy_risk_level"
            else (F.col("id") % 7 + shift).cast("double").alias(m) for m, _, _ in C.EVENT_FEATURES]
    return spark.range(n).select(*cols)


def test_warnings_name_missing_and_shifted_features(spark):
    old = contract_rows(spark, 70)
    clean = S.pipeline_warnings(old, old).collect()
    assert len(clean) == 21 and all(r.valid for r in clean) and len({r.feature_id for r in clean}) == 21
    new = {r.feature: list(r.issues) for r in S.pipeline_warnings(contract_rows(spark, 70, 50.0, gaps=True), old).collect()}
    assert new["entropy_risk_level"] == [] and len(new["hour"]) == 1 and "shifted" in new["hour"][0]
    assert "100.00%" in new["idle_time"][0] and len(new["idle_time"]) == 1


def test_moments_equal_the_statistics(spark):
    df = contract_rows(spark, 50).select("hour", "idle_time").withColumn("idle_time", F.when(F.col("hour") > 2, F.col("idle_time")))
    mine = {r.feature: r for r in S.moments(df, df.columns).collect()}
    for r in S.statistics(df, df.columns).collect():
        m = mine[r.feature]
        assert (m["count"], m.missing, m.unique) == (r["count"], r.missing, r.unique)
        assert (m["mean"], m["std"]) == pytest.approx((r["mean"], r["std"]))

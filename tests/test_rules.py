import pytest
from pyspark.sql import functions as F

from conductrisk.functions import integrity as I
from conductrisk.functions import riskrules as R
from conductrisk.functions.common import band, clean_app, iso_weekday, parse_time, to_bool, to_number
from conductrisk.operators.scoring import score_daily

COLUMNS = ("user string, role string, file_copy_count double, usb_count double, removable_media_count double, "
           "delete_count double, after_hours_ratio double, after_hours_count double, event_count double, anomaly_score double, "
           "error_mean double, error_std double, threshold double")


def score(spark, role="Employee", copies=0, usb=0, removable=0, deletes=0, ratio=0.0, count=0, anomaly=0.05,
          mean=None, std=None, threshold=None, model="sequence"):
    row = ("U1", role, float(copies), float(usb), float(removable), float(deletes), ratio, float(count), 10.0, anomaly, mean, std, threshold)
    return score_daily(spark.createDataFrame([row], COLUMNS), model=model).first()


def test_low_anomaly_is_normal(spark):
    r = score(spark)
    assert r.risk_score == 0 and r.primary_factor == "Normal activity"
    assert r.explanation == "Low risk - normal activity pattern."


def test_score_is_capped(spark):
    assert score(spark, "Admin", copies=3, ratio=0.8, count=8, anomaly=1.0).risk_score == 100


def test_role_and_activity_raise_the_risk(spark):
    base = score(spark, anomaly=0.2).risk_score
    assert score(spark, "Admin", anomaly=0.2).risk_score == pytest.approx(base * 1.5)
    assert score(spark, "Contractor", anomaly=0.2).risk_score == pytest.approx(base * 1.2)
    assert score(spark, copies=1, anomaly=0.2).risk_score == pytest.approx(base * 4)
    assert score(spark, deletes=1, anomaly=0.2).risk_score == pytest.approx(base * 2)
    assert score(spark, usb=1, anomaly=0.2).risk_score == pytest.approx(base * 3 * 1.5)


def test_after_hours_needs_volume(spark):
    assert not any("After-hours" in f for f in score(spark, ratio=1.0, count=1, anomaly=0.3).factors)
    assert any("After-hours" in f for f in score(spark, ratio=0.8, count=8, anomaly=0.3).factors)


def test_exfiltration_pattern(spark):
    hit = score(spark, copies=12, usb=3, ratio=0.8, count=9, anomaly=0.1)
    assert hit.risk_score >= 85 and any("PATTERN" in f for f in hit.factors)
    miss = score(spark, copies=12, usb=3, anomaly=0.4)
    assert not any("PATTERN" in f for f in miss.factors)


def test_baseline_model_scores_only_negative_values(spark):
    assert score(spark, anomaly=-0.5, model="baseline").risk_score > 0
    assert score(spark, anomaly=0.5, model="baseline").risk_score == 0


def test_role_normalised_base(spark):
    assert score(spark, anomaly=2.0, mean=1.0, std=0.2, threshold=2.0).base_risk == pytest.approx(45)
    assert score(spark, anomaly=0.5, mean=1.0, std=0.2, threshold=2.0).base_risk == 0
    assert score(spark, anomaly=1.4, mean=1.0, std=0.2, threshold=1.0).base_risk == pytest.approx(50)


@pytest.mark.parametrize("kwargs,tactic,technique", [
    (dict(copies=1, usb=1), "TA0010", "T1052"), (dict(usb=1, deletes=1), "TA0010", "T1200"),
    (dict(deletes=1), "TA0040", "T1485"), (dict(ratio=0.9, count=9), "TA0006", "T1078"), (dict(), "", ""),
])
def test_tactics(spark, kwargs, tactic, technique):
    r = score(spark, **kwargs)
    assert (r.mitre_tactic, r.mitre_technique) == (tactic, technique)


def test_explanation_names_three_factors_and_the_tactic(spark):
    r = score(spark, "Admin", copies=12, usb=3, ratio=0.8, count=9, anomaly=0.4)
    assert r.explanation.startswith("Risk score 100/100. Contributing factors: ")
    assert r.explanation.endswith("Maps to MITRE TA0010 - Exfiltration.")
    assert r.explanation.count(";") == 2


def test_work_integrity_factor(spark):
    df = spark.createDataFrame([(0.4, 6.0, 1.0, "Critical", 4.0, 0.6)], ", ".join(
        f"{n} {'string' if n == 'entropy_risk_level' else 'double'}" for n in R.INTEGRITY_DEFAULTS))
    assert df.select(R.integrity_multiplier()).first()[0] == pytest.approx(1.3 * 2.0 * 2.5 * 1.3 * 1.3)


def test_small_functions(spark):
    df = spark.createDataFrame([(" TRUE ", "12.34567", "bad", "Excel.exe", 80.0)], "b string, n string, x string, app string, s double")
    r = df.select(
        to_bool("b"), to_bool("x"), to_number("n"), to_number("x"), clean_app("app"), band("s"),
        band("s", (80, 50, 25), strict=True), parse_time("x"), iso_weekday(F.lit("2024-01-01").cast("date")),
    ).first()
    assert tuple(r) == (True, False, 12.3457, 0.0, "Excel", "Critical", "High", None, 0)


def test_time_multiplier_order(spark):
    hours = [(f"2024-01-0{d} {h:02d}:00:00",) for d, h in ((1, 23), (1, 7), (1, 18), (6, 12), (1, 12), (6, 7))]
    rows = spark.createDataFrame(hours, "t string").select(I.time_multiplier(F.to_timestamp("t"))).collect()
    assert [r[0] for r in rows] == [2.5, 1.5, 1.8, 2.0, 1.0, 1.5]


def test_app_tactic_takes_the_first_list(spark):
    df = spark.createDataFrame([("Telegram Desktop",), ("7zip",), ("word",)], "a string")
    assert [r[0] and r[0].tactic for r in df.select(I.app_tactic(F.col("a"))).collect()] == ["TA0010", "TA0009", None]

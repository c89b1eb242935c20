"""Risk of single events as a Beta distribution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conductrisk.functions import posterior as P
from conductrisk.functions.common import with_defaults

DEFAULTS = {
    "usb_events_7d": 0, "file_op_velocity": 1.0, "baseline_file_velocity": 1.0, "after_hours_ratio": 0.0,
    "productive_app_ratio": 1.0, "entropy_risk_level": "Low", "mouse_tortuosity_index": 1.0,
    "keystroke_anomaly_score": 0.0,
}


def risk_distribution(rows: DataFrame, hour: str = "hour", model: str = "sequence") -> DataFrame:
    """Evidence parts, alpha, beta, and the closed-form mean and deviation on 0-100.

    Rows carry role, activity, hour, day_of_week and anomaly_score; other inputs have defaults.
    """
    rows = with_defaults(rows, DEFAULTS)
    rows = rows.withColumns({
        "e_anomaly": P.anomaly_likelihood(F.col("anomaly_score"), model),
        "e_time": P.time_factor(F.col(hour), F.col("day_of_week")),
        "e_activity": P.activity_factor(F.col("activity")),
        "e_behaviour": P.behaviour_evidence(F.col("usb_events_7d"), F.col("file_op_velocity"),
                                            F.col("baseline_file_velocity"), F.col("after_hours_ratio")),
        "e_integrity": P.integrity_evidence(F.col("productive_app_ratio"), F.col("entropy_risk_level"),
                                            F.col("mouse_tortuosity_index"), F.col("keystroke_anomaly_score")),
    })
    parts = {n: F.col(f"e_{n}") for n in P.C.EVIDENCE_WEIGHTS}
    rows = rows.withColumn("evidence", P.combined_evidence(parts))
    alpha, beta = P.beta_parameters(F.col("role"), F.col("evidence"))
    rows = rows.withColumns({"alpha": alpha, "beta": beta})
    return rows.withColumns({
        "risk_mean": P.beta_mean(F.col("alpha"), F.col("beta")),
        "risk_std": P.beta_std(F.col("alpha"), F.col("beta")),
    })


def compare_scenarios(rows: DataFrame, other_hour: str) -> DataFrame:
    """What if the same event had happened at another hour: both posteriors in one row."""
    first = risk_distribution(rows).withColumnRenamed("risk_mean", "baseline_mean")
    both = risk_distribution(first.drop("alpha", "beta", "evidence", "risk_std"), other_hour)
    diff = F.col("risk_mean") - F.col("baseline_mean")
    return both.withColumns({
        "alternative_mean": F.col("risk_mean"), "risk_difference": diff,
        "risk_ratio": F.col("risk_mean") / F.greatest(F.lit(0.01), F.col("baseline_mean")),
        "significant": F.abs(diff) > 10,
    })


GRID = np.linspace(0, 1, 4001)


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("p90", "p95", "p99")]))
def posterior_percentiles(alpha: pd.Series, beta: pd.Series) -> pd.DataFrame:
    """Percentiles of Beta(alpha, beta) times 100: its density is summed on a grid and inverted.

    A batch is handled in blocks of rows, each one matrix operation. Both parameters are at least 1.
    """
    middle = (GRID[1:] + GRID[:-1]) / 2
    low, high = np.log(middle), np.log1p(-middle)
    out = np.empty((len(alpha), 3))
    for at in range(0, len(alpha), 256):
        a, b = (x.to_numpy(dtype=float)[at:at + 256, None] for x in (alpha, beta))
        density = (a - 1) * low + (b - 1) * high
        total = np.cumsum(np.exp(density - density.max(axis=1, keepdims=True)), axis=1)
        total /= total[:, -1:]
        for j, p in enumerate((0.90, 0.95, 0.99)):
            step = (total < p).sum(axis=1)
            rows = np.arange(len(step))
            before = np.where(step > 0, total[rows, step - 1], 0.0)
            share = (p - before) / (total[rows, step] - before)
            out[at:at + 256, j] = (GRID[step] + share * (GRID[step + 1] - GRID[step])) * 100
    return pd.DataFrame(out, columns=["p90", "p95", "p99"])

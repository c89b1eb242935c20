"""All registered queries. Importing the query modules fills the registry."""

from __future__ import annotations

from conductrisk.plans import (  # noqa: F401
    analysis_queries, batch_queries, feature_queries, live_queries, model_queries, stream_queries,
)
from conductrisk.plans.registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark, sf_dir):
    return QUERIES["top_risk_users"](spark, sf_dir)

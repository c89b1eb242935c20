"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from conductrisk.llm import (
    byte_bpe_queries, fingerprint_queries, infill_queries, lm_queries, map_queries, neighbour_queries,
    packing_queries, repeat_queries, spelling_queries,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for module in (map_queries, byte_bpe_queries, repeat_queries, lm_queries, fingerprint_queries, packing_queries,
               infill_queries, spelling_queries, neighbour_queries):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES

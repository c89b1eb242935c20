"""Query of the packing operator."""

from __future__ import annotations

from conductrisk.llm import packing
from conductrisk.llm.rows import load

ORACLES: dict[str, str] = {}


def op6_best_fit_packing(spark, sf_dir):
    return packing.packed(load(spark, sf_dir))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}

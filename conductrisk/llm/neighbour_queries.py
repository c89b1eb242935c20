"""Query of the nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from conductrisk.llm import neighbours
from conductrisk.llm.rows import load

ORACLES: dict[str, str] = {}


def op11_nearest_vectors(spark, sf_dir):
    found = neighbours.nearest(load(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


QUERIES = {"op11_nearest_vectors": op11_nearest_vectors}

"""Query of the document fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from conductrisk.llm import syncmers
from conductrisk.llm.rows import load

ORACLES: dict[str, str] = {}


def op5_syncmer_fingerprints(spark, sf_dir):
    found = syncmers.fingerprints(load(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
                        syncmers.as_text("anchors").alias("fingerprint"),
                        syncmers.as_text("edited_anchors").alias("edited_fingerprint"), "near_edited", "near_next")


QUERIES = {"op5_syncmer_fingerprints": op5_syncmer_fingerprints}

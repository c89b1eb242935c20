"""Query of the language-model scores."""

from __future__ import annotations

from conductrisk.llm import lm
from conductrisk.llm.rows import fold, load

ORACLES: dict[str, str] = {}


def op9_lm_scoring(spark, sf_dir):
    docs = load(spark, sf_dir).select("doc_id", "text")
    return lm.score(docs, lambda column: fold(5, column) != 1).select(
        "row.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op9_lm_scoring": op9_lm_scoring}

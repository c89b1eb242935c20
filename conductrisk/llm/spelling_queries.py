"""Query of the spelling variants."""

from __future__ import annotations

from conductrisk.llm import spelling
from conductrisk.llm.rows import load

ORACLES: dict[str, str] = {}


def op13_spelling_variants(spark, sf_dir):
    found = spelling.grouped(load(spark, sf_dir).select("doc_id", "text"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op13_spelling_variants": op13_spelling_variants}

"""Queries whose operators judge each document by itself, with a model learned before."""

from __future__ import annotations

from pyspark.sql import functions as F

from conductrisk.llm import language, quality, toxicity
from conductrisk.llm.rows import fold, load

ORACLES: dict[str, str] = {}


def op1_quality_rules(spark, sf_dir):
    docs = load(spark, sf_dir).select("doc_id", "text", "lang")
    judged = quality.judge(docs, quality.fit(docs, load(spark, sf_dir, "labels")))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", F.array_join("above", ",").alias("rejected_by"))


def op4_language_id(spark, sf_dir):
    docs = load(spark, sf_dir)
    model = language.fit(docs.select("doc_id", "text", "lang"), fold(4) != 2)
    return language.identify(docs.select("doc_id", "text"), model).select(
        "row.doc_id", (fold(4, "row.doc_id") == 2).alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark, sf_dir):
    docs = load(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"), fold(5) != 0)
    return toxicity.score(docs, model).select(
        "row.doc_id", (fold(5, "row.doc_id") == 0).alias("held_out"), "score", "predicted")


QUERIES = {"op1_quality_rules": op1_quality_rules, "op4_language_id": op4_language_id,
           "op10_toxicity": op10_toxicity}

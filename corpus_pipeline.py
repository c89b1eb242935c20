"""The corpus pipeline: five stages from raw documents to packed training bins.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. Each but the last
returns the columns of docs. Null and empty texts leave at the first stage, as no language can be
told. Repeated rows are near duplicates, too: one of them goes on. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conductrisk.llm import language, minhash, packing, phrases, quality
from conductrisk.llm.rows import load
from conductrisk.session import stage

#: Least posterior probability of a document's language.
LANGUAGE_SCORE = 0.5
#: SQL can't express the learned stages; tests compare run() with a brute-force version.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. The model learns from all rows with a language."""
    found = language.identify(docs, language.fit(docs.select("text", "lang"), F.lit(True)))
    return found.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LANGUAGE_SCORE)).select("row.*")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; the cutoffs come from the labelled ones among them."""
    return quality.judge(docs, quality.fit(docs, load(spark, sf_dir, "labels"))).filter("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, of the smallest id."""
    return minhash.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that other documents have before; n_chars follows the text."""
    found = phrases.dedup(docs).withColumn("text", F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*(new[c].alias(c) if c in new else F.col(f"row.{c}") for c in docs.columns))


def pack_into_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their bins."""
    return packing.packed(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("minhash_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("best_fit_packing", pack_into_bins),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir)
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Quality rules with risk-controlled thresholds.

Each rule is a number per document that is higher for worse text. A cutoff per stratum and rule is
chosen on labelled rows: candidates go from lenient to strict, and each one must pass an exact
binomial test of "good documents are rejected more often than `risk`" before the next one is tried
(fixed-sequence testing). This is done twice, each time with half of `error` divided by the strata: once with the
rules together, where each step makes one rule stricter and "any rule rejects" is tested at the whole `risk`, and once rule
by rule, at equal parts of `risk` and of the level. The stricter of both results counts, so with probability
1 - `error` no stratum loses more than `risk` of its good documents. The first way needs few labels (252 good rows
for four strata), the second lets rules go on when one of them has to stop.

Null and empty texts have no words and fail the base rule. A null `lang` is a stratum of its own.
Rows that are repeated are judged alike; of several labels of one id the lowest counts. Without
labels no cutoff is certified and only the base rule rejects.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conductrisk.llm import kernels as K
from conductrisk.llm.rows import map_texts, text_of
from conductrisk.session import stage

#: Share of good documents that all rules together may reject in a stratum, and the chance of being wrong.
RISK, ERROR = 0.02, 0.05
#: Words in a window of the repeat count.
REPEAT_WINDOW = 5
#: Bytes of text that are counted at once.
AT_ONCE = 1_000_000
#: Candidate cutoffs of each rule, from lenient to strict. A document is rejected above the cutoff.
GRID = {
    "symbol_share": [round(1.0 - 0.04 * i, 2) for i in range(25)] + [0.03, 0.02, 0.015, 0.01],
    "duplicate_line_share": [round(0.98 - 0.04 * i, 2) for i in range(24)],
    "repeat_share": [round(0.98 - 0.04 * i, 2) for i in range(24)],
    "mean_word_length": [float(40 - i) for i in range(30)],
}
#: Steps (rule, index of its cutoff) of the sequences that are tested: all rules together, and each by itself.
SEQUENCES = {"": [(rule, i) for _, rule, i in sorted(((i + 1) / len(cuts), rule, i) for rule, cuts in GRID.items()
                                                     for i in range(len(cuts)))],
             **{rule: [(rule, i) for i in range(len(cuts))] for rule, cuts in GRID.items()}}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _line_copies(text: bytes) -> tuple[int, int]:
    """(lines with a word, those of them that equal an earlier line)."""
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines), len(lines) - len(set(lines))


def _counts(batch: pa.RecordBatch) -> list[np.ndarray]:
    data, offsets = K.buffer_of(text_of(batch))
    words = K.words_of(data, offsets)
    n_words = words.counts()
    # code points: bytes that do not continue one
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_chars = K.sums(points[words.end] - points[words.start], words.of_text)
    n_symbols = K.sums(_SYMBOLS[data].astype(np.int64), offsets)
    raw = data.tobytes()
    lines = np.array([_line_copies(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)],
                     np.int64).reshape(-1, 2)
    repeated = np.zeros(len(words.start), bool)
    hashes = K.run_hashes(words.hashes(), REPEAT_WINDOW)
    if len(hashes):
        owner = words.text_of_word()
        whole = np.flatnonzero(owner[:len(hashes)] == owner[REPEAT_WINDOW - 1:])
        # within a text: sort windows by (text, hash) and mark all members of groups of two or more
        key = hashes[whole] ^ K.mix(owner[whole].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(whole), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        for i in range(REPEAT_WINDOW):
            repeated[whole[again] + i] = True
    return [n_words, word_chars, n_symbols, lines[:, 0], lines[:, 1], K.sums(repeated.astype(np.int64), words.of_text)]


def measured(docs: DataFrame) -> DataFrame:
    """`row` and the counts of every text."""
    return map_texts(docs, _counts, [(n, T.LongType()) for n in COUNTS], AT_ONCE)


def rules() -> dict[str, Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "duplicate_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "mean_word_length": share("word_chars", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable, summed exactly from the largest term downwards."""
    if k >= n:
        return 1.0
    log_term = lambda i: (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                          + i * math.log(p) + (n - i) * math.log1p(-p))
    return min(1.0, math.fsum(math.exp(log_term(i)) for i in range(k + 1)))


def certified(good: int, rejected: list[int], risk: float, level: float) -> int:
    """Number of candidates, from the lenient end, that pass; `rejected` counts good documents above each."""
    for i, k in enumerate(rejected):
        # beyond the mean the tail cannot be below one half: no need to sum it
        if k >= risk * good or binomial_tail(k, good, risk) > level:
            return i
    return len(rejected)


@dataclass
class Cutoffs:
    """A table of the strata with labels: `stratum` and a column per rule, null where no cutoff is certified."""

    table: DataFrame

    def __getitem__(self, stratum: str | None) -> dict[str, float]:
        found = self.table.filter(F.col("stratum").eqNullSafe(F.lit(stratum))).first()
        if found is None:
            raise KeyError(stratum)
        return {rule: found[rule] for rule in GRID if found[rule] is not None}


def _cutoffs(found: list[dict], risk: float, level: float) -> dict[str, float | None]:
    """Cutoffs of a stratum; `found` has the number `c` of good documents by `sequence` and `first` step that rejects them."""
    good = sum(x["c"] for x in found if x["sequence"] == "")

    def passed(sequence: str, risk: float, level: float) -> list[tuple[str, int]]:
        at = np.zeros(len(SEQUENCES[sequence]) + 1, np.int64)
        for x in found:
            if x["sequence"] == sequence:
                at[x["first"]] += x["c"]
        return SEQUENCES[sequence][:certified(good, np.cumsum(at)[:-1].tolist(), risk, level)]

    together = dict(passed("", risk, level / 2))
    alone = dict(x for rule in GRID for x in passed(rule, risk / len(GRID), level / 2 / len(GRID)))
    best = max(together, alone, key=lambda steps: sum((i + 1) / len(GRID[rule]) for rule, i in steps.items()))
    return {rule: GRID[rule][best[rule]] if rule in best else None for rule in GRID}


def fit(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> Cutoffs:
    """Cutoffs by stratum and rule. `labels` has doc_id and quality (1: good)."""
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    # rows that fail the base rule are not the rules' to reject
    rows = measured(docs.select("doc_id", "text", stratum)).filter(~base_failed()).select(
        F.col("row.doc_id").alias("doc_id"), F.col(f"row.{stratum}").alias("stratum"),
        *(c.alias(n) for n, c in rules().items()))
    first = [F.struct(F.lit(name).alias("sequence"), F.coalesce(
        *(F.when(F.col(rule) > GRID[rule][i], at) for at, (rule, i) in enumerate(steps)), F.lit(len(steps))).alias("first"))
        for name, steps in SEQUENCES.items()]
    counts = (rows.join(good, "doc_id", "left_semi").select("stratum", F.explode(F.array(*first)).alias("x"))
              .groupBy("stratum", "x").agg(F.count(F.lit(1)).alias("c"))
              .groupBy("stratum").agg(F.collect_list(F.struct("x.sequence", "x.first", "c")).alias("found")))
    counts = stage(counts, "quality-counts")
    level = error / max(1, counts.count())
    schema = T.StructType([counts.schema["stratum"], *(T.StructField(rule, T.DoubleType()) for rule in GRID)])

    def work(batches):
        for batch in batches:
            cuts = [_cutoffs(x, risk, level) for x in batch.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("stratum"), *(pa.array([x[rule] for x in cuts], pa.float64()) for rule in GRID)], schema.names)

    return Cutoffs(stage(counts.mapInArrow(work, schema), "quality-cutoffs"))


def judge(docs: DataFrame, cutoffs: Cutoffs, stratum: str = "lang") -> DataFrame:
    """`row`, the counts, base_failed, `above` (the rules that reject the document) and kept."""
    table = cutoffs.table.select(F.col("stratum").alias("_stratum"), *(F.col(rule).alias(f"_{rule}") for rule in GRID))
    hits = [F.when(value > F.col(f"_{name}"), F.lit(name)) for name, value in rules().items()]
    found = measured(docs).join(table, F.col(f"row.{stratum}").eqNullSafe(F.col("_stratum")), "left")
    return (found.withColumns({"base_failed": base_failed(), "above": F.array_compact(F.array(*hits))})
            .withColumn("kept", ~F.col("base_failed") & (F.size("above") == 0)).drop(*table.columns))

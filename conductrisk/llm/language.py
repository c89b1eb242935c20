"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in every partition with numpy, sums the partial counts in
Spark and yields a matrix of log probabilities (buckets x languages) that is broadcast; its size is
bounded by `BUCKETS` and `MAX_LANGUAGES`. Scoring sums the matrix rows of a text's n-grams.

A text that is null or has no letter is `und` with score 0. A text is padded with a blank on both
sides, so one letter already makes an n-gram. Equal scores go to the language that comes first by
name. Without any training row every text is `und`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conductrisk.llm import kernels as K
from conductrisk.llm.rows import broadcast, map_texts, text_of

#: Hash buckets of n-grams, length of the n-grams, smoothing count, most languages that are learned.
BUCKETS, GRAM, SMOOTHING, MAX_LANGUAGES = 1 << 15, 3, 0.5, 400
UNDETERMINED = "und"
#: Bytes of text that are handled at once.
AT_ONCE = 1_000_000
_CHUNK = 4096  # buckets per row of partial counts
_MULTIPLIERS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


@dataclass
class LanguageModel:
    """Languages in order of name and, per n-gram bucket, the log probability in each of them."""

    languages: list[str]
    log_probability: np.ndarray
    prior: np.ndarray


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, first n-gram of each text with one entry more at the end)."""
    whole = [x or "" for x in texts.to_pylist()]
    code = np.frombuffer((" " + "  ".join(whole) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = code + ((code >= 65) & (code <= 90)).astype(np.uint32) * np.uint32(32)
    mixed = np.zeros(max(0, len(code) - GRAM + 1), np.uint32)
    for i in range(GRAM):
        mixed = (mixed ^ code[i:i + len(mixed)]) * _MULTIPLIERS[i]
        mixed ^= mixed >> np.uint32(15)
    bounds = np.concatenate([[0], np.cumsum([len(x) + 2 for x in whole])])
    # the last n-grams of a text would reach into the next one
    inside = np.ones(len(mixed), bool)
    for i in range(1, GRAM):
        inside[bounds[1:-1] - i] = False
    kept = np.concatenate([[0], np.cumsum(inside)])
    return (mixed & np.uint32(BUCKETS - 1))[inside], kept[np.minimum(bounds, len(mixed))]


def fit(docs: DataFrame, learn: Column) -> LanguageModel:
    """Learn from the rows of docs (text, lang) where `learn` holds and lang is not null."""
    rows = docs.filter(learn & F.col("lang").isNotNull()).select(F.struct("text", "lang").alias("row"))
    schema = "lang string, chunk int, documents long, counts binary"

    def partial(batches):
        counts: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for first, n in K.pieces(text_of(batch), AT_ONCE):
                part = batch.slice(first, n)
                names = pc.struct_field(part.column("row"), "lang").to_pylist()
                buckets, bounds = _grams(text_of(part))
                for i, name in enumerate(names):
                    have = counts.setdefault(name, np.zeros(BUCKETS, np.int64))
                    mine = buckets[bounds[i]:bounds[i + 1]]
                    if len(mine) > BUCKETS // 8:
                        have += np.bincount(mine, minlength=BUCKETS)
                    else:
                        np.add.at(have, mine, 1)
                    seen[name] = seen.get(name, 0) + 1
        for name, have in counts.items():
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([name] * (BUCKETS // _CHUNK)),
                "chunk": pa.array(range(BUCKETS // _CHUNK), pa.int32()),
                "documents": pa.array([seen[name]] * (BUCKETS // _CHUNK), pa.int64()),
                "counts": pa.array([x.tobytes() for x in have.reshape(-1, _CHUNK)], pa.binary()),
            })

    def total(table: pa.Table) -> pa.Table:
        summed = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({
            "lang": table.column("lang").slice(0, 1), "chunk": table.column("chunk").slice(0, 1),
            "documents": pa.array([pc.sum(table.column("documents")).as_py()], pa.int64()),
            "counts": pa.array([summed.tobytes()], pa.binary()),
        })

    summed = rows.mapInArrow(partial, schema).groupBy("lang", "chunk").applyInArrow(total, schema)
    found = summed.orderBy(F.desc("documents"), "lang", "chunk").limit(MAX_LANGUAGES * (BUCKETS // _CHUNK)).collect()
    languages = sorted({x["lang"] for x in found})
    count = np.zeros((BUCKETS, len(languages)))
    prior = np.zeros(len(languages))
    for x in found:
        at = languages.index(x["lang"])
        count[x["chunk"] * _CHUNK:(x["chunk"] + 1) * _CHUNK, at] = np.frombuffer(x["counts"], np.int64)
        prior[at] = x["documents"]
    smooth = count + SMOOTHING
    return LanguageModel(languages, np.log(smooth / smooth.sum(axis=0)).astype(np.float32),
                         np.log(prior / max(1.0, prior.sum())))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """`row`, lang_pred, and score: the posterior probability of lang_pred."""
    shared = broadcast(docs.sparkSession, model)

    def work(batch):
        learned, texts = shared.value, text_of(batch)
        names = np.array([*learned.languages, UNDETERMINED], object)
        buckets, bounds = _grams(texts)
        totals = np.empty((len(texts), max(1, len(learned.languages))))
        for i in range(len(learned.languages)):
            column = np.ascontiguousarray(learned.log_probability[:, i])
            totals[:, i] = K.sums(column[buckets].astype(np.float64), bounds) + learned.prior[i]
        best = totals.argmax(axis=1)
        top = totals[np.arange(len(texts)), best]
        score = 1.0 / np.exp(totals - top[:, None]).sum(axis=1)
        letters = np.array([any(map(str.isalpha, x or "")) for x in texts.to_pylist()], bool)
        known = letters & bool(learned.languages)
        best = np.where(known, best, len(learned.languages))
        return [pa.array(names[best].tolist(), pa.string()), np.where(known, score, 0.0)]

    return map_texts(docs, work, [("lang_pred", T.StringType()), ("score", T.DoubleType())], AT_ONCE)

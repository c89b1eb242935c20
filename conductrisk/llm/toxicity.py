"""Toxicity: logistic regression trained by FTRL-proximal over hashed word n-grams and skip-grams.

Features are the distinct buckets of words, word pairs and pairs with one word between them (A-Z
lowered, split at everything that is no letter). Training runs in one task over a sample of
labelled rows whose size is bounded by `TRAIN_ROWS`; every coordinate has its own learning rate and
the L1 term leaves few weights, which are broadcast (at most `BUCKETS` of them).

Null and empty texts have no feature and get the intercept's score. Without labels every score
is 0.5, and so predicted is 1. Of several labels of one id the highest counts; repeated rows are
scored alike.
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
from conductrisk.llm.rows import broadcast, map_texts, pack, text_of

#: Hash buckets, most labelled rows that are learned from, passes over them.
BUCKETS, TRAIN_ROWS, EPOCHS = 1 << 20, 20_000, 4
#: FTRL-proximal: learning rate, its offset, L1 and L2 strength.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 8.0, 0.1


@dataclass
class ToxicityModel:
    """Bias, and the buckets with a weight other than zero in ascending order."""

    bias: float
    bucket: np.ndarray
    weight: np.ndarray


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, owner) of each text, ordered by owner."""
    data, offsets = K.buffer_of(texts)
    words = K.words_of(K.lower(data), offsets, K.NOT_LETTERS)
    value, owner = words.hashes(), words.text_of_word()
    kinds = [(value, owner)]
    for gap in (1, 2):
        same = owner[gap:] == owner[:-gap]
        kinds.append((K.mix(value[:-gap][same] * np.uint64(2 * gap + 1) + value[gap:][same]), owner[gap:][same]))
    bucket = np.concatenate([v for v, _ in kinds]) & np.uint64(BUCKETS - 1)
    both = np.unique(np.concatenate([o for _, o in kinds]) * BUCKETS + bucket.astype(np.int64))
    return both % BUCKETS, both // BUCKETS


def sample(labels: DataFrame, learn: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most `rows` labelled ids (doc_id, toxic), the ones with the smallest hash of the id."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        (F.max("toxic") > 0).cast("int").alias("toxic"))
    return known.filter(learn).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def train(docs: list[np.ndarray], label: list[int]) -> ToxicityModel:
    """FTRL-proximal over the rows in the given order. Bucket `BUCKETS` is the intercept."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(at):
        zi, ni = z[at], n[at]
        strength = np.where(at == BUCKETS, 0.0, L1)
        return np.where(np.abs(zi) <= strength, 0.0,
                        (np.sign(zi) * strength - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for have, y in zip(docs, label, strict=True):
            at = np.append(have, BUCKETS)
            w = weights(at)
            gradient = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            rate = (np.sqrt(n[at] + gradient * gradient) - np.sqrt(n[at])) / ALPHA
            z[at] += gradient - rate * w
            n[at] += gradient * gradient
    every = np.arange(BUCKETS + 1)
    w = weights(every)
    kept = np.flatnonzero(w[:-1])
    return ToxicityModel(float(w[-1]), kept, w[kept])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learn from documents whose label row satisfies `learn`."""
    chosen = sample(labels, learn, rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `rows` small rows

    def features(batches):
        for batch in batches:
            for first, n in K.pieces(text_of(batch)):
                part = batch.slice(first, n)
                bucket, owner = _features(text_of(part))
                bounds = np.searchsorted(owner, np.arange(n + 1))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pc.struct_field(part.column("row"), "doc_id"),
                    "toxic": pc.struct_field(part.column("row"), "toxic"),
                    "buckets": pa.array([bucket[a:b].astype(np.int32).tobytes() for a, b in zip(bounds, bounds[1:])],
                                        pa.binary()),
                })

    def learn_all(batches):
        rows = sorted(((x["doc_id"], x["buckets"], x["toxic"]) for b in batches for x in b.to_pylist()),
                      key=lambda r: (hash_of(r[0]), r[1]))
        model = train([np.frombuffer(b, np.int32) for _, b, _ in rows], [y for _, _, y in rows])
        yield pa.RecordBatch.from_pydict({
            "bias": pa.array([model.bias]),
            "bucket": pa.array([model.bucket.astype(np.int64).tobytes()], pa.binary()),
            "weight": pa.array([model.weight.tobytes()], pa.binary()),
        })

    hash_of = lambda i: int(K.mix(np.array([i], np.int64).view(np.uint64))[0])
    sparse = pack(texts).mapInArrow(features, "doc_id long, toxic int, buckets binary")
    found = sparse.repartition(1).mapInArrow(learn_all, "bias double, bucket binary, weight binary").collect()
    if not found:
        return ToxicityModel(0.0, np.zeros(0, np.int64), np.zeros(0))
    return ToxicityModel(found[0]["bias"], np.frombuffer(found[0]["bucket"], np.int64),
                         np.frombuffer(found[0]["weight"], np.float64))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """`row`, score and predicted."""
    shared = broadcast(docs.sparkSession, model)

    def work(batch):
        learned = shared.value
        bucket, owner = _features(text_of(batch))
        total = np.full(batch.num_rows, learned.bias)
        if len(learned.bucket):
            at = np.minimum(np.searchsorted(learned.bucket, bucket), len(learned.bucket) - 1)
            hit = learned.bucket[at] == bucket
            total += np.bincount(owner[hit], learned.weight[at[hit]], minlength=batch.num_rows)
        value = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
        return [value, (value >= 0.5).astype(np.int32)]

    return map_texts(docs, work, [("score", T.DoubleType()), ("predicted", T.IntegerType())])

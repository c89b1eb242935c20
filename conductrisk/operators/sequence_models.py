"""The linear sequence models of all roles, fitted in one pass over the daily rows and applied in another.

A sequence is the last `length` daily rows of a user, so the second moments of all sequences consist of blocks: the block of
places (a, b) sums the outer products of a row and the row b - a days after it, over all rows that can stand at place a. A
row that is not near the ends of its user's series stands at every place, so one product per distance serves all blocks of
that distance. Neither fitting nor scoring builds the sequences.

Both passes read daily rows that are dealt by user and ordered by day (a user has one row per day), and carry the last
rows of a batch into the next. Partial sums per partition have a fixed size and are added up in Spark; what reaches the
driver is one matrix per modelled role and a global one, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conductrisk import config as C
from conductrisk.session import stage

#: Components explain at least this share of the variance; smaller ones are rounding.
LEAST_SHARE = 1e-9
MODEL_SCHEMA = ("model string, n_sequences long, mean array<double>, scale array<double>, eigenvalues array<double>, "
                "components array<array<double>>")


def _by_user_and_day(daily: DataFrame) -> DataFrame:
    """Rows with __rn and __n (place in and length of the user's series), a user's rows together and in order."""
    user = Window.partitionBy("user")
    numbered = daily.withColumns({"__rn": F.row_number().over(user.orderBy("day")), "__n": F.count(F.lit(1)).over(user)})
    return numbered.repartition("user").sortWithinPartitions("user", "day")


def _values(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.column_stack([pc.fill_null(batch.column(f).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False) for f in features])


@dataclass
class _Stretch:
    """A batch with the last rows of the one before in front: user numbers, values, places, and the first new row."""

    user: np.ndarray
    x: np.ndarray
    rn: np.ndarray
    n: np.ndarray
    role: np.ndarray
    fresh: int


def _stretches(batches: Iterator[pa.RecordBatch], features: list[str], length: int) -> Iterator[tuple[pa.RecordBatch, _Stretch]]:
    held: _Stretch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rn = batch.column("__rn").to_numpy(zero_copy_only=False)
        now = _Stretch(np.cumsum(rn == 1), _values(batch, features), rn, batch.column("__n").to_numpy(zero_copy_only=False),
                       np.array(batch.column("role").to_pylist(), object), 0)
        if held is not None:
            last = held.user[-1]
            now = _Stretch(np.concatenate([held.user - last, now.user]), *(
                np.concatenate([getattr(held, k), getattr(now, k)]) for k in ("x", "rn", "n", "role")), len(held.user))
        yield batch, now
        keep = slice(max(0, len(now.user) - length + 1), None)
        held = _Stretch(now.user[keep], now.x[keep], now.rn[keep], now.n[keep], now.role[keep], 0)


def second_moments(daily: DataFrame, features: list[str] | None = None, length: int = C.SEQUENCE_LENGTH,
                   roles: list[str] | None = None) -> DataFrame:
    """model, a, b, block: the sum of outer products of places a <= b, over all sequences of the model.

    Each row has a 1 behind its features, so a block also holds sums of values and the number of sequences. The model
    of a sequence is the role of its last day, and all sequences count for the global one.
    """
    features, roles = features or C.DAILY_FEATURES, roles or C.MODEL_ROLES
    rows = _by_user_and_day(daily).select("role", *features, "__rn", "__n")

    def partial(batches):
        total: dict[str, np.ndarray] = {}
        size = len(features) + 1
        for _, s in _stretches(batches, features, length):
            x = np.column_stack([s.x, np.ones(len(s.x))])
            for lag in range(length):
                i = np.flatnonzero(s.user[lag:] == s.user[:len(s.user) - lag])
                i = i[i + lag >= s.fresh]  # pairs are counted when their second row is new
                place = s.rn[i] - 1
                low, high = np.maximum(0, place - (s.n[i] - length)), np.minimum(place, length - 1 - lag)
                i, low, high = (v[low <= high] for v in (i, low, high))
                for model in [C.GLOBAL_MODEL, *roles]:
                    own = np.ones(len(i), bool) if model == C.GLOBAL_MODEL else s.role[i] == model
                    if not own.any():
                        continue
                    sums = total.setdefault(model, np.zeros((length, length, size, size)))
                    whole = own & (low == 0) & (high == length - 1 - lag)
                    shared = x[i[whole]].T @ x[i[whole] + lag]
                    edge = own & ~whole
                    for a in range(length - lag):
                        at = i[edge & (low <= a) & (a <= high)]
                        sums[a, a + lag] += shared + x[at].T @ x[at + lag]
        for model, sums in total.items():
            pairs = [(a, b) for a in range(length) for b in range(a, length)]
            yield pa.RecordBatch.from_pydict({
                "model": pa.array([model] * len(pairs)), "a": pa.array([a for a, _ in pairs], pa.int32()),
                "b": pa.array([b for _, b in pairs], pa.int32()),
                "block": pa.array([sums[p].ravel() for p in pairs], pa.list_(pa.float64()))})

    found = rows.mapInArrow(partial, "model string, a int, b int, block array<double>")
    return found.groupBy("model", "a", "b").agg(vector_to_array(Summarizer.sum(array_to_vector("block"))).alias("block"))


def _solved(blocks: dict[tuple[int, int], np.ndarray], latent: int) -> dict:
    """Scaling and components from the blocks of one model."""
    length = 1 + max(b for _, b in blocks)
    size = blocks[0, 0].shape[0] - 1
    n = blocks[0, 0][-1, -1]
    second = np.zeros((length * size, length * size))
    for (a, b), block in blocks.items():
        second[a * size:(a + 1) * size, b * size:(b + 1) * size] = block[:-1, :-1]
        second[b * size:(b + 1) * size, a * size:(a + 1) * size] = block[:-1, :-1].T
    place_mean = np.concatenate([blocks[a, a][:-1, -1] for a in range(length)]) / n
    mean = place_mean.reshape(length, size).mean(axis=0)
    variance = np.diag(second).reshape(length, size).mean(axis=0) / n - mean * mean
    scale = np.where(variance > 1e-12 * (1 + mean * mean), np.sqrt(np.maximum(variance, 0)), 1.0)
    wide = np.tile(scale, length)
    covariance = (second / n - np.outer(place_mean, place_mean)) / np.outer(wide, wide)
    value, vector = np.linalg.eigh(covariance)
    order = np.argsort(-value)[:max(0, latent)]
    order = order[value[order] > LEAST_SHARE * max(value.sum(), 1e-300)]
    return {"n_sequences": int(round(n)), "mean": mean.tolist(), "scale": scale.tolist(),
            "eigenvalues": np.sort(value)[::-1].tolist(), "components": vector[:, order].T.tolist()}


def fit(daily: DataFrame, latent: int = C.LATENT_SIZE, features: list[str] | None = None, length: int = C.SEQUENCE_LENGTH,
        roles: list[str] | None = None) -> DataFrame:
    """The model table, written once: a row per role with sequences and one for the global model.

    `mean` and `scale` are per feature; `components` are unit vectors over (place, feature), strongest first, at most
    `latent`; `eigenvalues` are those of the whole covariance of the scaled sequences.
    """
    found: dict[str, dict] = {}
    for r in second_moments(daily, features, length, roles).collect():  # a fixed number of blocks per model
        side = int(round(len(r["block"]) ** 0.5))
        found.setdefault(r["model"], {})[r["a"], r["b"]] = np.array(r["block"]).reshape(side, side)
    rows = [(m, *(s[k] for k in ("n_sequences", "mean", "scale", "eigenvalues", "components")))
            for m, s in ((m, _solved(b, latent)) for m, b in sorted(found.items()) if b[0, 0][-1, -1] > 0)]
    return stage(daily.sparkSession.createDataFrame(rows, MODEL_SCHEMA), "sequence-models")


@dataclass
class SequenceModel:
    mean: np.ndarray
    scale: np.ndarray
    components: np.ndarray

    def errors(self, x: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(mean squared reconstruction error, projections) of the sequences that end at the rows `ends`."""
        z = (x - self.mean) / self.scale
        flat = np.lib.stride_tricks.sliding_window_view(z, (length, z.shape[1]))[ends - length + 1, 0].reshape(len(ends), -1)
        latent = flat @ self.components.T
        return ((flat - latent @ self.components) ** 2).mean(axis=1), latent


def load(models: DataFrame) -> dict[str, SequenceModel]:
    """The models by name: at most one per modelled role and the global one."""
    return {r["model"]: SequenceModel(np.array(r["mean"]), np.array(r["scale"]), np.array(r["components"], float).reshape(
        len(r["components"]), -1) if r["components"] else np.zeros((0, 1))) for r in models.collect()}


def score(daily: DataFrame, models: DataFrame, features: list[str] | None = None, length: int = C.SEQUENCE_LENGTH,
          with_latent: bool = False) -> DataFrame:
    """Daily rows with `own_error` (of the role's model) and `global_error` of the sequence that ends there.

    Both are null before a user's first full sequence, own_error also where the role has no model. `with_latent` adds
    `latent`: the projections under the model in charge.
    """
    features, kept = features or C.DAILY_FEATURES, daily.columns
    fitted = load(models)
    shared = daily.sparkSession.sparkContext.broadcast({  # at most one small matrix per role
        m: x if x.components.size else SequenceModel(x.mean, x.scale, np.zeros((0, length * len(features)))) for m, x in fitted.items()})
    fields = [T.StructField("own_error", T.DoubleType()), T.StructField("global_error", T.DoubleType())]
    if with_latent:
        fields.append(T.StructField("latent", T.ArrayType(T.DoubleType())))
    schema = T.StructType([*daily.schema.fields, *fields])

    def work(batches):
        models = shared.value
        for batch, s in _stretches(batches, features, length):
            new = len(s.user) - s.fresh
            own, everyone = np.full(new, np.nan), np.full(new, np.nan)
            latent: list = [None] * new
            ends = np.flatnonzero(s.rn >= length)
            ends = ends[ends >= s.fresh]
            for model, errors in [(C.GLOBAL_MODEL, everyone)] + [(m, own) for m in models if m != C.GLOBAL_MODEL]:
                mine = ends if model == C.GLOBAL_MODEL else ends[s.role[ends] == model]
                if not len(mine) or model not in models:
                    continue
                errors[mine - s.fresh], z = models[model].errors(s.x, mine, length)
                if with_latent:
                    for at, row in zip((mine - s.fresh).tolist(), z.tolist(), strict=True):
                        latent[at] = row
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(e, pa.float64(), from_pandas=True) for e in (own, everyone)]
            if with_latent:
                columns.append(pa.array(latent, pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return _by_user_and_day(daily).mapInArrow(work, schema)

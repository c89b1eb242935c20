"""Shared steps of the two operators that remove repeated windows of tokens.

A window is `window` consecutive tokens of one document. It is to be removed if the same tokens
also start earlier: in a document with a smaller id, or in the same document further left. A null
id counts as the smallest; rows with the same id count as one document, so two copies of a
row do not remove each other. Texts without tokens have no window.

1. Documents are dealt into blocks of about `BLOCK_BYTES` by a hash. All texts are shuffled once, by
   block; the three steps that read texts share that exchange.
2. A document whose whole text also belongs to a smaller id loses all its windows; only the first of equal texts goes on.
3. Every window has an anchor (see kernels.anchored_runs), so windows that are equal have equal
   anchors. Blocks count their anchors, and the counts of an anchor are summed; it has one row per block at most.
4. Blocks get those of their anchors that recur, and send the stretch of tokens around each
   of them to the shard of the anchor. An anchor with more than `HOT` occurrences has several
   shards, by document.
5. A shard collects equal stretches, and `settle` (the operator's method) finds for the windows of
   distinct stretches which is the earliest. All other windows are returned as runs.
6. For anchors with several shards, the earliest windows of the shards are compared once more by
   their digests: a shard sends one row for each window.
7. Blocks get the runs of their documents.

Nothing is collected, and no group is larger than a block, a shard, or one row for each of these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conductrisk.llm import kernels as K
from conductrisk.llm.rows import order_key, pack, row_key, text_of

#: Bytes of text in a block of documents; occurrences of an anchor per shard.
BLOCK_BYTES, HOT = 4_000_000, 4096
_ALL = (1 << 31) - 1  # as the length of a run: all windows of the document


@dataclass
class Stretch:
    """Tokens of one document: `count` windows from token `start`, the anchor at `at` tokens from there."""

    text: bytes
    place: tuple[int, int]  # (document, first token)
    count: int
    at: int
    copies: int = 1


@dataclass(frozen=True)
class Plan:
    """What the two operators do differently.

    tokens: (data, offsets) -> (token hashes, first token of each text, text of a run of tokens)
    settle: distinct stretches -> for each, a mask of the windows that start earlier elsewhere
    window_text: (stretch text, window number) -> bytes that are equal for equal windows
    """

    window: int
    phrase: int
    tokens: Callable
    settle: Callable[[list[Stretch]], list[np.ndarray]]
    window_text: Callable[[bytes, int], bytes]


def _slices(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in table.combine_chunks().to_batches():
        for first, n in K.pieces(text_of(batch)):
            yield batch.slice(first, n)


def _without(batch: pa.RecordBatch, copies: np.ndarray) -> pa.RecordBatch:
    return batch.filter(pa.array(~np.isin(batch.column("k").to_numpy(), copies)))


def _runs(plan: Plan, batch: pa.RecordBatch):
    data, offsets = K.buffer_of(text_of(batch))
    values, of_text, text = plan.tokens(data, offsets)
    runs = K.anchored_runs(values, of_text, plan.window, plan.phrase)
    owner = np.searchsorted(of_text, runs.first, side="right") - 1
    return runs, owner, of_text, text


_ANCHOR = "block long, h long, c long"


def _anchors(plan: Plan) -> Callable:
    """The anchors of a block and how often they occur in it."""

    def work(docs: pa.Table, copies: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.uint64)]
        for batch in _slices(docs):
            found.append(_runs(plan, _without(batch, copies.column("v").to_numpy()))[0].value)
        value, count = np.unique(np.concatenate(found), return_counts=True)
        block = docs.column("block")[0].as_py()
        return pa.table({"block": pa.array(np.full(len(value), block, np.int64)),
                         "h": pa.array(value.view(np.int64)), "c": pa.array(count)})
    return work


_STRETCH = "h long, salt int, salts int, k long, d long, s int, n int, at int, text binary"


def _stretches(plan: Plan) -> Callable:
    """The stretches around those anchors of a block that are listed."""

    def work(docs: pa.Table, listed: pa.Table) -> pa.Table:
        value, salts = listed.column("v").to_numpy(), listed.column("salts").to_numpy()
        copies = value[salts == 0]
        wanted, salts = value[salts > 0].view(np.uint64), salts[salts > 0]
        order = np.argsort(wanted)
        wanted, salts = wanted[order], salts[order]
        out = []
        for batch in _slices(docs):
            batch = _without(batch, copies)
            runs, owner, of_text, text = _runs(plan, batch)
            if not len(runs.value) or not len(wanted):
                continue
            at = np.minimum(np.searchsorted(wanted, runs.value), len(wanted) - 1)
            kept = np.flatnonzero(wanted[at] == runs.value)
            first, count, mine, parts = runs.first[kept], runs.count[kept], owner[kept], salts[at[kept]]
            keys = batch.column("k").to_numpy()[mine]
            stretches = [text(a, a + n + plan.window - 1) for a, n in zip(first, count, strict=True)]
            out.append(pa.RecordBatch.from_arrays([
                pa.array(runs.value[kept].view(np.int64)), pa.array(np.mod(keys, parts.astype(np.int64)).astype(np.int32)),
                pa.array(parts), pa.array(keys), pa.array(batch.column("d").to_numpy()[mine]),
                pa.array((first - of_text[mine]).astype(np.int32)), pa.array(count.astype(np.int32)),
                pa.array((runs.anchor[kept] - first).astype(np.int32)), pa.array(stretches, pa.binary()),
            ], schema=_STRETCH_ARROW))
        return pa.Table.from_batches(out, _STRETCH_ARROW)
    return work


_STRETCH_ARROW = pa.schema([("h", pa.int64()), ("salt", pa.int32()), ("salts", pa.int32()), ("k", pa.int64()), ("d", pa.int64()),
                            ("s", pa.int32()), ("n", pa.int32()), ("at", pa.int32()), ("text", pa.binary())])
_RUN = "k long, s int, n int, digest binary, d long"


def _shard(plan: Plan) -> Callable:
    """Runs of windows to remove (digest null), and for anchors with several shards the windows that are left."""

    def work(table: pa.Table) -> pa.Table:
        names = ["h", "salts", "k", "d", "s", "n", "at", "text"]
        rows = list(zip(*(table.column(c).to_pylist() for c in names), strict=True))
        groups: dict[tuple[int, bytes], list[int]] = {}
        for i, row in enumerate(rows):
            groups.setdefault((row[0], row[7]), []).append(i)
        out: list[tuple] = []
        distinct: list[Stretch] = []
        first: list[int] = []
        for members in groups.values():
            head = min(members, key=lambda i: (rows[i][3], rows[i][4]))
            place = (rows[head][3], rows[head][4])
            out += [(rows[i][2], rows[i][4], rows[i][5], None, None) for i in members
                    if (rows[i][3], rows[i][4]) != place]
            distinct.append(Stretch(rows[head][7], place, rows[head][5], rows[head][6], len(members)))
            first.append(head)
        for head, stretch, later in zip(first, distinct, plan.settle(distinct), strict=True):
            key, start = rows[head][2], stretch.place[1]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], later.astype(np.int8), [0]])))
            out += [(key, start + int(a), int(b - a), None, None) for a, b in edges.reshape(-1, 2)]
            if rows[head][1] > 1:
                digest = lambda o: hashlib.blake2b(plan.window_text(stretch.text, o), digest_size=16).digest()  # noqa: E731, B023
                out += [(key, start + o, 1, digest(o), stretch.place[0]) for o in np.flatnonzero(~later).tolist()]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                    ["k", "s", "n", "digest", "d"])
    return work


def deduplicated(docs: DataFrame, plan: Plan, work: Callable, fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """`row` and the columns that work(batch, gone) makes. Needs doc_id and text.

    `gone` is a function from the first token of each text to the mask of the batch's tokens to remove.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    length = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(partitions, -(-length // BLOCK_BYTES))
    block = F.pmod("k", F.lit(blocks)).alias("block")
    keyed = pack(docs).withColumns({"k": row_key(), "d": order_key()}).select("*", block)
    texts = keyed.groupBy("block")

    equal = keyed.select("k", "d", F.md5(F.encode("row.text", "utf-8")).alias("t")).filter("t is not null")
    first = equal.groupBy("t").agg(F.min("d").alias("first"), F.max("d").alias("last")).filter("first < last")
    copies = equal.join(first, "t").filter("d > first").select(block, F.col("k").alias("v"), F.lit(0).alias("salts"))

    anchors = texts.cogroup(copies.groupBy("block")).applyInArrow(_anchors(plan), _ANCHOR)
    total = F.sum("c").over(Window.partitionBy("h"))
    listed = anchors.withColumn("total", total).filter("total > 1").select(
        "block", F.col("h").alias("v"), F.ceil(F.col("total") / HOT).cast("int").alias("salts"))
    found = texts.cogroup(listed.unionByName(copies).groupBy("block")).applyInArrow(_stretches(plan), _STRETCH)

    shard = F.pmod(F.xxhash64("h", "salt"), F.lit(8 * partitions)).alias("shard")
    judged = found.groupBy(shard).applyInArrow(_shard(plan), _RUN)
    # rows of one digest: one per shard of an anchor at most; rows that are settled are dealt by document
    same = Window.partitionBy(F.coalesce("digest", F.col("k").cast("string").cast("binary")))
    runs = judged.withColumn("least", F.min(F.struct("d", "s")).over(same)).filter(
        F.col("digest").isNull() | (F.struct("d", "s") != F.col("least"))).select("k", "s", "n")
    runs = runs.unionByName(copies.select(F.col("v").alias("k"), F.lit(0).alias("s"), F.lit(_ALL).alias("n")))
    runs = runs.select("*", block)
    schema = T.StructType([keyed.schema["row"], *(T.StructField(n, t) for n, t in fields)])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        key = right.column("k").to_numpy()
        order = np.argsort(key, kind="stable")
        key, start, count = key[order], right.column("s").to_numpy()[order], right.column("n").to_numpy()[order]
        out = []
        for batch in _slices(left):
            gone = lambda of_text: _gone(batch.column("k").to_numpy(), key, start, count, of_text, plan.window)  # noqa: E731, B023
            new = [x if isinstance(x, pa.Array) else pa.array(x) for x in work(batch, gone)]
            out.append(pa.RecordBatch.from_arrays([batch.column("row"), *new], schema.names))
        return pa.Table.from_batches(out)

    return texts.cogroup(runs.groupBy("block")).applyInArrow(finish, schema)


def _gone(keys: np.ndarray, key: np.ndarray, start: np.ndarray, count: np.ndarray, of_text: np.ndarray,
          window: int) -> np.ndarray:
    """Mask of the tokens that lie in a run of windows; runs are ordered by key."""
    low, high = np.searchsorted(key, keys), np.searchsorted(key, keys, side="right")
    number = high - low
    owner = np.repeat(np.arange(len(keys)), number)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number) + low[owner]
    first = start[at] + of_text[owner]
    windows = np.minimum(count[at].astype(np.int64), of_text[owner + 1] - first - window + 1)
    some = windows > 0
    return K.covered(first[some], windows[some], window, int(of_text[-1]))

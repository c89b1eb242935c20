"""Language-model scores from a probabilistic suffix tree.

Symbols are the bytes of a text's words (A-Z lowered), one blank between words and one end
symbol. A context is the symbols before a position, up to `DEPTH` of them. Contexts come from the n-gram
counts of all training documents, and every n-gram counts. A context stays if its next-symbol distribution differs
from that of its suffix by a likelihood-ratio test, or if a longer context that stays ends in it.
Distributions are smoothed with those of the suffix (Witten-Bell). A symbol is scored by the longest context that stayed.

The tree grows with the corpus and stays in Spark. A context and all longer ones that end in it share their last
`KEY` symbols, so buckets of such endings are grown, tested and searched by themselves. Only contexts shorter
than `KEY` are collected and broadcast; their number is bounded by the alphabet of 256 bytes. Blocks of documents send the
distinct codes (context and symbol) they have to the buckets and get the scores back. Word counts for
the base score stay in Spark too: they are in buckets of their own, which get the distinct words of the blocks.

A null or empty text has one token, the end. Without training documents all symbols are equally
likely. Rows are scored one by one, so repeated rows get equal scores. A null id is in the fold of the empty text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conductrisk.llm import kernels as K
from conductrisk.llm.rows import broadcast, pack, row_key, text_of
from conductrisk.session import stage

#: Longest context; symbols at the end of a context that decide its bucket.
DEPTH, KEY = 6, 3
#: A context stays if its log likelihood ratio against its suffix is above TEST + TEST_EACH x (next symbols seen).
TEST, TEST_EACH = 10.0, 2.0
#: Bytes of text in a block of documents.
BLOCK_BYTES = 16_000_000
#: Distinct n-grams (or words) and bytes of text for each bucket; blocks that one task of a bucket answers.
BUCKET_GRAMS, BUCKET_BYTES, BLOCKS_A_TASK = 500_000, 64_000_000, 2048
#: Bytes of text that are made symbols at once; symbols that are counted at once; bytes of text for each part of the counts.
COUNT_BYTES, COUNT_SYMBOLS, PART_BYTES = 1_000_000, 8_000_000, 32_000_000
END = 10
#: Stands for the end of a text among the hashes of words.
END_WORD = np.uint64(0x9D5F0A1C3B2E4876)
_FLUSH = 1_000_000


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(context and symbol of every position as one number, bounds of the texts)."""
    pad = b"\0" * DEPTH
    parts = [pad + b" ".join(x.lower().split()) + bytes([END]) if x else pad + bytes([END])
             for x in texts.cast(pa.binary()).to_pylist()]
    sizes = np.array([len(x) for x in parts], np.int64)
    data = b"".join([b"\0" * (7 - DEPTH), *parts])
    # the eight bytes up to every position but the first of the padding, as numbers
    code = np.ndarray(max(0, len(data) - 7), ">u8", data, strides=(1,))
    # positions whose own symbol is padding are no symbols of the text
    begins = np.cumsum(sizes) - sizes
    real = np.ones(len(code) + DEPTH, bool)
    for i in range(DEPTH):
        real[begins + i] = False
    code = code.astype(np.uint64)[real[DEPTH:]].view(np.int64)
    return _low(code, DEPTH + 1), np.concatenate([[0], np.cumsum(sizes - DEPTH)])


def _low(code: np.ndarray, n: int) -> np.ndarray:
    return code & ((1 << (8 * n)) - 1)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text)."""
    data, offsets = K.buffer_of(texts)
    words = K.words_of(K.lower(data), offsets)
    return words.hashes(), words.of_text


def _begins(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[:len(ordered)])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, how often each comes); orders `values` itself, as plain sorting needs the least time."""
    values.sort()
    begins = _begins(values)
    found, n = values[begins], len(begins)
    for i in range(0, n - 1, _FLUSH):  # a stretch at a time, begins become counts in place
        last = min(i + _FLUSH, n - 1)
        begins[i:last] = begins[i + 1:last + 1] - begins[i:last]
    begins[n - 1:] = len(values) - begins[n - 1:]
    return found, begins


def _dealt(of: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(the parts that occur, the places of each); `of` is below n. Small numbers are ordered by their digits."""
    of = of.astype(np.min_scalar_type(n), copy=False)
    size = np.bincount(of, minlength=n)
    order, ends = np.argsort(of, kind="stable"), np.cumsum(size)
    parts = np.flatnonzero(size)
    return parts, [order[ends[i] - size[i]:ends[i]] for i in parts]


class _Tally:
    """Counts of 64-bit values, merged whenever many have come together."""

    def __init__(self):
        self.values, self.counts, self.waiting = [], [], 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.values.append(values)
        self.counts.append(counts)
        self.waiting += len(values)
        if self.waiting > max(2 * _FLUSH, 2 * len(self.values[0])):
            self.merge()

    def merge(self) -> None:
        if self.values:
            values, counts = np.concatenate(self.values), np.concatenate(self.counts)
            self.values = self.counts = None  # the parts go before their order is made
            order = np.argsort(values)
            values, counts = values[order], counts[order]
            del order
            begins = _begins(values)
            counts = np.add.reduceat(counts, begins) if len(begins) else counts
            self.values, self.counts, self.waiting = [values[begins]], [counts], len(begins)


def counted(docs: DataFrame, parts: int) -> DataFrame:
    """(kind, value, c): counts of n-grams (kind 0) and of words (kind 1) of all texts.

    Tasks send what they have counted as lists, one for each part of the values; a part adds up its lists one at a time.
    """

    def lists(kind: int, values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        # a stretch at a time is mixed, a part at a time is copied
        of = np.empty(len(values), np.min_scalar_type(parts))
        for i in range(0, len(values), _FLUSH):
            of[i:i + _FLUSH] = K.mix(values[i:i + _FLUSH].view(np.uint64)) % np.uint64(parts)
        found, places = _dealt(of, parts)
        return pa.RecordBatch.from_pydict({
            "kind": pa.array(np.full(len(found), kind, np.int32)), "part": pa.array(found),
            "n": pa.array([len(x) for x in places], pa.int64()),
            "values": pa.array([_squeezed(np.diff(values[x], prepend=0)) for x in places], pa.binary()),
            "counts": pa.array([_squeezed(counts[x]) for x in places], pa.binary())})

    def work(batches):
        # one array is filled: lists of arrays would have to be copied together
        held, filled, words, texts = np.empty(COUNT_SYMBOLS, np.int64), 0, [], 0

        def rows():
            nonlocal held
            found, counts = _runs(held[:filled])
            held = np.empty(0, np.int64)  # what was counted goes before the lists are made
            yield lists(0, found, counts)
            found, counts = _runs(np.concatenate(words))
            words.clear()
            yield lists(1, np.append(found, END_WORD).view(np.int64), np.append(counts, texts))
            pa.default_memory_pool().release_unused()

        for batch in batches:
            for first, n in K.pieces(text_of(batch), COUNT_BYTES):
                piece = text_of(batch.slice(first, n))
                codes = symbols(piece)[0]
                if texts and filled + len(codes) > len(held):
                    yield from rows()
                    filled = texts = 0
                if len(codes) > len(held):  # nothing is in it
                    held = np.empty(max(COUNT_SYMBOLS, len(codes)), np.int64)
                held[filled:filled + len(codes)] = codes
                words.append(_words(piece)[0])
                filled, texts = filled + len(codes), texts + n
        if texts:
            yield from rows()

    def added(table: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        tally = _Tally()
        for i in range(len(table)):
            n, values, counts = (table.column(c)[i].as_py() for c in ("n", "values", "counts"))
            tally.add(np.cumsum(_restored(values, n, np.int64)), _restored(counts, n, np.int64))
        tally.merge()
        kind = np.full(len(tally.values[0]), table.column("kind")[0].as_py(), np.int32)
        return pa.table({"kind": pa.array(kind), "value": pa.array(tally.values[0]), "c": pa.array(tally.counts[0])})

    found = pack(docs.select("text")).mapInArrow(work, "kind int, part long, n long, values binary, counts binary")
    return found.groupBy("kind", "part").applyInArrow(added, "kind int, value long, c long")


@dataclass
class SuffixTree:
    """By depth: contexts in order with the log weight of their suffix, and entries (context, symbol) in
    order with their log probability. Depth 0 is the table of all 256 symbols."""

    root: np.ndarray
    contexts: list[np.ndarray] = field(default_factory=list)
    to_suffix: list[np.ndarray] = field(default_factory=list)
    entries: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)

    def copy(self) -> SuffixTree:
        """A tree of its own that shares the arrays."""
        return SuffixTree(self.root, *(list(x) for x in (self.contexts, self.to_suffix, self.entries, self.logs)))

    def score(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each code after the symbols before it."""
        out, left = np.zeros(len(code)), np.arange(len(code))
        for depth in range(len(self.contexts), 0, -1):
            here, at = _find(self.contexts[depth - 1], _low(code[left] >> 8, depth))
            hit, entry = _find(self.entries[depth - 1], _low(code[left], depth + 1))
            hit &= here
            out[left[hit]] += self.logs[depth - 1][entry[hit]]
            weigh = here & ~hit
            out[left[weigh]] += self.to_suffix[depth - 1][at[weigh]]
            left = left[~hit]
        out[left] += self.root[_low(code[left], 1)]
        return out / np.log(10)


def _find(ordered: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(ordered):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
    return ordered[at] == wanted, at


def _extend(tree: SuffixTree, by_depth: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Add the next depths from the counts of (context, symbol); returns what the test of each context says.

    The tree must have the suffixes of all contexts.
    """
    ratios = []
    for code, count in by_depth:
        order = np.argsort(code)
        code, count = code[order], count[order].astype(float)
        contexts, at, seen = np.unique(code >> 8, return_inverse=True, return_counts=True)
        mass = np.bincount(at, count, len(contexts))
        # what the suffix says about the symbol: the tree so far is exactly the suffixes
        suffix = np.exp(tree.score(code) * np.log(10))
        probability = (count + seen[at] * suffix) / (mass + seen)[at]
        ratios.append(np.bincount(at, count * np.log(probability / suffix), len(contexts)) - TEST_EACH * seen)
        tree.contexts.append(contexts)
        tree.to_suffix.append(np.log(seen / (mass + seen)))
        tree.entries.append(code)
        tree.logs.append(np.log(probability))
    return ratios


def _prune(tree: SuffixTree, ratios: list[np.ndarray], needed: np.ndarray) -> np.ndarray:
    """Drop contexts of the last len(ratios) depths that neither pass nor are `needed` as suffixes; returns what those need."""
    for depth, ratio in zip(range(len(tree.contexts), 0, -1), reversed(ratios), strict=False):
        contexts = tree.contexts[depth - 1]
        stays = (ratio > TEST) | np.isin(contexts, needed)
        needed = np.unique(_low(contexts[stays], depth - 1))
        entry = stays[np.searchsorted(contexts, tree.entries[depth - 1] >> 8)]
        tree.contexts[depth - 1], tree.to_suffix[depth - 1] = contexts[stays], tree.to_suffix[depth - 1][stays]
        tree.entries[depth - 1], tree.logs[depth - 1] = tree.entries[depth - 1][entry], tree.logs[depth - 1][entry]
    return needed


def _root(code: np.ndarray, count: np.ndarray, total: int) -> SuffixTree:
    single = np.zeros(256)
    single[code] = count
    return SuffixTree(np.log((single + 0.5) / (total + 0.5 * 256)))


def grow(by_depth: list[tuple[np.ndarray, np.ndarray]], total: int) -> SuffixTree:
    """The tree from the counts of (context, symbol) by depth; by_depth[0] counts single symbols."""
    tree = _root(*by_depth[0], total)
    _prune(tree, _extend(tree, by_depth[1:]), np.zeros(0, np.int64))
    return tree


def _shortened(code: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the last n symbols."""
    short, at = np.unique(_low(code, n), return_inverse=True)
    return short, np.bincount(at, count, len(short))


def _bucket(code: np.ndarray, buckets: int) -> np.ndarray:
    return (_low(code >> 8, KEY) * 2654435761 >> 16) % buckets


def _bucket_column(buckets: int) -> Column:
    """As `_bucket`, of the column `value`."""
    key = F.shiftright("value", 8).bitwiseAND((1 << (8 * KEY)) - 1)
    return F.shiftright(key * F.lit(2654435761), 16) % F.lit(buckets)


_TREE = "bucket long, depth int, entry boolean, value long, log double"


def fit_tree(grams: DataFrame, buckets: int) -> tuple[SuffixTree, DataFrame]:
    """(contexts shorter than `KEY`, table `_TREE` of the others) from (value, c): contexts of full depth with their symbol."""
    spark = grams.sparkSession
    # at most 256^KEY rows
    found = grams.groupBy(F.col("value").bitwiseAND((1 << (8 * KEY)) - 1).alias("code")).agg(F.sum("c").alias("c")).toArrow()
    code, count = (found.column(i).to_numpy() for i in range(2))
    total = int(count.sum())
    short = _root(*_shortened(code, count, 1), total)
    ratios = _extend(short, [_shortened(code, count, n) for n in range(2, KEY + 1)])
    known = broadcast(spark, short)

    def work(table: pa.Table) -> pa.Table:
        code, count = (table.column(c).to_numpy() for c in ("value", "c"))
        tree = known.value.copy()
        deep = _extend(tree, [_shortened(code, count, n) for n in range(KEY + 1, DEPTH + 2)])
        _prune(tree, deep, np.zeros(0, np.int64))
        out = []
        for depth in range(KEY, DEPTH + 1):
            for entry, values, logs in ((False, tree.contexts, tree.to_suffix), (True, tree.entries, tree.logs)):
                n = len(values[depth - 1])
                out.append(pa.table({"bucket": pa.array(np.full(n, table.column("bucket")[0].as_py(), np.int64)),
                                     "depth": pa.array(np.full(n, depth, np.int32)), "entry": pa.array(np.full(n, entry)),
                                     "value": pa.array(values[depth - 1]), "log": pa.array(logs[depth - 1])}))
        return pa.concat_tables(out)

    rows = grams.withColumn("bucket", _bucket_column(buckets))
    deep = stage(rows.groupBy("bucket").applyInArrow(work, _TREE), "lm-tree")
    # at most 256^(KEY - 1) rows
    needed = deep.filter((F.col("depth") == KEY) & ~F.col("entry")).select(
        F.col("value").bitwiseAND((1 << (8 * (KEY - 1))) - 1).alias("x")).distinct().toArrow()
    short = short.copy()
    _prune(short, ratios, needed.column(0).to_numpy())
    return short, deep


def _squeezed(values: np.ndarray) -> bytes:
    """Eight-byte values, compressed by place of the byte."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _restored(data: bytes, n: int, kind: type) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).reshape(-1).view(kind)


def _distinct(parts: Iterable[np.ndarray]) -> np.ndarray:
    """The distinct values of all parts, in ascending order."""
    found, waiting = [np.zeros(0, np.int64)], 0
    for part in parts:
        found.append(_runs(part)[0])
        waiting += len(found[-1])
        if waiting > max(_FLUSH, 2 * len(found[0])):
            found = [_runs(np.concatenate(found))[0]]
            waiting = len(found[0])
    return _runs(np.concatenate(found))[0]


def _asked(buckets: tuple[int, int], salts: int) -> Callable[[pa.Table], pa.Table]:
    """The distinct codes (kind 0) and words (kind 1) of a block by bucket, in ascending order, as differences."""

    def work(table: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        block, out = table.column("block")[0].as_py(), []
        for kind, values_of in enumerate((lambda x: symbols(x)[0], lambda x: _words(x)[0].view(np.int64))):
            values = _distinct(values_of(text_of(batch.slice(first, n))) for batch in table.to_batches()
                               for first, n in K.pieces(text_of(batch), COUNT_BYTES))
            parts, places = _dealt(_bucket(values, buckets[kind]), buckets[kind])
            out.append(pa.table({
                "kind": pa.array(np.full(len(parts), kind, np.int32)), "bucket": pa.array(parts),
                "salt": pa.array(np.full(len(parts), block % salts, np.int64)),
                "block": pa.array(np.full(len(parts), block, np.int64)), "n": pa.array([len(x) for x in places], pa.int64()),
                "asked": pa.array([_squeezed(np.diff(values[x], prepend=0)) for x in places], pa.binary())}))
            del values, places
        return pa.concat_tables(out)

    return work


def _in_order(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns in the order of the first."""
    columns = [table.column(x).to_numpy() for x in names]
    order = np.argsort(columns[0])
    return [x[order] for x in columns]


def _answers(short) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The scores of the codes (or the counts of the words) that blocks ask for, from a bucket."""

    def scores_of(right: pa.Table) -> Callable[[np.ndarray], np.ndarray]:
        tree = short.value.copy()
        value, depth, entry, log = _in_order(right, "value", "depth", "entry", "log")
        for d in range(KEY, DEPTH + 1):
            here = depth == d
            tree.contexts.append(value[here & ~entry])
            tree.to_suffix.append(log[here & ~entry])
            tree.entries.append(value[here & entry])
            tree.logs.append(log[here & entry])
        return tree.score

    def counts_of(right: pa.Table) -> Callable[[np.ndarray], np.ndarray]:
        value, count = _in_order(right, "value", "c")

        def look(wanted: np.ndarray) -> np.ndarray:
            hit, at = _find(value, wanted)
            return np.where(hit, count[at], 0) if len(value) else np.zeros(len(wanted), np.int64)

        return look

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        n, out, first = left.column("n").to_numpy(), [], 0
        look = (counts_of if len(n) and left.column("kind")[0].as_py() else scores_of)(right) if len(n) else None
        ends = np.cumsum(n)
        while first < len(n):  # some lists at a time are restored
            last = max(first + 1, int(np.searchsorted(ends, ends[first] - n[first] + _FLUSH, side="right")))
            lists = [np.cumsum(_restored(left.column("asked")[i].as_py(), int(n[i]), np.int64)) for i in range(first, last)]
            value, at = np.unique(np.concatenate(lists), return_inverse=True)
            del lists
            out.append(pa.array([_squeezed(x) for x in np.split(look(value)[at], np.cumsum(n[first:last])[:-1])], pa.binary()))
            first = last
        return left.select(["kind", "block", "n", "asked"]).append_column("found", pa.chunked_array(out, pa.binary()))

    return work


def _opened(lists: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values of the lists in order, what was found for them)."""
    total = pc.sum(lists.column("n")).as_py() or 0
    values, answers, filled = np.empty(total, np.int64), np.empty(total, kind), 0
    for i in range(len(lists)):  # one list at a time is restored
        n, asked, found = (lists.column(c)[i].as_py() for c in ("n", "asked", "found"))
        np.cumsum(_restored(asked, n, np.int64), out=values[filled:filled + n])
        answers[filled:filled + n] = _restored(found, n, kind)
        filled += n
    order = np.argsort(values)
    values = values[order]
    return values, answers[order]


def score(docs: DataFrame, learn: Callable[[str], Column]) -> DataFrame:
    """`row`, held_out, n_tokens, n_known, train_tokens, base_score and score. Needs doc_id and text.

    `learn` makes the condition for training rows from the name of the id column.
    """
    spark = docs.sparkSession
    length = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # both kinds of counts are read more than once
    counts = stage(counted(docs.filter(learn("doc_id")), max(1, -(-length // PART_BYTES))), "lm-counts")
    grams, words = (counts.filter(F.col("kind") == kind).select("value", "c") for kind in (0, 1))
    buckets = max(1, -(-grams.count() // BUCKET_GRAMS), -(-length // BUCKET_BYTES))
    short, deep = fit_tree(grams, buckets)
    size = words.agg(F.sum("c"), F.count("c")).first()
    tokens, distinct = size[0] or 0, size[1]
    end = words.filter(F.col("value") == int(END_WORD.view(np.int64))).first()
    end_count = end["c"] if end else 0
    blocks = max(1, -(-length // BLOCK_BYTES))
    rows = pack(docs).withColumns({"held_out": ~learn("row.doc_id"), "block": F.pmod(row_key(), F.lit(blocks))})
    of_words = max(1, -(-distinct // BUCKET_GRAMS), -(-length // BUCKET_BYTES))
    salts = -(-blocks // BLOCKS_A_TASK)
    asked = rows.groupBy("block").applyInArrow(
        _asked((buckets, of_words), salts), "kind int, bucket long, salt long, block long, n long, asked binary")
    of_bucket = (deep.withColumn("kind", F.lit(0))
                 .unionByName(words.withColumns({"kind": F.lit(1), "bucket": _bucket_column(of_words)}), allowMissingColumns=True)
                 .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))))
    known = asked.groupBy("kind", "bucket", "salt").cogroup(of_bucket.groupBy("kind", "bucket", "salt")).applyInArrow(
        _answers(broadcast(spark, short)), "kind int, block long, n long, asked binary, found binary")
    schema = T.StructType([rows.schema["row"], rows.schema["held_out"], T.StructField("n_tokens", T.LongType()),
                           T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    base_log = lambda c: np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, logs = _opened(right.filter(pc.equal(right.column("kind"), 0)), np.float64)
        value, count = _opened(right.filter(pc.equal(right.column("kind"), 1)), np.int64)
        pa.default_memory_pool().release_unused()
        out = []
        for batch in left.to_batches():
            for first, n in K.pieces(text_of(batch), COUNT_BYTES):
                part = batch.slice(first, n)
                words, of_text = _words(text_of(part))
                # in order they are found faster
                wanted, of = np.unique(words.view(np.int64), return_inverse=True)
                hit, at = _find(value, wanted)
                c = np.where(hit, count[at], 0)[of] if len(value) else np.zeros(len(words), np.int64)
                code, bounds = symbols(text_of(part))
                order = np.argsort(code)
                code = code[order]
                begins = _begins(code)
                each = np.empty(len(code))
                each[order] = np.repeat(logs[np.searchsorted(codes, code[begins])], np.diff(np.append(begins, len(code))))
                out.append(pa.RecordBatch.from_arrays([
                    part.column("row"), part.column("held_out"), pa.array(np.diff(of_text) + 1),
                    pa.array(K.sums((c > 0).astype(np.int64), of_text) + int(end_count > 0)),
                    pa.array(np.full(n, tokens, np.int64)),
                    pa.array(K.sums(base_log(c), of_text) + base_log(end_count)),
                    pa.array(K.sums(each, bounds)),
                ], schema.names))
        return pa.Table.from_batches(out)

    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(work, schema)


"""Best-fit packing of documents into bins of `CAPACITY` words, under conflicts.

A text with more words than a bin holds is cut into pieces of whole bins and a rest; every word is
in exactly one piece. Pieces are spread over shards of about `SHARD_ROWS` by a hash, and each
shard is packed by itself: longest piece first, into the open bin with the least room that is enough
and that holds neither a piece of the same source nor of the same cluster. Bins are
ordered by the room that is left and carry one bitmap of their sources and one of their clusters; the search goes on from bin
to bin by rising room until one is compatible, and opens a new bin if none is.

Two documents are in one cluster if their words are equal (A-Z lowered). A null source conflicts with
nothing. Null and empty texts yield one piece without words and without a bin. Repeated rows are
packed as separate documents of one cluster. Equal lengths are taken in the order of a hash of id, text and piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conductrisk.llm import kernels as K
from conductrisk.llm.rows import map_texts, pack, row_key, text_of

#: Words in a bin; pieces in a shard, on average.
CAPACITY, SHARD_ROWS = 2048, 4096


class Bins:
    """Open bins of one shard, ordered by the room that is left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0  # bit r: some bin has room r
        self.room: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _next_room(self, least: int) -> int:
        """The smallest room of at least `least`, or -1."""
        above = self.rooms >> least
        return least + (above & -above).bit_length() - 1 if above else -1

    def place(self, length: int, source: int, cluster: int) -> int:
        """Put a piece into the tightest compatible bin; source and cluster are bits."""
        room = self._next_room(length)
        while room >= 0:
            for at, number in enumerate(self.by_room[room]):
                if not (self.sources[number] & source or self.clusters[number] & cluster):
                    del self.by_room[room][at]
                    if not self.by_room[room]:
                        self.rooms &= ~(1 << room)
                    self._fill(number, length, source, cluster)
                    return number
            room = self._next_room(room + 1)
        self.room.append(self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        self._fill(len(self.room) - 1, length, source, cluster)
        return len(self.room) - 1

    def _fill(self, number: int, length: int, source: int, cluster: int) -> None:
        self.room[number] -= length
        self.sources[number] |= source
        self.clusters[number] |= cluster
        if self.room[number]:
            self.by_room[self.room[number]].append(number)
            self.rooms |= 1 << self.room[number]


def pack_shard(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, first word in the bin) of each piece; pieces are given in the order in which they are placed."""
    bits: dict = {}
    groups: dict = {}
    bins, out = Bins(capacity), []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        mine = 0 if source is None else 1 << bits.setdefault(source, len(bits))
        number = bins.place(length, mine, 1 << groups.setdefault(cluster, len(groups)))
        out.append((number, capacity - bins.room[number] - length))
    return out


def _lengths(batch: pa.RecordBatch) -> list[np.ndarray]:
    data, offsets = K.buffer_of(text_of(batch))
    words = K.words_of(K.lower(data), offsets)
    counts = words.counts()
    number = np.arange(len(words.start)) - words.of_text[:-1][words.text_of_word()] if len(words.start) else np.zeros(0)
    # order-dependent digest of the words of a text
    spread = K.mix(words.hashes() ^ K.mix(number.astype(np.uint64)))
    return [counts, K.sums(spread.view(np.int64), words.of_text)]


def packed(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, part, first_word, n_words, bin, place: pieces, their bin and their first word within it.

    Needs doc_id, text and source.
    """
    rows = pack(docs.select("doc_id", "text", "source")).withColumn("k", row_key())
    measured = map_texts(rows.select(F.struct("row.doc_id", "row.text", "row.source", "k").alias("row")), _lengths,
                         [("n", T.LongType()), ("cluster", T.LongType())])
    pieces = measured.select(
        "row.doc_id", "row.source", "row.k", "n", "cluster",
        F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("int") - 1)).alias("part"),
    ).withColumns({
        "first_word": (F.col("part") * F.lit(capacity)).cast("long"),
        "length": F.least(F.lit(capacity), F.col("n") - F.col("part") * F.lit(capacity)).cast("int"),
        "turn": F.xxhash64("k", "part"),
    })
    total = docs.count()
    shards = max(1, -(-total // shard_rows))
    schema = "doc_id long, part int, first_word long, n_words int, bin long, place int"

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("turn", "ascending"), ("first_word", "ascending")])
        full = table.filter(pc.greater(table.column("length"), 0))
        empty = table.filter(pc.equal(table.column("length"), 0))
        length = full.column("length").to_pylist()
        found = pack_shard(length, full.column("source").to_pylist(), full.column("cluster").to_pylist(), capacity)
        base = table.column("shard")[0].as_py() << 32
        nothing = [None] * len(empty)
        both = pa.concat_tables([full, empty]).select(["doc_id", "part", "first_word", "length"])
        return (both.rename_columns(["doc_id", "part", "first_word", "n_words"])
                .append_column("bin", pa.array([base + b for b, _ in found] + nothing, pa.int64()))
                .append_column("place", pa.array([p for _, p in found] + nothing, pa.int32())))

    shard = F.pmod("turn", F.lit(shards)).alias("shard")
    return pieces.drop("k", "n").withColumn("shard", shard).groupBy("shard").applyInArrow(work, schema)

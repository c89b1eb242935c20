"""MinHash near-dedup with bottom-k sketches from one hash function.

A document's set holds its distinct shingles of `SHINGLE` words (A-Z lowered); a text with fewer words
is one shingle. One hash function orders all shingles; the sketch keeps the `SKETCH` smallest values.

1. Documents with equal sets are one class; only one of them goes on.
2. Inverted lists: every run of `RUN` neighbouring retained values points to the classes that have it. If
   the whole set is retained, two sets with Jaccard 0.75 share a run for certain: at most a quarter of the union
   separates the other three quarters into pieces, one of which has `RUN` values (unions of 4 and 8
   values need runs of two, which sets of up to 8 values also list). Larger sets miss all runs with
   a chance below 1e-6.
3. A class is paired with the smallest of the list heads that it shares many lists with. The estimate from the union of the
   two sketches sorts the pairs: those that may be links are confirmed on the full sets, and those
   that are fairly alike form families. Families that meet in a list are paired by their heads in the same way.
4. Within a family, classes that are not yet connected are compared on their full sets, all in one task or, for
   more than `FAMILY_ROWS` classes, block by block. Only links that connect something are returned.
5. Pairs of a list in different families and components must pass the estimate and are then confirmed.
6. Components of all links are found by contraction.

Estimates that decide anything leave a margin of five standard deviations.

A null or empty text has an empty set and links with nothing. Rows with equal id and text are one
document; a null id counts as the smallest id, and the component id is null then.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conductrisk.llm import kernels as K
from conductrisk.llm.components import components
from conductrisk.llm.rows import map_texts, order_key, pack, row_key, text_of
from conductrisk.session import stage

SHINGLE, SKETCH, RUN = 5, 80, 3
#: Similarity in hundredths.
SIMILAR = 75
#: Estimate that a pair must reach to be confirmed.
LIKELY = SIMILAR / 100 - 5 * (0.75 * 0.25 / SKETCH) ** 0.5
#: Estimate of members of a family with its head; classes of a family in one task.
ALIKE, FAMILY_ROWS = 0.4, 4096
#: Bytes of text whose shingles are made at once.
BLOCK_BYTES = 1_000_000


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, owners) of the distinct shingles, ordered by owner and value; values are below 2^63."""
    data, offsets = K.buffer_of(texts)
    words = K.words_of(K.lower(data), offsets)
    value, owner = words.hashes(), words.text_of_word()
    runs = K.run_hashes(value, SHINGLE)
    whole = owner[:len(runs)] == owner[SHINGLE - 1:]
    values, owners = [runs[whole]], [owner[:len(runs)][whole]]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(words.counts() == n)
        values.append(K.run_hashes(value, n)[words.of_text[short]] if len(short) else np.zeros(0, np.uint64))
        owners.append(short)
    value, owner = np.concatenate(values) >> np.uint64(1), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[fresh].astype(np.int64), owner[fresh]


def _sets(batch: pa.RecordBatch) -> list:
    value, owner = shingles(text_of(batch))
    bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
    spread = K.mix(value.astype(np.uint64))
    digests = [K.sums(x.view(np.int64), bounds) for x in (spread, K.mix(spread ^ np.uint64(0x5851F42D4C957F2D)))]
    rank = np.arange(len(value)) - bounds[:-1][owner]
    kept = rank < SKETCH
    sizes = np.minimum(np.diff(bounds), SKETCH)
    sketch = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                                      pa.array(value[kept]))
    return [np.diff(bounds), *digests, sketch]


def set_sizes(docs: DataFrame) -> DataFrame:
    """`row` (doc_id, text), n_shingles, two digests of the set, and the sketch in ascending order."""
    return map_texts(docs, _sets, [("n_shingles", T.LongType()), ("g1", T.LongType()), ("g2", T.LongType()),
                                   ("sketch", T.ArrayType(T.LongType()))], BLOCK_BYTES)


def inverted_lists(classes: DataFrame) -> DataFrame:
    """(v, k): runs of retained values and the classes that have them, for runs of two or more classes."""
    run = lambda n: F.expr(f"""transform(sequence(0, size(sketch) - {n}), i ->
        xxhash64({', '.join(f'sketch[i + {j}]' for j in range(n))}))""")  # noqa: E731
    runs = (F.when(F.size("sketch") <= 2, F.array().cast("array<long>"))
            .when(F.size("sketch") <= 8, F.concat(run(RUN), run(2))).otherwise(run(RUN)))
    lists = classes.select(F.explode(runs).alias("v"), "k")
    often = lists.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("v")
    return lists.join(often, "v", "left_semi")


def _similar(batch: pa.RecordBatch) -> np.ndarray:
    """Exact comparison of the full sets of text_a and text_b."""
    both, sizes = [], np.zeros(batch.num_rows, np.int64)
    for side in ("text_a", "text_b"):
        value, owner = shingles(batch.column(side))
        both.append((value, owner))
        sizes += np.bincount(owner, minlength=batch.num_rows)
    value, owner = (np.concatenate(x) for x in zip(*both, strict=True))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    same = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
    common = np.bincount(owner[1:][same], minlength=batch.num_rows)
    return 100 * common >= SIMILAR * (sizes - common)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar; texts has k and text."""
    side = lambda s: texts.select(F.col("k").alias(s), F.col("text").alias(f"text_{s}"))

    def check(batches):
        for batch in batches:
            for first, n in K.pieces(batch.column("text_a"), BLOCK_BYTES):
                part = batch.slice(first, n)
                yield part.select(["a", "b"]).filter(pa.array(_similar(part)))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(check, "a long, b long")


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) with `est`: the share of common values among the smallest values of both sketches."""
    side = lambda s: nodes.select(F.col("k").alias(s), F.col("sketch").alias(f"sketch_{s}"))
    union = F.slice(F.sort_array(F.array_union("sketch_a", "sketch_b")), 1, SKETCH)
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("union", union)
    common = F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), "union")
    return both.select("a", "b", (F.size(common) / F.size("union")).alias("est"))


def _list_pairs(table: pa.Table) -> pa.Table:
    """Pairs of a shard's lists in different families and components that may be similar by their sketches."""
    v, k, family, label, size = (table.column(c).to_numpy() for c in ("v", "k", "family", "label", "n"))
    lists = table.column("sketch").combine_chunks()
    bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    sketch = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    order = np.argsort(v, kind="stable")
    edges = np.flatnonzero(np.diff(v[order], prepend=v[order][:1] - 1 if len(v) else 0))
    found: set[tuple[int, int]] = set()
    for members in np.split(order, edges[1:]):
        if len(np.unique(label[members])) < 2 or len(np.unique(family[members])) < 2:
            continue
        length = np.array([len(sketch[i]) for i in members], np.int64)
        index = _Holders(np.concatenate([sketch[i] for i in members]), np.repeat(np.arange(len(members)), length))
        for at, i in enumerate(members[:-1]):
            # values in common are an upper bound of what the estimate counts
            likely = (index.common(at) >= LIKELY * np.maximum(length, length[at])) & (label[members] != label[i]) \
                & (family[members] != family[i]) \
                & (100 * np.minimum(size[members], size[i]) >= SIMILAR * np.maximum(size[members], size[i]))
            likely[:at + 1] = False
            for j in members[likely]:
                union = np.union1d(sketch[i], sketch[j])[:SKETCH]
                both = np.isin(union, sketch[i], assume_unique=True) & np.isin(union, sketch[j], assume_unique=True)
                if both.sum() >= LIKELY * len(union):
                    found.add((int(min(k[i], k[j])), int(max(k[i], k[j]))))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


class _Holders:
    """Which sets hold a value: counts common values of one set with all others. Pairs (value, owner) in order of owner."""

    def __init__(self, value: np.ndarray, owner: np.ndarray):
        order = np.argsort(value, kind="stable")
        self.holder = owner[order]
        _, self.first, self.number = np.unique(value[order], return_index=True, return_counts=True)
        self.place = np.empty(len(value), np.int64)
        self.place[order] = np.repeat(np.arange(len(self.first)), self.number)
        self.sets = int(owner[-1]) + 1 if len(owner) else 0
        self.bounds = np.searchsorted(owner, np.arange(self.sets + 1))

    def common(self, i: int) -> np.ndarray:
        mine = self.place[self.bounds[i]:self.bounds[i + 1]]
        length = self.number[mine]
        at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(self.first[mine], length)
        return np.bincount(self.holder[at], minlength=self.sets)


def _family_links(table: pa.Table) -> pa.Table:
    """Links between the components of a family (or of two of its blocks), as few as connect them."""
    k, label, block = (table.column(c).to_numpy() for c in ("k", "label", "block"))
    value, owner = shingles(table.column("text").combine_chunks())
    size = np.bincount(owner, minlength=len(k))
    group = {x: x for x in np.unique(label).tolist()}

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    index = _Holders(value, owner)  # every class has a shingle
    names, many = np.unique(label, return_counts=True)
    largest = names[many.argmax()]
    one_block = len(np.unique(block)) == 1
    found = []
    for i in np.flatnonzero(label != largest).tolist():
        common = index.common(i)
        alike = (100 * common >= SIMILAR * (size + size[i] - common)) & (label != label[i])
        if not one_block:
            alike &= block != block[i]
        for j in np.flatnonzero(alike).tolist():
            a, b = root(int(label[i])), root(int(label[j]))
            if a != b:
                group[a] = b
                found.append((int(k[i]), int(k[j])))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _grouped(rows: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """rows with the component of k under `name`; a class without a link is its own."""
    found = components(links).select(F.col("node").alias("k"), F.col("label").alias(name))
    return rows.join(found, "k", "left").withColumn(name, F.coalesce(name, "k"))


def links_of(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect the classes (k, d, n, sketch) as all similar pairs would. texts: k, text."""
    shards = 8 * int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = stage(inverted_lists(classes).join(classes.select("k", "d", "n"), "k"), "lists")
    nodes = stage(classes.join(lists.select("k").distinct(), "k", "left_semi").select("k", "d", "n", "sketch"), "nodes")
    texts = stage(texts.join(nodes.select("k"), "k", "left_semi"), "texts")
    fits = "100 * least(n, o) >= 75 * greatest(n, o)"

    # each class with the smallest of the list heads that it shares at least half as many lists with as with any
    heads = lists.groupBy("v").agg(F.min(F.struct("d", "k", "n")).alias("head")).select(
        "v", F.col("head.d").alias("hd"), F.col("head.k").alias("b"), F.col("head.n").alias("o"))
    shared = (lists.join(heads, "v").filter("k <> b").filter(fits).groupBy(F.col("k").alias("a"), "b", "hd")
              .agg(F.count(F.lit(1)).alias("c")))
    most = shared.groupBy("a").agg(F.max("c").alias("most"))
    best = (shared.join(most, "a").filter("2 * c >= most").groupBy("a")
            .agg(F.min(F.struct("hd", "b")).alias("best")).select("a", F.col("best.b").alias("b")))
    near = stage(estimated(best, nodes), "near")

    # the heads of families that meet in a list
    meeting = _grouped(lists, near.filter(F.col("est") >= ALIKE), "family").groupBy("v", "family").agg(
        F.min(F.struct("d", "k", "n")).alias("head"), F.count(F.lit(1)).alias("c"))
    main = meeting.groupBy("v").agg(F.max(F.struct("c", "family", "head")).alias("main"),
                                    F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    across = (meeting.join(main, "v").filter("family <> main.family")
              .select(F.col("head.k").alias("a"), F.col("main.head.k").alias("b"), F.col("head.n").alias("n"),
                      F.col("main.head.n").alias("o")).filter(fits).select("a", "b").distinct())
    near = stage(near.unionByName(estimated(across, nodes)), "near")
    links = stage(confirmed(near.filter(F.col("est") >= LIKELY).select("a", "b").distinct(), texts), "links")

    # within families, on the full sets
    members = stage(_grouped(_grouped(nodes.select("k"), near.filter(F.col("est") >= ALIKE), "family"), links, "label"), "members")
    mixed = members.groupBy("family").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("c"))
    mixed = mixed.filter("low <> high").select("family", F.ceil(F.col("c") / FAMILY_ROWS).cast("int").alias("blocks"))
    rows = members.join(mixed, "family").withColumn("block", F.pmod("k", "blocks").cast("int"))
    # a task for each two blocks; each row goes to the tasks of its block
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(texts, "k")
    inside = rows.groupBy("family", F.least("block", "other"), F.greatest("block", "other")).applyInArrow(
        _family_links, "a long, b long")
    links = stage(links.unionByName(inside), "links")

    # across families, in lists where several components still meet
    members = _grouped(members.drop("label"), links, "label")
    labelled = lists.select("v", "k", "n").join(members, "k")
    open_lists = labelled.groupBy("v").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                           F.min("family").alias("f1"), F.max("family").alias("f2"))
    open_lists = open_lists.filter("low <> high and f1 <> f2").select("v")
    rows = labelled.join(open_lists, "v", "left_semi").join(nodes.select("k", "sketch"), "k")
    shard = F.pmod("v", F.lit(shards)).alias("shard")
    pairs = rows.select("v", "k", "family", "label", "n", "sketch").groupBy(shard).applyInArrow(
        _list_pairs, "a long, b long").distinct()
    return stage(links.unionByName(confirmed(pairs, texts)), "links")


def _members(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (row, k, d), and for every k of them: n, rows with it, and of its component the smallest id `c` and the `head`."""
    keyed = pack(docs).withColumns({"k": row_key(), "d": order_key()})
    sets = stage(map_texts(keyed.select(F.struct("row.doc_id", "row.text", "k", "d").alias("row")), _sets, [
        ("n", T.LongType()), ("g1", T.LongType()), ("g2", T.LongType()), ("sketch", T.ArrayType(T.LongType()))])
        .select("row.k", "row.d", "n", "g1", "g2", "sketch"), "sets")
    classes = stage(sets.filter("n > 0").groupBy("g1", "g2").agg(
        F.min(F.struct("d", "k")).alias("head"), F.min(F.struct("n", "sketch")).alias("set")).select(
        "g1", "g2", "head.d", "head.k", "set.n", "set.sketch"), "classes")
    texts = keyed.select("k", F.col("row.text").alias("text")).dropDuplicates(["k"])
    labelled = _grouped(classes.select("g1", "g2", "k", "d"), links_of(classes, texts), "label")
    heads = labelled.groupBy("label").agg(F.min("d").alias("c"), F.min(F.struct("d", "k")).alias("least"))
    found = labelled.join(heads, "label").select("g1", "g2", "c", F.col("least.k").alias("head"))
    counted = sets.groupBy("k", "n", "g1", "g2").agg(F.count(F.lit(1)).alias("rows"))
    return keyed, counted.join(found, ["g1", "g2"], "left").select("k", "n", "rows", "c", "head")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """`row` (all columns of docs), n_shingles, component_id, kept."""
    keyed, members = _members(docs)
    own = F.coalesce("c", "d")
    return keyed.join(members.select("k", "n", "c"), "k").select(
        "row", F.col("n").alias("n_shingles"),
        F.when(own != F.lit(-(1 << 63)).cast("long"), own).alias("component_id"), (own == F.col("d")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs with one row of each component: of the smallest id, also where rows repeat or have no id.

    Of rows with one id and text the smallest stays. Rows with an empty set all stay.
    """
    keyed, members = _members(docs)
    stay = members.filter(F.col("head").isNull() | (F.col("k") == F.col("head"))).select(
        "k", (F.col("head").isNotNull() & (F.col("rows") > 1)).alias("many"))
    rows = keyed.select("row", "k").join(stay, "k")
    return rows.filter(~F.col("many")).select("row.*").unionByName(
        rows.filter("many").groupBy("k").agg(F.min("row").alias("row")).select("row.*"))

"""Nearest neighbours within a class, synthetic minority rows, splits by hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conductrisk.operators.ordered import hash_position, split
from conductrisk.session import stage

#: Bytes of the centres that every task gets, rings of a cell, rows of a block.
CENTRE_BYTES, RINGS, BLOCK_ROWS = 16_000_000, 64, 2_000
#: Bytes of the vectors of a shard, and of the questions that meet it in one task.
SHARD_BYTES = 16_000_000
#: Distances that are held at once.
_HELD = 4_000_000


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two double arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def _rough(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances by one matrix product, a bound of their rounding errors per row of a)."""
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    return np.maximum(aa[:, None] + bb[None] - 2 * (a @ b.T), 0), 1e-12 * (1 + a.shape[1]) * (aa + bb.max(initial=0.0))


def _closest(ids: np.ndarray, vecs: np.ndarray, member_ids: np.ndarray, members: np.ndarray, k: int,
             reach: np.ndarray | None = None, apart: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, neighbour, distance) of the k closest members of each point within its reach, itself excluded, ties by id.

    `apart` (a number of each point and of each member) excludes the members of the same number, too. Matrix products tell which members can be among the closest; the distances of those are computed from the differences.
    """
    parts = []
    step = max(1, _HELD // max(1, len(members)))
    for at in range(0, len(ids), step):
        own, x = ids[at:at + step], vecs[at:at + step]
        d, error = _rough(x, members)
        d[own[:, None] == member_ids[None]] = np.inf
        if apart is not None:
            d[apart[0][at:at + step, None] == apart[1][None]] = np.inf
        bound = np.partition(d, k - 1, axis=1)[:, k - 1] + 2 * error if d.shape[1] >= k else np.full(len(d), np.inf)
        if reach is not None:
            bound = np.minimum(bound, reach[at:at + step] ** 2 + 2 * error)
        i, j = np.nonzero((d <= bound[:, None]) & np.isfinite(d))
        exact = np.sqrt(((x[i] - members[j]) ** 2).sum(axis=1))
        order = np.lexsort((member_ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)  # i is ascending
        keep = nth < k
        parts.append((own[i[keep]], member_ids[j[keep]], exact[keep]))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return tuple(np.concatenate(x) for x in zip(none, *parts))


def _matrix(vec: pa.Array) -> np.ndarray:
    vec = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
    return vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1) if len(vec) else np.zeros((0, 0))


_FOUND = {"id": pa.int64(), "neighbour": pa.int64(), "distance": pa.float64()}
_OUT = "id long, neighbour long, distance double"


def _centres(heads: DataFrame, block_rows: int, budget: int) -> dict:
    """{label: matrix of about sqrt(n) of its rows}, for labels of more than a block, the largest first, within `budget` bytes."""
    sizes = heads.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).filter(F.col("n") > block_rows)
    wanted, left = [], budget
    for r in sizes.orderBy(F.desc("n"), "label").limit(budget // 64).collect():
        c = min(int(np.ceil(np.sqrt(r["n"]))), left // max(1, 8 * r["d"]))
        if c >= 2:
            wanted.append((r["label"], c, 4.0 * c / r["n"]))
            left -= 8 * r["d"] * c
    if not wanted:
        return {}
    table = heads.sparkSession.createDataFrame(wanted, T.StructType([
        heads.schema["label"], T.StructField("wanted", T.IntegerType()), T.StructField("share", T.DoubleType())]))
    at = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    drawn = heads.join(F.broadcast(table), "label").withColumn("at", at).filter("at < share").withColumn(
        "rn", F.row_number().over(Window.partitionBy("label").orderBy("at", "id"))).filter("rn <= wanted")
    out: dict = {}
    for r in drawn.select("label", "vec").collect():  # at most `budget` bytes
        out.setdefault(r["label"], []).append(r["vec"])
    return {label: np.array(v, float) for label, v in out.items()}


def _placed(heads: DataFrame, centres: dict, block_rows: int) -> DataFrame:
    """Rows with their block: cell (nearest centre, or a hash below 0 without centres), d0 (distance to it), ring and part."""
    shared = heads.sparkSession.sparkContext.broadcast(centres)
    names = heads.columns

    def nearest(batches):
        for batch in batches:
            labels, cell, d0 = batch.column("label").to_pylist(), np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, np.nan)
            for label in set(labels) & set(shared.value):
                at, c = np.array([i for i, x in enumerate(labels) if x == label]), shared.value[label]
                x, step = _matrix(batch.column("vec").take(pa.array(at))), max(1, _HELD // len(c))
                for i in range(0, len(at), step):
                    own = x[i:i + step]
                    near = _rough(own, c)[0].argmin(axis=1)
                    cell[at[i:i + step]], d0[at[i:i + step]] = near, np.sqrt(((own - c[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(d0, from_pandas=True)], [*names, "cell", "d0"])

    schema = T.StructType([*heads.schema.fields, T.StructField("cell", T.LongType()), T.StructField("d0", T.DoubleType())])
    near = heads.mapInArrow(nearest, schema)
    of_label = heads.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("spread"))
    by_cell = stage(near.join(of_label, "label").withColumn("cell", F.when(F.col("d0").isNull(), -1 - F.pmod(
        F.xxhash64("id"), F.col("spread"))).otherwise(F.col("cell"))), "cells")
    cells = by_cell.groupBy("label", "cell").agg(
        F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("wanted"),
        F.percentile_approx("d0", [i / RINGS for i in range(1, RINGS)], 1_000).alias("steps"))
    fine = F.size(F.filter("steps", lambda x: x < F.col("d0")))
    rings = F.least(F.lit(RINGS), F.col("wanted"))
    return stage(by_cell.join(cells, ["label", "cell"]).withColumns({
        "ring": F.when(F.col("d0").isNull(), 0).otherwise(F.floor(fine * rings / RINGS)).cast("int"),
        "part": F.when(F.col("d0").isNull(), 0).otherwise(
            F.pmod(F.xxhash64("id"), F.ceil(F.col("wanted") / RINGS))).cast("int")}).drop("steps", "wanted"), "placed")


_BLOCK = ["label", "cell", "ring", "part"]


def _shards(placed: DataFrame, shard_bytes: int) -> tuple[dict, DataFrame]:
    """({label: its blocks by cell, ring and part}, the blocks as a table), for labels of more than one block.

    A shard is a run of blocks of one label with about `shard_bytes` of vectors. The driver gets one row per block: at most
    the number of centres plus two per `block_rows` rows.
    """
    many = placed.filter("spread > 1").groupBy(*_BLOCK).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d"), F.min("d0").alias("lo"), F.max("d0").alias("hi"))
    of_label: dict = {}
    for r in many.collect():
        of_label.setdefault(r["label"], []).append(r)
    known, rows, shard = {}, [], 0
    for label, blocks in of_label.items():
        blocks.sort(key=lambda r: (r["cell"], r["ring"], r["part"]))
        first, shards, held = len(rows), [], 0
        for i, r in enumerate(blocks):
            size = 8 * r["d"] * r["n"]
            if held and held + size > shard_bytes:
                shard, held = shard + 1, 0
            held += size
            shards.append(shard)
            rows.append((label, r["cell"], r["ring"], r["part"], first + i, shard))
        shard += 1
        known[label] = {"first": first, "shard": np.array(shards), "cell": np.array([r["cell"] for r in blocks]),
                        "lo": np.array([r["lo"] for r in blocks], float), "hi": np.array([r["hi"] for r in blocks], float)}
    fields = [*[placed.schema[c] for c in _BLOCK], T.StructField("block", T.LongType()), T.StructField("shard", T.LongType())]
    return known, placed.sparkSession.createDataFrame(rows, T.StructType(fields))


def _in_reach(x: np.ndarray, reach: np.ndarray, blocks: dict, c: np.ndarray | None, home: np.ndarray) -> np.ndarray:
    """rows x blocks: can the block hold a row within the row's reach? The home block is left out.

    A cell is skipped if its border is further than the reach ((d(q, its centre) - d(q, own centre)) / 2), a ring if the
    triangle inequality keeps it out.
    """
    out = np.ones((len(x), len(blocks["cell"])), bool)
    if c is not None:
        step = max(1, _HELD // max(len(c), out.shape[1]))
        for i in range(0, len(x), step):
            d, error = _rough(x[i:i + step], c)
            d, r = np.sqrt(d), reach[i:i + step, None]
            seen = (d - d.min(axis=1, keepdims=True)) / 2 <= r + np.sqrt(error)[:, None]
            dq = d[:, blocks["cell"]]
            room = r * (1 + 1e-9) + 1e-6 * (1 + dq)
            out[i:i + step] = seen[:, blocks["cell"]] & (blocks["lo"] <= dq + room) & (blocks["hi"] >= dq - room)
    out[np.arange(len(x)), home - blocks["first"]] = False
    return out


def _asked(placed: DataFrame, reach: DataFrame, known, shared, numbered: DataFrame) -> DataFrame:
    """The other blocks that can hold a row within a row's reach: block, its shard, id, home, reach."""
    rows = placed.join(reach, "id", "left").select(
        "label", "id", "vec", F.col("block").alias("home"), F.coalesce("reach", F.lit(float("inf"))).alias("reach"))

    def route(batches):
        for batch in batches:
            labels, found = batch.column("label").to_pylist(), [None] * batch.num_rows
            home, reach = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("home", "reach"))
            for label in set(labels):
                at, blocks = np.array([i for i, x in enumerate(labels) if x == label]), known.value[label]
                step = max(1, _HELD // len(blocks["cell"]))
                for i in range(0, len(at), step):
                    own = at[i:i + step]
                    ask = _in_reach(_matrix(batch.column("vec").take(pa.array(own))), reach[own], blocks, shared.value.get(label), home[own])
                    for row, keep in zip(own, ask, strict=True):
                        found[row] = np.flatnonzero(keep) + blocks["first"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "home", "reach")), pa.array(found, pa.list_(pa.int64()))], ["id", "home", "reach", "blocks"])

    routed = rows.mapInArrow(route, "id long, home long, reach double, blocks array<long>")
    return routed.select("id", "home", "reach", F.explode("blocks").alias("block")).join(F.broadcast(numbered), "block").select(
        *_BLOCK, "shard", "id", "home", "reach")


def _outside(placed: DataFrame, reach: DataFrame, centres: dict, k: int, shard_bytes: int) -> DataFrame | None:
    """The k nearest rows of each row in each shard, without its own block: id, neighbour, distance. None without other blocks."""
    blocks, numbered = _shards(placed, shard_bytes)
    if not blocks:
        return None
    placed = placed.join(F.broadcast(numbered), _BLOCK)
    context = placed.sparkSession.sparkContext
    known, shared = context.broadcast(blocks), context.broadcast(centres)
    # all blocks of a row are made in one task, so hardly more than these rows is shuffled
    asked = stage(_asked(placed, reach, known, shared, numbered).select("shard", "id", "home", "reach").distinct(), "asked")
    per_row = placed.agg(8 * F.max(F.size("vec"))).first()[0]
    batches = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) * per_row / shard_bytes).cast("int").alias("batches"))
    vecs = placed.select("label", "id", F.col("block").alias("home"), "vec")
    questions = asked.join(F.broadcast(batches), "shard").withColumn(
        "batch", F.pmod(F.xxhash64("id"), F.col("batches")).cast("int")).drop("batches").join(vecs, ["id", "home"])
    members = placed.join(F.broadcast(batches), "shard").select(
        F.col("shard").alias("m_shard"), F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("m_batch"),
        F.col("block").alias("m_block"), F.col("id").alias("m_id"), F.col("vec").alias("m_vec"))

    def answer(key: tuple, q: pa.Table, m: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(q) and len(m):
            ids, x, home, far = q.column("id").to_numpy(), _matrix(q.column("vec")), q.column("home").to_numpy(), q.column("reach").to_numpy()
            m_ids, members, m_block = m.column("m_id").to_numpy(), _matrix(m.column("m_vec")), m.column("m_block").to_numpy()
            label = q.column("label")[0].as_py()
            own = known.value[label]
            here = np.flatnonzero(own["shard"] == key[0].as_py())
            step = max(1, _HELD // len(own["cell"]))
            ask = np.concatenate([_in_reach(x[i:i + step], far[i:i + step], own, shared.value.get(label), home[i:i + step])[:, here]
                                  for i in range(0, len(x), step)])
            if ask.mean() > 0.3:  # one product for all blocks is cheaper
                found.append(_closest(ids, x, m_ids, members, k, far, (home, m_block)))
            else:
                for j, block in enumerate(here + own["first"]):
                    rows, mine = np.flatnonzero(ask[:, j]), m_block == block
                    if len(rows):
                        found.append(_closest(ids[rows], x[rows], m_ids[mine], members[mine], k, far[rows]))
        near = [np.concatenate(c) for c in zip(*found, strict=True)]
        order = np.lexsort((near[1], near[2], near[0]))
        near = [c[order] for c in near]
        keep = np.arange(len(order)) - np.searchsorted(near[0], near[0]) < k
        return pa.table({n: c[keep] for n, c in zip(_FOUND, near, strict=True)}, schema=pa.schema(_FOUND))

    return questions.groupBy("shard", "batch").cogroup(members.groupBy("m_shard", "m_batch")).applyInArrow(answer, _OUT)


def nearest_in_class(points: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, budget: int = CENTRE_BYTES,
                     shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Exact k nearest rows of the same class: (label, id, neighbour, distance, nth).

    Input: label, id (long), vec (array<double>). Copies of one vector are reduced to k + 1 rows
    first: nobody needs more of them, and further copies take their neighbours from those rows.
    The rest goes to the nearest of about sqrt(n) centres per class; cells are cut into rings around their centre and
    these into blocks of about `block_rows`. A row's k-th distance inside its own block bounds the other blocks it has to look
    at. Blocks travel together in shards of about `shard_bytes`: a row goes once to a shard, whatever the number of its blocks in
    reach, and gets k rows back, never all pairs.
    """
    points = points.withColumn("vkey", F.xxhash64("vec"))
    copies = Window.partitionBy("label", "vkey", "vec").orderBy("id")
    heads = stage(points.withColumn("nth_copy", F.row_number().over(copies)).filter(F.col("nth_copy") <= k + 1).drop("nth_copy")
                  .select("label", "id", "vkey", "vec"), "heads")
    centres = _centres(heads, block_rows, budget)
    placed = _placed(heads, centres, block_rows)

    def within(group: pa.Table) -> pa.Table:
        ids, x = group.column("id").to_numpy(), _matrix(group.column("vec"))
        return pa.table(dict(zip(_FOUND, _closest(ids, x, ids, x, k))), schema=pa.schema(_FOUND))

    inside = stage(placed.select(*_BLOCK, "id", "vec").groupBy(*_BLOCK).applyInArrow(within, _OUT), "inside")
    reach = inside.groupBy("id").agg(F.count(F.lit(1)).alias("found"), F.max("distance").alias("r")).filter(
        F.col("found") >= k).select("id", F.col("r").alias("reach"))
    outside = _outside(placed, reach, centres, k, shard_bytes)
    found = inside if outside is None else inside.unionByName(outside)
    best = F.slice(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))), 1, k)
    listed = found.groupBy("id").agg(best.alias("best"))
    of_heads = heads.join(listed, "id", "left")
    # further copies: the k first copies, at distance 0
    first = of_heads.groupBy("label", "vkey", "vec").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k).alias("firsts"))
    further = points.join(heads.select("label", "id"), ["label", "id"], "left_anti").join(
        first, ["label", "vkey", "vec"]).select("label", "id", F.transform("firsts", lambda i: F.struct(
            F.lit(0.0).alias("distance"), i.alias("neighbour"))).alias("best"))
    return of_heads.select("label", "id", "best").unionByName(further).select(
        "label", "id", F.posexplode("best").alias("nth", "b")).select(
        "label", "id", (F.col("nth") + 1).alias("nth"), "b.neighbour", "b.distance")


def _number(*parts) -> Column:
    """A reproducible number in [0, 2^32) from a key."""
    text = F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("bigint")


def rows_needed(rows: DataFrame, label: str, ratio: float) -> Column:
    """How many minority rows are missing for the target share."""
    counts = rows.agg(F.struct(F.count_if(F.col(label) == 0).alias("a"), F.count_if(F.col(label) == 1).alias("b")).alias("s")).scalar()
    return F.greatest(F.lit(0).cast("bigint"), F.floor(counts["a"] * (ratio / (1 - ratio)) + 1e-9).cast("bigint") - counts["b"])


def synthetic_minority(minority: DataFrame, wanted: Column, k: int = 5) -> DataFrame:
    """`wanted` synthetic rows between minority rows and one of their k nearest rows.

    Every row starts equally many samples; neighbour and gap come from the sample number's hash.
    Output: sample, base, neighbour, gap, vec.
    """
    base = minority.select(F.lit(1).alias("label"), "id", "vec")
    near = nearest_in_class(base, k).groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("nth", "neighbour"))).alias("near"))
    placed = hash_position(base.select("id", "vec"), "id")
    n = minority.agg(F.count("*").alias("n")).scalar()
    rounds = placed.join(near, "id").withColumns({"__n": n, "__wanted": wanted}).filter(
        F.col("position") <= F.col("__wanted"))
    samples = rounds.select(
        "id", "vec", "near", F.explode(F.sequence(
            F.col("position"), F.col("__wanted"), F.col("__n"))).alias("sample"))
    chosen = F.element_at("near", (F.pmod(_number("near", F.col("sample")), F.size("near")) + 1).cast("int"))["neighbour"]
    gap = _number("gap", F.col("sample")) / F.lit(4294967296.0)
    drawn = samples.select("sample", F.col("id").alias("base"), "vec", chosen.alias("neighbour"), gap.alias("gap"))
    other = minority.select(F.col("id").alias("neighbour"), F.col("vec").alias("other"))
    return drawn.join(other, "neighbour").select(
        "sample", "base", "neighbour", "gap",
        F.zip_with("vec", "other", lambda a, b: a + F.col("gap") * (b - a)).alias("vec"))


def balanced(rows: DataFrame, ratio: float = 0.3, k: int = 5) -> DataFrame:
    """Original rows (id, label, vec) plus the synthetic minority rows that reach the share."""
    minority = rows.filter("label = 1").select("id", "vec")
    made = synthetic_minority(minority, rows_needed(rows, "label", ratio), k)
    return rows.select("id", "label", "vec", F.lit(False).alias("is_synthetic")).unionByName(
        made.select((-F.col("sample")).alias("id"), F.lit(1).alias("label"), "vec", F.lit(True).alias("is_synthetic")))


def stratified_split(rows: DataFrame, key: str, label: str, share: float = 0.8) -> DataFrame:
    """Add `in_train`: exactly the share of every label, by key hash."""
    return split(rows, key, share, [label]).withColumnRenamed("in_first", "in_train")


def user_split(rows: DataFrame, test_user: str, share: float = 0.8) -> DataFrame:
    """Add `in_train` by user; the labelled user always is in the test part."""
    users = split(rows.select("user").distinct(), "user", share).select(
        "user", (F.col("in_first") & (F.col("user") != test_user)).alias("in_train"))
    return rows.join(users, "user")

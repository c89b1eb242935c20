"""Approximate nearest neighbours: vantage-point trees per shard, with pruning relaxed by a factor.

A small tree over a bounded sample (`ROUTER_BYTES`) cuts space into cells; every row goes to its cell, and cells with many
rows are dealt to shards of about `SHARD_BYTES` by a hash of the id, so a dense region or a vector that a third of all rows
have is spread over many shards. Each shard builds a tree of its rows and answers the queries among them; the distance of
a query's k-th answer bounds what it asks of other shards, which are found by walking the router with the same pruning.
Queries meet a shard in blocks. Factor 1 makes all pruning the triangle inequality, so the search is exact; the
larger the factor, the more cells and branches are skipped.

Null vectors, zero vectors, and vectors with null or non-finite components take no part, nor do rows without an id. A row
that is repeated counts once; of different vectors with one id the smallest counts (components in order). Vectors are compared
with those of their own length; the router is fitted on the most common length, and vectors of another length are in a cell of
their own. Ties go to the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conductrisk.llm.rows import broadcast
from conductrisk.llm.vptree import VPTree
from conductrisk.session import stage

#: Pruning factor (1: exact).
FACTOR = 4.0
#: Bytes of a shard's vectors, of the sample that the router is fitted on, and queries of a block.
SHARD_BYTES, ROUTER_BYTES, QUERY_BLOCK = 4_000_000, 8_000_000, 1024
#: Rows of the sample for each cell, most cells.
_CELL_ROWS, _CELLS = 16, 4096
_OTHER = -1  # the cell of vectors of another length


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """id, vec (doubles): one row per id."""
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).filter(
        F.col("id").isNotNull() & usable(F.col("vec")))
    again = rows.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("id")
    if again.isEmpty():  # ids alone are small; only ids that repeat need their vectors shuffled
        return rows
    return rows.join(again, "id", "left_anti").unionByName(
        rows.join(again, "id", "left_semi").groupBy("id").agg(F.min("vec").alias("vec")))


def _matrix(vec: pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    vec = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
    flat = vec.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vec), -1) if len(vec) else np.zeros((0, 0))


class Router:
    """Cells of space: the leaves of a tree over a sample. A vector can be asked for its cell, or for all cells in reach."""

    def __init__(self, tree: VPTree, size: int):
        self.tree, self.size = tree, size

    @classmethod
    def fit(cls, rows: DataFrame, shard_rows: int, count: int, size: int) -> "Router":
        most = max(1, ROUTER_BYTES // (8 * size))
        cells = min(_CELLS, most // _CELL_ROWS, -(-count // shard_rows))
        sample = rows.filter(F.size("vec") == size).orderBy(F.xxhash64("id"), "id").limit(max(1, min(most, cells * _CELL_ROWS)))
        found = sample.select("vec").collect()
        return cls(VPTree.build(np.array([x["vec"] for x in found], float), _CELL_ROWS if cells > 1 else len(found)), size)

    def cells(self, vec: pa.Array) -> np.ndarray:
        mine = _lengths(vec) == self.size
        out = np.full(len(vec), _OTHER)
        if mine.any():
            out[mine] = self.tree.leaf_of(_matrix(vec.filter(pa.array(mine))))
        return out

    def in_reach(self, vec: pa.Array, reach: np.ndarray) -> list[list[int]]:
        mine = np.flatnonzero(_lengths(vec) == self.size)
        out: list[list[int]] = [[_OTHER] for _ in range(len(vec))]
        for i in mine:
            out[i] = []
        if len(mine):
            self.tree.visit(_matrix(vec.take(pa.array(mine))), lambda who: reach[mine[who]],
                            lambda node, who: [out[i].append(int(node)) for i in mine[who]])
        return out


def _lengths(vec: pa.Array) -> np.ndarray:
    return np.array(pa.compute.list_value_length(vec).to_numpy(zero_copy_only=False), np.int64)


def _by_length(vec: pa.Array):
    """(positions, matrix) for each length."""
    size = _lengths(vec)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield int(n), at, _matrix(vec.take(pa.array(at)))


_ANSWER = "query_id long, vec array<double>, reach double, id long, score double"


def _answers(query_ids, vecs, found_i, found_d, reach) -> pa.Table:
    """A row per answer; a query without any has one row with nulls."""
    n, k = found_d.shape
    real = np.isfinite(found_d)
    real[:, 0] |= ~real.any(axis=1)
    who = np.repeat(np.arange(n), k).reshape(n, k)[real]
    none = pa.array(~np.isfinite(found_d[real]))
    return pa.table({
        "query_id": pa.array(query_ids[who], pa.int64()), "vec": vecs.take(pa.array(who)), "reach": pa.array(reach[who], pa.float64()),
        "id": pa.compute.if_else(none, pa.scalar(None, pa.int64()), pa.array(found_i[real], pa.int64())),
        "score": pa.compute.if_else(none, pa.scalar(None, pa.float64()), pa.array(found_d[real], pa.float64())),
    })


def nearest(table: DataFrame, asks: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10,
            factor: float = FACTOR, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """query_id, rank, id, score: the k nearest rows found for each row of `table` where `asks` (of column `id`) holds."""
    spark = table.sparkSession
    if factor < 1:
        raise ValueError("a factor below 1 would skip nothing more than factor 1")
    rows = stage(vectors(table, key, vector), "vectors")
    sizes = rows.groupBy(F.size("vec").alias("size")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("size")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    shard_rows = max(1, shard_bytes // (8 * sizes["size"]))
    router = broadcast(spark, Router.fit(rows, shard_rows, sizes["c"], sizes["size"]))

    def cells(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(router.value.cells(batch.column("vec")), pa.int32())],
                                             [*batch.schema.names, "cell"])

    celled = stage(rows.mapInArrow(cells, "id long, vec array<double>, cell int"), "cells")
    # a row per cell: at most _CELLS + 1
    parts = celled.groupBy("cell").agg(F.ceil(F.sum(F.size("vec") * F.lit(8)) / shard_bytes).cast("int").alias("parts"))
    placed = celled.join(F.broadcast(parts), "cell").withColumns(
        {"part": F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), "asks": F.coalesce(asks, F.lit(False))})

    def home(group: pa.Table) -> pa.Table:
        """The trees of a shard (one per length of vectors), and the answers to its own queries."""
        group = group.sort_by("id").combine_chunks()
        out, vec, id_, asking = [], group.column("vec").combine_chunks(), group.column("id").to_numpy(), group.column("asks").to_numpy()
        place = {c: group.column(c)[0].as_py() for c in ("cell", "part")}
        for size, at, matrix in _by_length(vec):
            tree = VPTree.build(matrix)
            out.append(_shaped(place, size, tree=pa.array([tree.to_bytes()], pa.binary()), ids=pa.array([id_[at]], pa.list_(pa.int64()))))
            mine = np.flatnonzero(asking[at])
            if len(mine):
                found = tree.nearest(matrix[mine], id_[at], id_[at][mine], k, np.full(len(mine), np.inf), factor)
                out.append(_shaped(place, size, **_columns(_answers(id_[at][mine], vec.take(pa.array(at[mine])), *found, found[1][:, -1]))))
        return pa.concat_tables(out)

    built = stage(placed.groupBy("cell", "part").applyInArrow(home, _SHAPE), "trees")
    trees = built.filter("tree is not null").select("cell", "part", "size", "tree", "ids")
    own = built.filter("query_id is not null")

    def routed(batches):
        for batch in batches:
            reach = batch.column("reach").to_numpy(zero_copy_only=False)
            found = router.value.in_reach(batch.column("vec"), reach / factor + 1e-12)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    queries = own.groupBy("query_id").agg(*[F.first(c).alias(c) for c in ("cell", "part", "size", "reach", "vec")]).select(
        F.col("cell").alias("home"), F.col("part").alias("home_part"), "size", "query_id", "reach", "vec")
    shards = trees.select("cell", "part", "size")
    asked = stage(
        queries.mapInArrow(routed, "home int, home_part int, size int, query_id long, reach double, vec array<double>, cells array<int>")
        .withColumn("cell", F.explode("cells")).join(shards, ["cell", "size"])
        .filter(~((F.col("cell") == F.col("home")) & (F.col("part") == F.col("home_part"))))
        .select("cell", "part", "size", "query_id", "reach", "vec"), "asked")
    blocks = asked.groupBy("cell", "part", "size").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
    dealt = asked.join(blocks, ["cell", "part", "size"]).withColumn(
        "block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
    lent = trees.join(blocks, ["cell", "part", "size"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def search(key: tuple, asked: pa.Table, lent: pa.Table) -> pa.Table:
        if not len(asked) or not len(lent):
            return pa.table({c: pa.array([], t) for c, t in _ARROW.items()})
        tree, ids = VPTree.from_bytes(lent.column("tree")[0].as_py()), np.array(lent.column("ids")[0].as_py(), np.int64)
        who, reach = asked.column("query_id").to_numpy(), asked.column("reach").to_numpy()
        found = tree.nearest(_matrix(asked.column("vec")), ids, who, k, reach, factor)
        return _answers(who, asked.column("vec").combine_chunks(), *found, reach)

    names = ["cell", "part", "size", "block"]
    others = dealt.groupBy(*names).cogroup(lent.groupBy(*names)).applyInArrow(search, _ANSWER)
    answers = own.select("query_id", "id", "score").unionByName(others.select("query_id", "id", "score")).filter("id is not null")
    nearest_first = Window.partitionBy("query_id").orderBy("score", "id")
    return answers.withColumn("rank", F.row_number().over(nearest_first)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score")


_ARROW = {"query_id": pa.int64(), "vec": pa.list_(pa.float64()), "reach": pa.float64(), "id": pa.int64(), "score": pa.float64()}
_SHAPE = f"cell int, part int, size int, tree binary, ids array<long>, {_ANSWER}"
_TYPES = {"cell": pa.int32(), "part": pa.int32(), "size": pa.int32(), "tree": pa.binary(), "ids": pa.list_(pa.int64()), **_ARROW}


def _columns(table: pa.Table) -> dict:
    return {c: table.column(c) for c in table.column_names}


def _shaped(place: dict, size: int, **columns) -> pa.Table:
    """A table of all columns of a shard's output; the ones that are not given are null."""
    n = len(next(iter(columns.values())))
    fixed = {"cell": pa.array([place["cell"]] * n), "part": pa.array([place["part"]] * n), "size": pa.array([size] * n)}
    every = {**fixed, **columns}
    return pa.table({c: every[c].cast(t) if c in every else pa.nulls(n, t) for c, t in _TYPES.items()})

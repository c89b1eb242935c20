"""Exact attributions of tree ensembles from the paths of their leaves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conductrisk.session import fresh_path

#: Flags that the open paths of a block of rows may hold.
BLOCK_FLAGS = 1 << 24


def stored_trees(model) -> list[dict[str, np.ndarray]]:
    """The trees of a fitted forest as arrays per node: feature, threshold, left, right, value.

    `value` is the share of the positive class. There are at most trees x 2^(depth + 1) nodes, whatever the table's size.
    """
    spark = SparkSession.getActiveSession()
    path = fresh_path(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.get("nodeData.impurityStats", F.lit(1)).alias("ones"),
        F.aggregate("nodeData.impurityStats", F.lit(0.0), lambda a, b: a + b).alias("all")).toPandas()
    trees = []
    for _, part in nodes.sort_values(["treeID", "id"]).groupby("treeID"):
        trees.append({
            "feature": part["featureIndex"].to_numpy(), "threshold": part["threshold"].fillna(0.0).to_numpy(),
            "left": part["leftChild"].to_numpy(), "right": part["rightChild"].to_numpy(),
            "value": (part["ones"] / part["all"].where(part["all"] > 0, 1.0)).to_numpy()})
    return trees


def leaf_weights(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shapley weights of a leaf that needs a features of the row and b of the mean row: [a, b] for either kind."""
    own, other = np.zeros((n + 1, n + 1)), np.zeros((n + 1, n + 1))
    for a in range(n + 1):
        for b in range(n + 1 - a):
            if a:
                own[a, b] = math.factorial(a - 1) * math.factorial(b) / math.factorial(a + b)
            if b:
                other[a, b] = math.factorial(a) * math.factorial(b - 1) / math.factorial(a + b)
    return own, other


def explain(x: np.ndarray, mean: np.ndarray, trees: list[dict[str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(attributions, predictions) of a block of rows.

    A row and the mean row go down a tree together. Where they part, the leaves on the row's side need the feature in the
    coalition and those on the other side need it out; a feature that is settled stays so. A leaf that is reached with a features
    needed in and b needed out adds its value to a coalition exactly if these agree, which has Shapley values in closed form.
    """
    rows, n = x.shape
    phi, predicted = np.zeros((rows, n)), np.zeros(rows)
    own, other = leaf_weights(n)
    for tree in trees:
        row, node = np.arange(rows), np.zeros(rows, dtype=np.int64)
        inside, outside = np.zeros((rows, n), dtype=bool), np.zeros((rows, n), dtype=bool)
        while len(row):
            leaf = tree["left"][node] < 0
            if leaf.any():
                a, b, value = inside[leaf].sum(1), outside[leaf].sum(1), tree["value"][node[leaf]]
                share = inside[leaf] * (value * own[a, b])[:, None] - outside[leaf] * (value * other[a, b])[:, None]
                for f in range(n):
                    phi[:, f] += np.bincount(row[leaf], weights=share[:, f], minlength=rows)
                predicted += np.bincount(row[leaf], weights=np.where(b == 0, value, 0.0), minlength=rows)
                row, node, inside, outside = row[~leaf], node[~leaf], inside[~leaf], outside[~leaf]
            f, cut, at = tree["feature"][node], tree["threshold"][node], np.arange(len(row))
            mine, theirs = x[row, f] <= cut, mean[f] <= cut
            apart = mine != theirs
            go, stay = ~apart | ~outside[at, f], apart & ~inside[at, f]
            child = lambda left, pick: np.where(left, tree["left"][node], tree["right"][node])[pick]
            needed, barred = inside[go], outside[stay]
            needed[np.arange(len(needed)), f[go]] |= apart[go]
            barred[np.arange(len(barred)), f[stay]] = True
            row, node, inside, outside = (
                np.concatenate([row[go], row[stay]]), np.concatenate([child(mine, go), child(theirs, stay)]),
                np.concatenate([needed, inside[stay]]), np.concatenate([outside[go], barred]))
    return phi / len(trees), predicted / len(trees)


def forest_attributions(model, df: DataFrame, features: list[str], key: list[str]) -> DataFrame:
    """Exact Shapley values of the positive probability against the mean row: key.., phi_<feature>.., probability_1, base_probability.

    A row costs at most one visit of every leaf and no copies; nothing is shuffled but the means. The values of a row add up to its
    probability minus that of the mean row. Missing values count as 0, as they do for the model.
    """
    trees = stored_trees(model)
    value = lambda f: F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    means = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features]).first()
    mean = np.array([0.0 if m is None else m for m in means], dtype=float)
    base = float(explain(mean[None, :], mean, trees)[1][0])
    leaves = max(int((t["left"] < 0).sum()) for t in trees)
    step = max(1, BLOCK_FLAGS // (2 * leaves * len(features)))
    names = [f"phi_{f}" for f in features] + ["probability_1", "base_probability"]

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                x = np.column_stack([part.column(len(key) + i).to_numpy(zero_copy_only=False) for i in range(len(mean))])
                phi, p = explain(x, mean, trees)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(key))] + [pa.array(phi[:, i]) for i in range(len(mean))]
                    + [pa.array(p), pa.array(np.full(len(p), base))], names=[*key, *names])

    rows = df.select(*key, *[value(f).alias(f"__x{i}") for i, f in enumerate(features)])
    schema = T.StructType([*df.select(*key).schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return rows.mapInArrow(work, schema)

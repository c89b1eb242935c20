"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conductrisk.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge (a, b); equal labels mean the same component.

    Every round maps each node to the smallest node next to it (or itself) and contracts the edges,
    until none is left; the maps are then applied one after the other. A round with n edges leaves
    fewer nodes, at most half of those that had an edge. Nulls and loops in `edges` are ignored.
    """
    left = stage(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).select(
            F.col("a").alias("node"), "to"), "near")
        maps.append(near)
        at = lambda side: near.select(F.col("node").alias(side), F.col("to").alias(f"{side}_to"))
        left = stage(left.join(at("a"), "a").join(at("b"), "b").filter("a_to <> b_to").select(
            F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct(), "edges")
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = maps[0].select("node", F.col("to").alias("label"))
    for near in maps[1:]:
        step = near.select(F.col("node").alias("label"), "to")
        labels = labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return stage(labels, "labels")

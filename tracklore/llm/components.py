"""Connected components of an edge table, by contraction: each step is written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its component. A kept table."""
    pairs = store.kept(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return contracted(pairs)


def contracted(pairs: DataFrame) -> DataFrame:
    """`components` of a kept table of distinct edges, which is freed.

    Every node is hooked to its smallest neighbour and hooks are followed to their ends by pointer jumping, which joins nodes
    with nodes. Only edges between different ends, at most half of the nodes, go on to the next round, so an edge inside what
    has been joined is never read again.
    """
    both = pairs.union(pairs.select("b", "a")).toDF("node", "next")
    top = store.kept(both.groupBy("node").agg(F.least("node", F.min("next")).alias("root")), "labels")
    moved = True
    while moved:
        above = top.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = store.kept(top.join(above, "root").select("node", F.col("above").alias("root"), (F.col("above") < F.col("root")).alias("moved")), "labels")
        store.free(top)
        top, moved = new, not new.where("moved").isEmpty()
    open_ = store.kept(between(pairs, top), "edges")
    store.free(pairs)
    if open_.isEmpty():
        store.free(open_)
        return top
    above = contracted(open_)
    out = merged(top, above)
    store.free(top, above)
    return out


def between(edges: DataFrame, root: DataFrame) -> DataFrame:
    """The edges (a, b) by the roots of their ends, once each and none inside a component; a node without a root is its own."""
    for end in "ab":
        of = root.select(F.col("node").alias(end), F.col("root").alias("_root"))
        edges = edges.join(of, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def merged(root: DataFrame, above: DataFrame) -> DataFrame:
    """(node, root) of the nodes of both, where `above` has the components of roots and of nodes without one. A kept table."""
    up = above.select(F.col("node").alias("root"), F.col("root").alias("_above"))
    old = root.select("node", "root").join(up, "root", "left").select("node", F.coalesce("_above", "root").alias("root"))
    new = above.select("node", "root").join(root.select("node"), "node", "left_anti")
    return store.kept(old.unionByName(new), "labels")


def extended(root: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) after more edges (a, b): only what they join is gone through again. A kept table."""
    above = contracted(store.kept(between(edges, root), "edges"))
    out = merged(root, above)
    store.free(above)
    return out

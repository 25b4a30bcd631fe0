"""Exact nearest items by a tree of pivot cells, for two sides of any size.

A distance is a weighted sum of Euclidean distances of parts, so the triangle inequality holds. Items are dealt to the
nearest of up to ``FAN`` pivots drawn from them, and a cell of more than ``CELL`` items is dealt again, level by
level. A query first walks to one leaf, which bounds its answer. What can be as near is then looked up pack by pack
(``packs``), in the order of the leaves; where all items within a bound are wanted, a query visits the cells whose ring of distances
around the pivot can hold one (``reached``), and is copied to them. Steps on the tree are equi-joins on the cell: a row meets at
most ``FAN`` pivots or ``CELL`` items at a time.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklore.functions import vectors as V
from tracklore.operators import packs
from tracklore.session import written

FAN, CELL = 64, 256
SLACK = 2e-9  # of a bound: distances are compared on nine places


@dataclass
class Tree:
    """nodes: for each level (cell, subs), subs with pivot, ring (lo, hi) and least and greatest label; leaves: (cell, members, path),
    path with the number of the sub-cell taken on each level."""

    columns: list[str]  # of queries and items
    parts: dict[str, float]  # their names in the tables of the tree, and weights
    nodes: list[DataFrame]
    leaves: DataFrame
    labelled: bool


def distance(parts: Mapping[str, float], a, b) -> Column:
    terms = [w * F.sqrt(V.squared_distance(a[c], b[c])) for c, w in parts.items()]
    return sum(terms[1:], terms[0])


class _Row:
    """Columns of the row itself, read like the fields of a struct."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


HERE = _Row()


def tree(items: DataFrame, key: str, parts: Mapping[str, float], label: str | None = None, fan: int = FAN, cell: int = CELL) -> Tree:
    """Tree of items (key, the columns of ``parts``, label). Of equal vectors only the least keys of two labels can be an answer,
    so two rows stand for all of them and every cell can be split."""
    columns, parts = list(parts), {f"v{i}": w for i, w in enumerate(parts.values())}
    vecs = list(parts)
    tag = F.col(label) if label else F.lit(0)
    given = items.select(F.col(key).alias("item"), tag.alias("tag"), *[F.col(c).alias(v) for c, v in zip(columns, vecs)])
    one = given.groupBy("tag", *vecs).agg(F.min("item").alias("item"))
    if label:
        first = one.groupBy(*vecs).agg(F.min_by("tag", "item").alias("_least"))
        some = one.alias("o").join(first.alias("f"), [F.col(f"o.{c}") == F.col(f"f.{c}") for c in vecs])
        other = some.where("tag <> _least").groupBy(*[F.col(f"o.{c}").alias(c) for c in vecs]).agg(F.min_by("tag", "item").alias("tag"), F.min("item").alias("item"))
        least = some.where("tag = _least").select("item", "tag", *[f"o.{c}" for c in vecs])
        one = least.unionByName(other)
    here = written(one.select("item", "tag", *vecs, F.lit(0).cast("long").alias("cell"), F.array().cast("array<int>").alias("path")))
    nodes, done, level = [], [], 0
    while True:
        heavy = written(here.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell).select("cell"))
        if heavy.isEmpty():
            done.append(here)
            break
        done.append(here.join(heavy, "cell", "left_anti"))
        crowd = here.join(heavy, "cell", "left_semi")
        name = F.xxhash64(F.lit(level), "item", "tag")
        drawn = crowd.groupBy("cell", F.pmod(name, F.lit(fan)).cast("int").alias("b")).agg(F.min_by(F.struct("tag", *vecs), name).alias("p"))
        drawn = written(drawn.select("cell", "b", "p.*"))
        fans = drawn.groupBy("cell").agg(F.collect_list(F.struct("b", *vecs)).alias("fan"))  # at most `fan`
        near = F.array_min(F.transform("fan", lambda p: F.struct(distance(parts, HERE, p).alias("d"), p["b"].alias("b"))))
        placed = crowd.join(fans, "cell").withColumn("_n", near)
        here = written(placed.select("item", "tag", *vecs, F.col("cell").alias("parent"), "_n.b", "_n.d", F.xxhash64("cell", "_n.b").alias("cell"),
                                     F.concat("path", F.array("_n.b")).alias("path")))
        rings = here.groupBy("parent", "b", "cell").agg(
            F.min("d").alias("lo"), F.max("d").alias("hi"), F.min("tag").alias("first"), F.max("tag").alias("last"))
        subs = rings.join(drawn.withColumnRenamed("cell", "parent"), ["parent", "b"])
        subs = subs.groupBy(F.col("parent").alias("cell")).agg(F.collect_list(F.struct(
            F.col("cell").alias("sub"), "lo", "hi", "first", "last", "tag", *vecs)).alias("subs"))
        nodes.append(written(subs))
        here = here.select("item", "tag", *vecs, "cell", "path")
        level += 1
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    leaves = written(rows.groupBy("cell").agg(F.collect_list(F.struct("item", "tag", *vecs)).alias("members"), F.first("path").alias("path")))  # at most `cell`
    return Tree(columns, parts, nodes, leaves, label is not None)


def _other(t: Tree, tag: Column) -> Column:
    return tag != F.col("tag") if t.labelled else F.lit(True)


def _open(t: Tree, s) -> Column:
    """A sub-cell that is not all of the query's own label."""
    return (s["first"] != F.col("tag")) | (s["last"] != F.col("tag")) if t.labelled else F.lit(True)


def asked(queries: DataFrame, t: Tree, key: str, label: str | None = None) -> DataFrame:
    tag = F.col(label) if label else F.lit(0)
    return queries.select(F.col(key).alias("query"), tag.alias("tag"), *[F.col(c).alias(v) for c, v in zip(t.columns, t.parts)])


def bounded(q: DataFrame, t: Tree) -> DataFrame:
    """Queries with ``bound``: the distance to some item that may answer, met on one way down the tree (infinite if none)."""
    return _walked(q, t).drop("path")


def _walked(q: DataFrame, t: Tree) -> DataFrame:
    """Queries with ``bound`` and the path of the leaf where they end."""
    q = q.withColumn("cell", F.lit(0).cast("long")).withColumn("bound", F.lit(float("inf")))
    names = q.columns
    for node in t.nodes:
        seen = F.transform("subs", lambda s: F.struct(distance(t.parts, HERE, s).alias("d"), s.alias("s")))
        j = q.join(node, "cell", "left").withColumn("_s", seen)
        way = F.array_min(F.transform(F.filter("_s", lambda x: _open(t, x["s"])), lambda x: F.struct(x["d"], x["s"]["sub"].alias("sub"))))
        near = F.array_min(F.transform(F.filter("_s", lambda x: _other(t, x["s"]["tag"])), lambda x: x["d"]))
        q = j.withColumn("bound", F.least("bound", near)).withColumn("cell", F.coalesce(way["sub"], F.col("cell"))).select(*names)
    here = F.array_min(F.transform(F.filter("members", lambda m: _other(t, m["tag"])), lambda m: distance(t.parts, HERE, m)))
    return q.join(t.leaves, "cell", "left").withColumn("bound", F.least("bound", here)).select(*names, "path").drop("cell")


def reached(q: DataFrame, t: Tree, wide: bool = False) -> DataFrame:
    """Queries with ``bound``, once for each leaf that can hold an item within it, with its ``members``; pivots met on the way
    draw the bound in, unless all items within it are wanted (``wide``)."""
    names = q.columns
    q = q.withColumn("cell", F.lit(0).cast("long"))
    for node in t.nodes:
        j = q.join(node, "cell", "left").withColumn("_s", F.transform("subs", lambda s: F.struct(distance(t.parts, HERE, s).alias("d"), s.alias("s"))))
        if not wide:
            near = F.array_min(F.transform(F.filter("_s", lambda x: _other(t, x["s"]["tag"])), lambda x: x["d"]))
            j = j.withColumn("bound", F.least("bound", near))
        limit = F.col("bound") + SLACK
        on = F.transform(F.filter("_s", lambda x: _open(t, x["s"]) & (x["d"] - x["s"]["hi"] <= limit) & (x["s"]["lo"] - x["d"] <= limit)), lambda x: x["s"]["sub"])
        q = j.withColumn("cell", F.explode(F.coalesce(on, F.array("cell")))).select(*names, "cell")
    return q.join(t.leaves, "cell")


def nearest(queries: DataFrame, items: DataFrame, key: str, item: str, parts: Mapping[str, float], label: str | None = None,
            places: int | None = None, fan: int = FAN, cell: int = CELL) -> DataFrame:
    """(key, item, distance): the nearest item of each query, of another label where labels are given; ties, on so many
    places, go to the least item. Queries without any such item are left out."""
    t = tree(items, item, parts, label, fan, cell)
    q = written(_walked(asked(queries, t, key, label), t).withColumn("_whole", _whole(t)))
    judged = lambda d: F.round(d, places) if places is not None else d
    members = t.leaves.select("cell", "path", F.explode("members").alias("m")).select("m.*", "cell", "path").withColumn("_whole", _whole(t))
    known = members.where("_whole")
    found = packs.nearest(q.where("_whole"), packs.put(known, t.parts, "path"), t.parts, "path", t.labelled, SLACK, known.schema["item"].dataType)
    best = found.select("query", F.struct(judged(F.col("distance")).alias("near"), "item", "distance").alias("b"))

    def met(some: DataFrame, leaves: DataFrame) -> DataFrame:
        each = F.transform(F.filter("members", lambda m: _other(t, m["tag"])), lambda m: V.let(distance(t.parts, HERE, m), lambda d: F.struct(
            judged(d).alias("near"), m["item"].alias("item"), d.alias("distance"))))
        at = reached(some.drop("path", "_whole"), Tree(t.columns, t.parts, t.nodes, leaves, t.labelled))
        return at.select("query", F.array_min(each).alias("b")).where("b is not null")

    odd = q.where("not _whole")
    if not odd.isEmpty():
        best = best.unionByName(met(odd, t.leaves))
    strange = written(members.where("not _whole").groupBy("cell").agg(
        F.collect_list(F.struct("item", "tag", *t.parts)).alias("members"), F.first("path").alias("path")))
    if not strange.isEmpty():  # no distance comes before all others
        best = best.unionByName(met(q.where("_whole"), strange))
    return best.groupBy(F.col("query").alias(key)).agg(F.min("b").alias("b")).select(key, F.col("b.item").alias(item), "b.distance")


def _whole(t: Tree) -> Column:
    """All parts are vectors of numbers, so that a distance to others like them is a number."""
    strange = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    tests = [F.coalesce(~F.exists(v, strange), F.lit(False)) for v in t.parts]
    return reduce(and_, tests)

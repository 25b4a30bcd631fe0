"""Operator 13: Merkle manifest of a dataset as a content-addressed graph, and proofs by descent from its root.

Every row is a leaf, every source a tree of runs of `FAN` nodes, and the subroots of the sources form a tree above them.
Inner nodes are stored as records digest -> children, once per digest. A proof is asked for by rank: from the root the
base-`FAN` digits of the source's rank, then those of the leaf's rank inside its source, choose a child at each record; the
children not chosen are a segment of the path, and the segments in reverse order are the proof from leaf to root.

Requests that share a prefix of digits descend as one row, so the root's record is read by one row and not by all leaves, and
the last record is joined to at most `FAN` leaves. Ranks inside a source come from ranges of (source, doc_id): a source
that holds most rows is numbered, grouped and joined in as many pieces as it has ranges.

Defined results: a null field is written `-`, which no value's `length:value` can equal; a null source is a source of its
own and comes first, a null doc_id comes first in its source and is never tampered; rows of one source that share a
doc_id are ordered by their leaf, and fully equal rows are separate leaves; an empty table has no root and no rows. Columns
besides doc_id, source, lang, n_chars and text are not part of a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklore.operators.ordered import positions

from . import store

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = ("".join(map(chr, range(a, a + 26))) for a in (65, 97))


def written(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**instead: Column) -> Column:
    return F.sha2(F.concat(*(written(instead.get(c, F.col(c))) for c in FIELDS)), 256)


@dataclass
class Manifest:
    """A written dataset tree: its tables, the root's digest (None if empty) and the depth of the tree of sources.

    leaves: g, place, m, doc_id, leaf, changed; sources: g, source, n; subroots: g, depth, digest; records: digest,
    children. g numbers the sources and place the m rows of a source, both from 0.
    """

    leaves: DataFrame
    sources: DataFrame
    subroots: DataFrame
    records: DataFrame
    root: str | None
    depth: int


def ranked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with g, m and place instead of their source, and the sources (g, source, n)."""
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    placed = store.kept(rows.repartitionByRange(*order).withColumn("_b", F.spark_partition_id()), "leaf-ranges")
    chunks = placed.groupBy("_b", "source").agg(F.count("*").alias("_n"))  # a row for each range and source in it
    sources = positions(chunks.groupBy("source").agg(F.sum("_n").alias("n")), order[:1], "g")
    sources = store.kept(sources.select((F.col("g") - 1).alias("g"), "source", "n"), "sources")
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    start = chunks.select("_b", "source", F.coalesce(before, F.lit(0)).alias("_start")).alias("c")
    start = start.join(sources.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
    start = start.select(F.col("_b").alias("_c"), F.col("s.source").alias("_source"), "_start", "g", F.col("n").alias("m"))
    numbered = placed.withColumn("_i", F.row_number().over(Window.partitionBy("_b", "source").orderBy("doc_id", "leaf")))
    both = numbered.join(start, (F.col("_b") == F.col("_c")) & F.col("source").eqNullSafe(F.col("_source")))
    return both.withColumn("place", F.col("_start") + F.col("_i") - 1).drop("_b", "_c", "_i", "_start", "_source", "source"), sources


def above(nodes: DataFrame) -> DataFrame:
    """The next level (g, place, m, digest, children) over the nodes (g, place, m, digest) of groups of m > 1 nodes."""
    runs = nodes.where("m > 1").groupBy("g", "m", F.floor(F.col("place") / FAN).alias("place"))
    up = runs.agg(F.sort_array(F.collect_list(F.struct(F.col("place").alias("at"), "digest")))["digest"].alias("children"))  # at most FAN
    return up.select("g", "place", F.ceil(F.col("m") / FAN).alias("m"), F.sha2(F.array_join("children", ""), 256).alias("digest"), "children")


def tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Records of all levels, lowest first, and the top (g, depth, digest) of each group."""
    levels, top = [], nodes.where("m = 1").select("g", F.lit(0).alias("depth"), "digest")
    while not nodes.where("m > 1").isEmpty():
        nodes = store.kept(above(nodes), "nodes")
        levels.append(nodes.select("digest", "children"))
        top = top.unionByName(nodes.where("m = 1").select("g", F.lit(len(levels)).alias("depth"), "digest"))
    return levels, top


def manifest(docs: DataFrame) -> Manifest:
    """The tree of a table. `changed` is the leaf of the tampered text, where 5 divides the crc32 of the doc_id, else null."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = F.when(hit, leaf(text=F.translate("text", UPPER, LOWER)))
    leaves, sources = ranked(docs.select("source", "doc_id", leaf().alias("leaf"), changed.alias("changed")))
    leaves = store.kept(leaves, "leaves")
    records, subroots = tree(leaves.select("g", "place", "m", F.col("leaf").alias("digest")))
    subroots = store.kept(subroots, "subroots")
    zero, n = F.lit(0).cast("long"), F.lit(subroots.count()).cast("long")
    over, top = tree(subroots.select(zero.alias("g"), F.col("g").alias("place"), n.alias("m"), "digest"))
    root = top.first()  # one row, or none
    every = docs.sparkSession.createDataFrame([], "digest string, children array<string>")
    for level in records + over:
        every = every.unionByName(level)
    every = store.kept(every.dropDuplicates(["digest"]), "records")
    return Manifest(leaves, sources, subroots, every, root and root["digest"], root["depth"] if root else 0)


def chosen(children: Column, digit: Column) -> Column:
    """The path segment of a choice: the digests to the left and to the right of it."""
    left = F.array_join(F.slice(children, F.lit(1), digit), "")
    return F.struct(left.alias("left"), F.array_join(F.slice(children, digit + 2, F.lit(FAN)), "").alias("right"))


def step(front: DataFrame, records: DataFrame, wanted: DataFrame) -> DataFrame:
    """One level down: the rows (g, place, digest, top, path) of the wanted places (g, place) under a front of such rows."""
    at = wanted.select("g", F.col("place").alias("to"), F.floor(F.col("place") / FAN).alias("place"))
    opened = front.join(records, "digest").drop("digest")
    digit = (F.col("to") % FAN).cast("int")
    down = at.join(opened, ["g", "place"])
    return down.select("g", F.col("to").alias("place"), F.element_at("children", digit + 1).alias("digest"), "top", F.array_append("path", chosen(F.col("children"), digit)).alias("path"))


def asked(rows: DataFrame, level: int) -> DataFrame:
    """The places (g, place) of a level under which rows (g, place) lie, each once."""
    return rows.select("g", F.floor(F.col("place") / FAN ** level).alias("place")).distinct()


def proofs(m: Manifest, requests: DataFrame) -> DataFrame:
    """requests (g, place, ...) with `top` (the subroot) and `path`: segments (left, right) from the leaf up to the root."""
    spark = requests.sparkSession
    segment = "array<struct<left: string, right: string>>"
    front = spark.createDataFrame([(0, 0, m.root, None, [])] if m.root else [], f"g long, place long, digest string, top string, path {segment}")
    own = requests.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("place")).distinct()
    for level in reversed(range(m.depth)):
        front = store.kept(step(front, m.records, asked(own, level)), "front")
    # from here a source enters at the level of its subroot
    tops = store.kept(front.select(F.col("place").alias("g"), "digest", "path").join(m.subroots.select("g", "depth"), "g"), "front-subroots")
    places = requests.select("g", "place")
    enter = lambda depth: tops.where(F.col("depth") == depth).select("g", F.lit(0).cast("long").alias("place"), "digest", F.col("digest").alias("top"), "path")
    deepest = tops.agg(F.max("depth")).first()[0] or 0
    front = enter(deepest) if deepest else enter(-1)
    for level in reversed(range(1, deepest)):
        front = store.kept(step(front, m.records, asked(places, level)).unionByName(enter(level)), "front")
    last = front.join(m.records, "digest").select("g", "place", "children", "top", "path")
    lone = enter(0).select("g", "place", F.lit(None).cast("array<string>").alias("children"), "top", "path")
    last = last.unionByName(lone).select(F.col("g").alias("_g"), F.col("place").alias("_run"), "children", "top", "path")
    run = F.floor(F.col("place") / FAN)
    digit = (F.col("place") % FAN).cast("int")
    path = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.array_append("path", chosen(F.col("children"), digit)))
    both = requests.join(last, (F.col("g") == F.col("_g")) & (run == F.col("_run")))
    return both.select(*(requests[c] for c in requests.columns), "top", F.reverse(path).alias("path"))


def folded(path: Column, digest: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, digest, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256))


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row, after tampering."""
    m = manifest(docs)
    held = proofs(m, m.leaves.drop("m"))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    root = F.lit(m.root).cast("string")
    told = held.select(
        "doc_id", "leaf", F.col("top").alias("subroot"), root.alias("root"), F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.col("path"), F.coalesce("changed", "leaf")).alias("folded_root"),
    )
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))

"""Sharded writes, manifests, quarantine and resume."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklore.operators import ordered

SHARD_ROWS = 5000
IMAGE_SHARD_ROWS = 100


def write_sharded(df: DataFrame, path: str, rows: int = SHARD_ROWS, split: str = "split") -> None:
    """One folder per split, files of at most ``rows`` records."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy(split).parquet(path)


def shard_counts(df: DataFrame) -> DataFrame:
    """Files and rows per split of a written corpus, from file metadata columns."""
    per = df.groupBy("split", F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("split").agg(F.count(F.lit(1)).alias("shards"), F.sum("n").alias("rows"), F.max("n").alias("largest"))


def manifest(df: DataFrame) -> DataFrame:
    """Per split: rows, sources with their counts as JSON, total bytes of text."""
    per = df.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    return per.groupBy("split").agg(
        F.sum("n").alias("total"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("sources"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n"))))).alias("breakdown"))


def write_manifest(df: DataFrame, path: str) -> None:
    manifest(df).coalesce(1).write.mode("overwrite").json(path)


def resume_filter(candidates: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    return candidates.join(completed.select(key), key, "left_anti")


def quarantine(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with their reason."""
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def merge_micro_shards(parts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Records of temporary parts: NaN and infinite values to 0 and label ids attached, -1 if unknown."""
    odd = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    clean = parts.withColumn("features", F.transform("features", lambda x: F.when(odd(x), 0.0).otherwise(x)))
    ids = vocab.select(F.col("token").alias("label"), F.col("id").alias("label_idx"))
    return clean.join(ids, "label", "left").withColumn("label_idx", F.coalesce("label_idx", F.lit(-1)))


# -- exact shards with a committed manifest ----------------------------------------


def numbered_shards(df: DataFrame, split: str, order: Sequence[str], rows: int = SHARD_ROWS) -> DataFrame:
    """Rows with their ``shard`` and 0-based ``place`` in the split along ``order``.

    Every shard of a split but its last has exactly ``rows`` rows. Places come from global positions along (split,
    order), so a split with most of the rows is numbered in as many tasks as it has ranges. Null splits are one split.
    ``order`` should tell rows apart, or equal rows are placed in any order.
    """
    p = ordered.positions(df, [F.col(split), *[F.col(o) for o in order]], "__pos")
    first = p.groupBy(F.col(split).alias("__split")).agg(F.min("__pos").alias("__first"))
    placed = p.join(first, p[split].eqNullSafe(first["__split"])).withColumn("place", F.col("__pos") - F.col("__first"))
    return placed.withColumn("shard", F.floor(F.col("place") / rows)).drop("__pos", "__split", "__first")


def shard_list(numbered: DataFrame, split: str, invariants: Mapping[str, Column] | None = None) -> DataFrame:
    """Per shard: rows, first and last place, and for every invariant the rows that break it (null counts as broken)."""
    broken = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"broken_{name}") for name, rule in (invariants or {}).items()]
    return numbered.groupBy(split, "shard").agg(
        F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"), F.max("place").alias("last"), *broken)


def split_totals(shards: DataFrame, split: str) -> DataFrame:
    """Per split: shards, rows, fullest and last shard, broken rows per invariant."""
    broken = [F.sum(c).alias(c) for c in shards.columns if c.startswith("broken_")]
    return shards.groupBy(split).agg(
        F.count(F.lit(1)).alias("shards"), F.sum("rows").alias("rows"), F.max("rows").alias("largest"),
        F.max_by("rows", "shard").alias("last_rows"), *broken)


def _misfits(shards: DataFrame, split: str, rows: int) -> Column:
    """A shard that isn't one file, has a hole or isn't full although another one follows it."""
    hole = (F.col("last") - F.col("first") + 1 != F.col("rows")) | (F.col("first") != F.col("shard") * rows)
    return (F.col("files") != 1) | hole | ((F.col("rows") != rows) & (F.col("shard") != F.col("last_shard")))


def commits(spark: SparkSession, path: str) -> DataFrame | None:
    """The commit records of a packed corpus, one per split and version; None before the first commit."""
    try:
        return spark.read.parquet(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def pack(df: DataFrame, path: str, version: str, split: str = "split", order: Sequence[str] = ("id",),
         rows: int = SHARD_ROWS, invariants: Mapping[str, Column] | None = None) -> DataFrame:
    """Write ``df`` as exact shards, one file each, and commit a manifest when everything holds; gives the totals.

    Order of writes: ``data/<version>``, then ``shards/<version>`` counted from the files themselves, then one record per split
    appended to ``commits``. Readers look at commits only, so a job that dies earlier leaves the former version in
    place, and running it again replaces its remains. A version that is committed is never written again. Rows that
    break an invariant, and files that don't hold what was numbered, raise before the commit.
    An empty table commits a version without splits, whose one record has no split and no shards.
    """
    spark = df.sparkSession
    known = commits(spark, path)
    if known is not None and not known.where(F.col("version") == version).isEmpty():
        return split_totals(spark.read.parquet(f"{path}/shards/{version}"), split)

    numbered = numbered_shards(df, split, order, rows)
    schema = T.StructType([*[f for f in numbered.schema if f.name not in (split, "shard")], numbered.schema[split], numbered.schema["shard"]])
    data = f"{path}/data/{version}"
    (numbered.repartition(split, "shard").sortWithinPartitions(split, "shard", "place")
     .write.mode("overwrite").partitionBy(split, "shard").parquet(data))

    back = spark.read.schema(schema).parquet(data).select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_size").alias("__s"))
    files = back.groupBy(split, "shard").agg(F.count_distinct("__f").alias("files"), F.max("__s").alias("bytes"))
    listed = ordered._join_on(shard_list(back, split, invariants), files, [split, "shard"])
    listed.write.mode("overwrite").parquet(f"{path}/shards/{version}")

    listed = spark.read.schema(listed.schema).parquet(f"{path}/shards/{version}")
    totals = split_totals(listed, split)
    written, expected = listed.agg(F.coalesce(F.sum("rows"), F.lit(0))).scalar(), numbered.groupBy().count().scalar()
    tail = listed.groupBy(split).agg(F.max("shard").alias("last_shard"))
    bad = F.lit(False)
    for c in totals.columns:
        bad = bad | (F.col(c) > 0) if c.startswith("broken_") else bad
    checks = ordered._join_on(listed, tail, [split]).agg(
        F.count_if(_misfits(listed, split, rows)).alias("misfits"), F.count_if(bad).alias("broken"), written.alias("written"), expected.alias("expected")).first()
    if checks.misfits or checks.broken or checks.written != checks.expected:
        raise ValueError(f"version {version} is not committed: {checks.misfits} shards don't fit, {checks.broken} shards break an invariant, "
                         f"{checks.written} of {checks.expected} rows written")

    facts = F.to_json(F.struct(F.lit(rows).alias("shard_rows"), F.lit(json.dumps(sorted(invariants or {}))).alias("invariants")))
    head = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("committed_at"),
                                 F.lit(json.dumps(schema.jsonValue())).alias("schema"), facts.alias("facts"))
    record = totals.select(F.col(split).cast("string").alias("split"), "shards", "rows", "largest", "last_rows")
    head.join(record, how="left").coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return totals


def read_packed(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The committed rows of a version, by default the newest; data without a commit is never read."""
    known = commits(spark, path)
    mine = None if known is None else known if version is None else known.where(F.col("version") == version)
    newest = None if mine is None else mine.orderBy(F.desc("committed_at"), F.desc("version")).select("version", "schema").first()
    if newest is None:
        raise FileNotFoundError(f"no committed version {version or ''} under {path}")
    return spark.read.schema(T.StructType.fromJson(json.loads(newest.schema))).parquet(f"{path}/data/{newest.version}")

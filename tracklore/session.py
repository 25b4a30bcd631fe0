"""Session defaults and small plan helpers shared by every module."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def build_session(cpus: str = "*", partitions: int = 8, memory: str = "16g") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tracklore")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    name = os.path.basename(root)
    sc.addPyFile(shutil.make_archive(
        os.path.join(folder, name), "zip", os.path.dirname(root), name))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder for cut lineage: the cluster's setting, a temporary one only where unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: one write, later readers start from the files."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(os.path.join(shared_dir(df.sparkSession), "cut"))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: computed once, reread by whatever follows, and safe from lost executors."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "written", uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


WIDE_TABLES = {"documents", "conversations", "embeddings", "pages"}


def widen(df: DataFrame) -> DataFrame:
    """Spread rows when a table has fewer scan splits than the session has cores.

    A table of many files is read in many tasks and passes unchanged; only a
    single small file, whose per-row work would sit in one task, is dealt out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df if splits >= cores else df.repartition(cores)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle to the full partition count before costly per-row work.

    Adaptive execution merges partitions by their bytes; an explicit count keeps
    small rows that expand or cost much per row on every core.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return widen(df) if name in WIDE_TABLES else df

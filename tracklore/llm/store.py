"""Tables and raw files in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.session import shared_dir, ship

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = 4 << 20  # bytes of a batch; 10,000 rows of long texts would be copied some times over in the worker and beside the heap


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run of an operator."""
    return f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write the rows as Parquet in the shared folder and reread them.

    The rows survive lost executors and are computed once however often they are read. Shuffle files of the write go
    when it has ended, as nothing else reads them.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (out, path)
    return out


_paths: dict[int, tuple[DataFrame, str]] = {}


def free(*tables: DataFrame) -> None:
    """Delete kept tables that nothing reads any more: all that was made of them is written."""
    for table in tables:
        _, path = _paths.pop(id(table), (None, None))
        if path:
            system, inner = filesystem(path)
            system.delete_dir(inner)


def filesystem(path: str):
    """(pyarrow file system, path in it) of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def put(path: str, data: bytes) -> None:
    """Write a whole file under a name that no other attempt of the task uses."""
    system, inner = filesystem(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    with system.open_output_stream(inner, compression=None) as out:
        out.write(data)


def map_arrow(df: DataFrame, rows: Callable, schema: str) -> DataFrame:
    """mapInArrow over record batches of plain Arrow columns.

    `rows` takes the iterator of batches of one task and yields dicts of column -> array in the order of `schema`. Batches
    have about `BATCH` bytes at most (more only where a single row is longer), so memory doesn't follow the length of texts.
    """
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema]

    def run(batches):
        for out in rows(batches):
            yield pa.RecordBatch.from_arrays([_array(out[n]) for n in names], names=names)

    return df.mapInArrow(run, schema)


def _array(x):
    return x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x)


def texts(df: DataFrame, *ids: str, text: str = "text") -> DataFrame:
    """The id columns and the text (null: empty), and nothing else of the table."""
    return df.select(*(F.col(c) for c in ids), F.coalesce(F.col(text), F.lit("")).alias("text"))

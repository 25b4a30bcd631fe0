"""Models and dictionaries that every task needs whole: files of the shared folder, read once by each worker."""

from __future__ import annotations

import os
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tracklore.session import shared_dir


def put(df: DataFrame) -> str:
    """Write a table for :func:`get`; a task's memory must hold it."""
    path = os.path.join(shared_dir(df.sparkSession), "side", uuid.uuid4().hex)
    df.write.parquet(path)
    return path


@lru_cache(4)
def get(path: str) -> pa.Table:
    """The rows of a written table, from within a task."""
    from pyarrow import dataset, fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    return dataset.dataset(inner, filesystem=system, format="parquet", exclude_invalid_files=False).to_table()

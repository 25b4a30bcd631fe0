"""Objects of large JSON documents, read by byte ranges of one file in as many tasks as it has ranges."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.operators import ordered
from tracklore.session import spread, written

RANGE_BYTES = 8 << 20
_ESCAPED = re.compile(rb"\\.", re.DOTALL)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path inside it; a path without a scheme is local."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """The file, or the files anywhere in the folder but hidden ones, with their sizes."""
    system, name = located(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    inside = [(i.path[len(name.rstrip("/")):], i.size) for i in system.get_file_info(fs.FileSelector(name, recursive=True)) if i.type == fs.FileType.File]
    return [(path.rstrip("/") + p, size) for p, size in inside if not re.search(r"/[._]", p)]


def _block(f, start: int, size: int) -> np.ndarray:
    """Bytes of a range with escaped ones blanked; backslashes in front of the range are looked at too."""
    slashes, back = 0, 64
    while start:
        f.seek(max(0, start - back))
        before = f.read(min(start, back))
        slashes = len(before) - len(before.rstrip(b"\\"))
        if slashes < len(before) or len(before) == start:
            break
        back *= 4
    f.seek(start)
    data = f.read(size)
    if slashes % 2 and data:
        data = b" " + data[1:]
    return np.frombuffer(_ESCAPED.sub(b"  ", data), dtype=np.uint8)


def _depths(block: np.ndarray, in_string: int) -> tuple[np.ndarray, np.ndarray]:
    """Change of depth at every byte outside strings, and whether a byte lies in a string, for the state at its begin."""
    inside = ((np.cumsum(block == 34) + in_string) & 1).astype(bool)
    step = ((block == 123) | (block == 91)).astype(np.int64) - ((block == 125) | (block == 93))
    return np.where(inside, 0, step), inside


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, number, start, size in pdf[["path", "number", "start", "size"]].itertuples(index=False, name=None):
            system, name = located(path)
            with system.open_input_file(name) as f:
                block = _block(f, start, size)
            out.append((path, number, start, size, int((block == 34).sum() & 1), *(int(_depths(block, s)[0].sum()) for s in (0, 1))))
        yield pd.DataFrame(out, columns=["path", "number", "start", "size", "quotes", "plain", "quoted"])


def _elements(f, start: int, size: int, in_string: int, depth: int, base: int) -> Iterator[tuple[int, bytes]]:
    """Objects one level below ``base`` that begin in a range, with their place; the last one is read beyond the range."""
    block = _block(f, start, size)
    step, _ = _depths(block, in_string)
    after = depth + np.cumsum(step)
    begins = np.flatnonzero((step == 1) & (after == base + 1) & (block == 123))
    ends = np.flatnonzero((step == -1) & (after == base) & (block == 125))
    if not len(begins):
        return
    ends = ends[ends > begins[0]]
    for b, e in zip(begins, ends):
        f.seek(start + int(b))
        yield start + int(b), f.read(int(e - b) + 1)
    if len(ends) == len(begins):
        return
    first, place = start + int(begins[-1]), start + len(block)
    at = depth + int(step.sum())
    in_string = (in_string + int((block == 34).sum())) & 1
    while True:
        block = _block(f, place, size)
        if not len(block):
            raise ValueError(f"the object at byte {first} has no end")
        step, _ = _depths(block, in_string)
        stop = np.flatnonzero((step == -1) & (at + np.cumsum(step) == base))
        if len(stop):
            f.seek(first)
            yield first, f.read(place + int(stop[0]) + 1 - first)
            return
        at, in_string, place = at + int(step.sum()), (in_string + int((block == 34).sum())) & 1, place + len(block)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, start, size, in_string, depth in pdf[["path", "start", "size", "in_string", "depth"]].itertuples(index=False, name=None):
            system, name = located(path)
            with system.open_input_file(name) as f:
                base = int(f.read(4096).removeprefix(b"\xef\xbb\xbf").lstrip()[:1] == b"[")
                rows = [(path, place, text.decode("utf-8", "replace")) for place, text in _elements(f, start, size, in_string, depth, base)]
            yield pd.DataFrame(rows, columns=["path", "place", "json"])


def json_objects(spark: SparkSession, paths: Sequence[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, place and json of every object of JSON arrays (or of objects one after the other) in UTF-8 files or folders.

    Whether a range begins in a string, and how deep, depends on all text in front of it. So every range is first read for both
    cases: its quotes and its changes of depth outside of strings. Running sums over these few numbers, one row per range,
    give each range its true state, and it then gives the objects that begin in it. A task holds one range and one object.
    Elements that aren't objects are passed over, empty files have none, and an object without an end raises.
    """
    sizes = [(p, size) for path in paths for p, size in _files(path) if size]
    files = spark.createDataFrame(sizes, "path string, bytes long")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / range_bytes))).alias("number")).select(
        "path", "number", (F.col("number") * range_bytes).alias("start"), F.lit(range_bytes).cast("long").alias("size"))
    found = written(spread(ranges, "path", "number").mapInPandas(
        _summaries, "path string, number long, start long, size long, quotes long, plain long, quoted long"))
    chunk = F.floor(F.col("number") / 4096)
    state = ordered.running(found, ["path"], ["number"], chunk, {"__q": ("sum", F.col("quotes"))}).withColumn(
        "in_string", F.pmod(F.col("__q") - F.col("quotes"), F.lit(2)))
    change = F.when(F.col("in_string") == 0, F.col("plain")).otherwise(F.col("quoted"))
    state = ordered.running(state.withColumn("change", change), ["path"], ["number"], chunk, {"__d": ("sum", F.col("change"))})
    state = state.withColumn("depth", F.col("__d") - F.col("change"))
    return spread(state, "path", "number").mapInPandas(_read, "path string, place long, json string")

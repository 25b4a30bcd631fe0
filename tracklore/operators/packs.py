"""Nearest items of blocks of queries, by products of matrices.

Items lie in files of the shared folder, sorted by their place in a tree of cells and cut into packs. A task holds some
thousand queries and reads only the packs whose ball can hold something within a query's bound, the nearest packs first, so that
bounds draw in. A product of matrices gives distances with a known error; what comes within it of the best is computed
again term by term. Nothing is copied per query and cell: where no pack can be left out, the work is quadratic, not the disk.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklore.session import shared_dir, ship
from tracklore.sources import side

PACK = 512  # items of a pack, queries of a chunk
FILE = 16 * PACK  # items of a file
BLOCK = 8 * PACK  # queries of a task
PAIRS = 1 << 16  # pairs that are computed term by term at once


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column padded with zeros, and their lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), int(n.max()) if len(n) else 0))
    out[np.arange(out.shape[1]) < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out, n


class _Side:
    """Vectors of queries or items, each part a matrix."""

    def __init__(self, rows, parts: Mapping[str, float]):
        got = [_matrix(rows.column(c)) for c in parts]
        self.parts, self.lengths = [m for m, _ in got], np.stack([n for _, n in got], 1)
        self.squares = [np.einsum("ij,ij->i", m, m) for m in self.parts]
        self.tags = rows.column("tag").to_pylist() if "tag" in rows.schema.names else [None] * rows.num_rows


def _wide(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    return tuple(m if m.shape[1] == w else np.pad(m, ((0, 0), (0, w - m.shape[1]))) for m in (a, b))


def _about(a: _Side, some: np.ndarray, b: _Side, weights: list[float]) -> tuple[np.ndarray, float]:
    """Distances of some rows of one side to all of another, and how far from the true ones they can be."""
    total, error = np.zeros((len(some), len(b.tags))), 0.0
    for x, y, xx, yy, w in zip(a.parts, b.parts, a.squares, b.squares, weights):
        x, y = _wide(x[some], y)
        g = x @ y.T
        g *= -2
        g += xx[some][:, None]
        g += yy
        np.maximum(g, 0, out=g)
        np.sqrt(g, out=g)
        g *= w
        total += g
        error += w * np.sqrt(4e-15 * (x.shape[1] + 8) * (xx[some].max(initial=0) + yy.max(initial=0)))
    return total, float(error)


def _exact(a: _Side, i: np.ndarray, b: _Side, j: np.ndarray, weights: list[float]) -> np.ndarray:
    """Distances of pairs, summed in the order of the elements."""
    out = np.empty(len(i))
    for first in range(0, len(i), PAIRS):
        m, n, total = i[first:first + PAIRS], j[first:first + PAIRS], 0.0
        for x, y, w in zip(a.parts, b.parts, weights):
            x, y = _wide(x[m], y[n])
            d = x - y
            total = total + w * np.sqrt(np.cumsum(d * d, axis=1)[:, -1] if d.shape[1] else np.zeros(len(m)))
        out[first:first + PAIRS] = total
    return out


def _codes(tags: list, seen: dict) -> np.ndarray:
    return np.array([-1 if t is None else seen.setdefault(t, len(seen)) for t in tags], np.int64)


def put(items: DataFrame, parts: Mapping[str, float], order: str) -> str:
    """Write items (item, tag, the parts) as files of packs in the order of a column; a table of packs, for tasks to read."""
    spark = items.sparkSession
    ship(spark)
    folder, names, weights = os.path.join(shared_dir(spark), "packs", uuid.uuid4().hex), list(parts), list(parts.values())
    dealt = items.repartitionByRange(max(1, -(-items.count() // FILE)), order, "item").sortWithinPartitions(order, "item")

    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        rows = pa.Table.from_batches(rows).combine_chunks()
        system, inner = _place(folder)
        system.create_dir(inner, recursive=True)
        name = f"{uuid.uuid4().hex}.arrow"
        out = {c: [] for c in ("name", "number", "radius", *names)}
        with system.open_output_stream(f"{inner}/{name}") as sink, pa.ipc.new_file(sink, rows.schema) as file:
            for number, pack in enumerate(rows.to_batches(max_chunksize=PACK)):
                file.write_batch(pack)
                s = _Side(pack, parts)
                centre = [m.mean(0) for m in s.parts]
                far = sum(w * np.sqrt(((m - c) ** 2).sum(1)) for m, c, w in zip(s.parts, centre, weights))
                for c, v in zip(out, (name, number, float(far.max()) * (1 + 1e-9), *(c.tolist() for c in centre))):
                    out[c].append(v)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("name", pa.string()), ("number", pa.int32()), ("radius", pa.float64()), *((c, pa.list_(pa.float64())) for c in names)]))

    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("number", T.IntegerType()), T.StructField("radius", T.DoubleType()),
                           *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in names)])
    listed = side.put(dealt.select("item", "tag", *names).mapInArrow(run, schema))
    return f"{listed}\n{folder}"


def _search(rows: pa.Table, listed: pa.Table, folder: str, parts: Mapping[str, float], labelled: bool, slack: float):
    """(query row, item, distance) batches: for each query the items within slack of its nearest, of equal distances in a pack the least."""
    weights, seen = list(parts.values()), {}
    q = _Side(rows, parts)
    tags = _codes(q.tags, seen)
    bound = rows.column("bound").to_numpy().copy()
    balls, radius = _Side(listed, parts), listed.column("radius").to_numpy()
    least = np.empty((rows.num_rows, len(radius)), np.float32)  # bounds from below, rounded down
    for first in range(0, rows.num_rows, PACK):
        some = np.arange(first, min(first + PACK, rows.num_rows))
        d, error = _about(q, some, balls, weights)
        least[some] = np.nextafter((d - (radius + error)).astype(np.float32), np.float32(-np.inf))
    system, inner = _place(folder)
    files, found = {}, []
    names, numbers = listed.column("name").to_pylist(), listed.column("number").to_pylist()
    for p in np.argsort(least.min(0), kind="stable").tolist():
        near = np.flatnonzero(least[:, p] <= bound + slack)
        if not len(near):
            continue
        if names[p] not in files:
            if len(files) == 64:
                files.clear()
            files[names[p]] = pa.ipc.open_file(system.open_input_file(f"{inner}/{names[p]}"))
        pack = files[names[p]].get_batch(numbers[p])
        s = _Side(pack, parts)
        own = _codes(s.tags, seen)
        rank = pc.rank(pack.column("item"), sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()
        for first in range(0, len(near), PACK):
            some = near[first:first + PACK]
            d, error = _about(q, some, s, weights)
            if labelled:
                d[(tags[some][:, None] == own) | (own < 0) | (tags[some][:, None] < 0)] = np.inf
            if (s.lengths != s.lengths[0]).any() or (q.lengths[some] != s.lengths[0]).any():
                d[(q.lengths[some][:, None] != s.lengths).any(2)] = np.inf
            low = d.min(1)
            limit = np.minimum(bound[some], low + error) + error + slack
            hit = np.flatnonzero((low <= limit) & np.isfinite(low))
            if not len(hit):
                continue
            r, c = np.nonzero(d[hit] <= limit[hit][:, None])
            r = some[hit[r]]
            true = _exact(q, r, s, c, weights)
            np.minimum.at(bound, r, true)
            keep = np.flatnonzero(true <= bound[r] + slack)
            keep = keep[np.lexsort((rank[c[keep]], true[keep], r[keep]))]
            a, t = r[keep], true[keep]
            new = np.ones(len(keep), bool)
            new[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1])
            found.append((a[new], pack.column("item").take(pa.array(c[keep][new])), t[new]))
    for a, item, t in found:
        last = t <= bound[a] + slack
        if last.any():
            yield a[last], item.filter(pa.array(last)), t[last]


def nearest(queries: DataFrame, stored: str, parts: Mapping[str, float], order: str, labelled: bool, slack: float, item: T.DataType) -> DataFrame:
    """(query, item, distance): the items of other labels within slack of the nearest, at least the least of those; queries
    (query, tag, the parts, bound) have whole vectors of numbers, and bounds that some item holds (infinite if unknown)."""
    spark = queries.sparkSession
    ship(spark)
    listed, folder = stored.split("\n")
    n, few = queries.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = queries.repartitionByRange(max(1, min(few, -(-n // PACK)), -(-n // BLOCK)), order, "query").sortWithinPartitions(order, "query")

    def run(batches):
        held, size = [], 0
        for batch in (*batches, None):
            if batch is not None and batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if held and (batch is None or size >= 2 * BLOCK):
                rows, held, size = pa.Table.from_batches(held).combine_chunks(), [], 0
                for a, it, t in _search(rows, side.get(listed), folder, parts, labelled, slack):
                    yield pa.RecordBatch.from_arrays([rows.column("query").combine_chunks().take(pa.array(a)), it, pa.array(t)], names=["query", "item", "distance"])

    schema = T.StructType([queries.schema["query"], T.StructField("item", item), T.StructField("distance", T.DoubleType())])
    return dealt.select("query", "tag", *parts, "bound").mapInArrow(run, schema)

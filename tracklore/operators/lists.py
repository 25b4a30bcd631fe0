"""Items of lists looked up in a table of any size, without a row for each item in a shuffle.

Rows are cut into blocks where they are, or dealt by key before if a key has several. The lists of a block lie in a file of the shared
folder, as codes of the block's distinct items; only those, one row for each block that has them, meet the table and travel back. A task
then reads the codes of one block beside its values, so memory follows a block (or the rows of one key), never the table.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklore.session import shared_dir, ship

BLOCK = 64 << 20  # bytes of items and codes in a block
BATCH = 4 << 20  # bytes of a batch, to and from a task
SLICE = 1 << 18  # bytes of a row of distinct items
WRITING = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def _name() -> int:
    """A number that no other attempt of a task uses."""
    return uuid.uuid4().int >> 65


def _kept(df: DataFrame, path: str) -> DataFrame:
    """The rows as written files; shuffle files of the write go with its end."""
    spark = df.sparkSession
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def _drop(path: str) -> None:
    system, inner = _place(path)
    system.delete_dir(inner)


def _together(rows: DataFrame, key: str, few: int) -> DataFrame:
    """Rows of one key side by side in one task."""
    return rows.repartition(few, key).sortWithinPartitions(key)


def _sizes(items: pa.Array) -> np.ndarray:
    """Bytes of every item."""
    if pa.types.is_string(items.type) or pa.types.is_binary(items.type) or pa.types.is_large_string(items.type):
        return pc.fill_null(pc.binary_length(items), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.full(len(items), 8)


def _cuts(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` bytes; a single larger piece is one."""
    start = np.cumsum(sizes) - sizes
    return pairwise([0, *(np.flatnonzero(np.diff(start // limit)) + 1).tolist(), *[len(sizes)] * (len(sizes) > 0)])


def _begins(keys: pa.Array) -> np.ndarray:
    """Which rows but the first have another key than the row before; null is a key."""
    a, b = keys.slice(0, len(keys) - 1), keys.slice(1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return ~same.to_numpy(zero_copy_only=False)


def _coded(batches: Iterable[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Rows (key, items) to files of blocks, those of a key side by side; the distinct items and the keys of each block."""
    groups, weight, last = [], 0, None  # a group has whole keys
    for batch in batches:
        some = pc.greater(pc.fill_null(pc.list_value_length(batch.column(1)), 0), 0)
        batch = batch if pc.all(some).as_py() else batch.filter(some)
        if not batch.num_rows:
            continue
        keys = batch.column(0).take(pa.array(np.arange(batch.num_rows)))  # else the whole batch, texts too, stays in memory
        new = np.ones(len(keys), bool) if last is None else _begins(pa.concat_arrays([last, keys]))
        last = keys.slice(len(keys) - 1)
        head = int(np.argmax(new)) if new.any() else len(keys)
        for a, b, begins in ((0, head, False), (head, len(keys), True)):
            if a == b:
                continue
            if begins and weight >= BLOCK:
                yield from _block(groups, folder)
                groups, weight = [], 0
            if begins:
                groups.append([])
            part = batch.column(1).slice(a, b - a)
            items = part.flatten()
            weight += 4 * len(items) + int(_sizes(items).sum())
            groups[-1].append((keys.slice(a, b - a), pc.list_value_length(part).to_numpy().copy(), items.dictionary_encode()))
    if groups:
        yield from _block(groups, folder)


def _block(groups: list, folder: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import parquet

    lists = pa.chunked_array([coded for g in groups for _, _, coded in g]).unify_dictionaries().chunks
    items = lists[0].dictionary
    if not len(items):
        return
    n = np.zeros(len(items), np.int64)
    for x in lists:
        n += np.bincount(x.indices.drop_null().to_numpy(), minlength=len(items))
    order = np.argsort(-n, kind="stable")  # frequent items have small codes, of which files are shorter
    code = np.empty(len(items), np.int32)
    code[order] = np.arange(len(items), dtype=np.int32)
    code, items, block, lists = pa.array(code), items.take(pa.array(order)), _name(), iter(lists)
    system, inner = _place(folder)
    system.create_dir(inner, recursive=True)
    schema = pa.schema([("key", groups[0][0][0].type), ("codes", pa.list_(pa.int32()))])
    with system.open_output_stream(f"{inner}/{block:x}.codes") as sink, parquet.ParquetWriter(
            sink, schema, compression="zstd", use_dictionary=False, use_byte_stream_split=["codes.list.element"]) as file:
        for g in groups:
            parts = [pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), code.take(next(lists).indices))], schema=schema) for keys, size, _ in g]
            file.write_table(pa.Table.from_batches(parts), row_group_size=sum(p.num_rows for p in parts))
    for g in groups:
        for keys, _, _ in g:
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([0], pa.int32()), pa.nulls(1, pa.list_(items.type)), pa.ListArray.from_arrays(
                pa.array([0, len(keys)], pa.int32()), keys)], names=["__block", "first", "items", "keys"])
    none = pa.nulls(1, pa.list_(groups[0][0][0].type))
    for a, b in _cuts(_sizes(items), SLICE):
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([a], pa.int32()), pa.ListArray.from_arrays(
            pa.array([0, b - a], pa.int32()), items.slice(a, b - a)), none], names=["__block", "first", "items", "keys"])


def _resolved(batches: Iterable[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Rows (block, code, value) in this order to a file for each block; the names of both files."""
    from pyarrow import parquet

    held, block = [], None
    for batch in chain(batches, [None]):
        blocks = batch.column(0).to_numpy() if batch is not None else np.array([-1])
        at = np.flatnonzero(np.diff(blocks)) + 1
        for a, b in pairwise([0, *at.tolist(), len(blocks)] if len(blocks) else []):
            if held and blocks[a] != block:
                values = _name()
                system, inner = _place(folder)
                with system.open_output_stream(f"{inner}/{values:x}.values") as sink:
                    parquet.write_table(pa.Table.from_batches(held), sink, compression="zstd", use_dictionary=False)
                held = []
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([values])], names=["__block", "values"])
            block = int(blocks[a])
            if batch is not None:
                held.append(batch.slice(a, b - a).select([1, 2]))


def _read(block: int, values: int, folder: str) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(keys, lists of values) of a block."""
    from pyarrow import parquet

    system, inner = _place(folder)
    with system.open_input_file(f"{inner}/{values:x}.values") as source:
        found = parquet.read_table(source)
    value, n = found.column(1).combine_chunks(), np.bincount(found.column(0).to_numpy())
    first, size, rank = np.cumsum(n) - n, _sizes(value), None
    with system.open_input_file(f"{inner}/{block:x}.codes") as source:
        file = parquet.ParquetFile(source)
        for g in range(file.num_row_groups):
            rows = file.read_row_group(g)
            keys, lists = rows.column(0).combine_chunks(), rows.column(1).combine_chunks()
            long, flat = lists.value_lengths().to_numpy(), lists.flatten()
            kept = pc.is_valid(flat).to_numpy(zero_copy_only=False)
            code, row = flat.drop_null().to_numpy(), np.repeat(np.arange(len(keys)), long)[kept]
            new = np.concatenate(([True], _begins(keys)))
            if n.max() > 1 or not new.all():  # several values of an item, several rows of a key
                place = (np.arange(len(flat)) - np.repeat(np.cumsum(long) - long, long))[kept]
                times = n[code]
                at = np.repeat(first[code] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                row, place = np.repeat((np.cumsum(new) - 1)[row], times), np.repeat(place, times)
                rank = pc.rank(value, tiebreaker="dense").to_numpy() if rank is None else rank
                order = np.lexsort((rank[at], place, row))
                at, row, keys = at[order], row[order], keys.filter(pa.array(new))
            else:
                at = first[code]
            long = np.bincount(row, minlength=len(keys))
            keys, long = keys.filter(pa.array(long > 0)), long[long > 0]
            ends = np.concatenate(([0], np.cumsum(long)))
            for a, b in _cuts(np.diff(np.concatenate(([0], np.cumsum(size[at] + 4)))[ends]), BATCH):
                yield keys.slice(a, b - a), pa.ListArray.from_arrays(
                    pa.array(ends[a:b + 1] - ends[a], pa.int32()), value.take(pa.array(at[ends[a]:ends[b]])))


def _blocks(rows: DataFrame, key: str, items: Column) -> tuple[str, DataFrame]:
    """A folder with the lists of rows as codes, and the distinct items and the keys of its blocks."""
    folder = os.path.join(shared_dir(rows.sparkSession), "lists", uuid.uuid4().hex)
    pairs = rows.select(key, items.alias("items"))
    schema = T.StructType([
        T.StructField("__block", T.LongType()), T.StructField("first", T.IntegerType()),
        T.StructField("items", pairs.schema["items"].dataType), T.StructField("keys", T.ArrayType(rows.schema[key].dataType))])
    return folder, _kept(pairs.mapInArrow(lambda batches: _coded(batches, folder), schema), f"{folder}/asked")


def looked_up(rows: DataFrame, key: str, items: Column, item: str, find: Callable[[DataFrame], DataFrame], value: str, name: str) -> DataFrame:
    """(key, ``name``): the values of a key's items, in order of their place in the list and of the value.

    ``find`` gets rows with a column ``item`` and gives each of them one or more values, none of them null. Null items are left out,
    and so are keys without any other; rows of one key are one, and null is a key.
    """
    spark: SparkSession = rows.sparkSession
    ship(spark)
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder, coded = _blocks(rows, key, items)
    if not coded.select(F.explode("keys").alias("k")).groupBy("k").count().where("count > 1").isEmpty():
        _drop(folder)
        folder, coded = _blocks(_together(rows, key, few), key, items)
    asked = coded.select("__block", "first", F.posexplode("items").alias("i", item)).select(
        "__block", (F.col("first") + F.col("i")).alias("__code"), item)
    found = find(asked).select("__block", "__code", value)
    named = found.repartition(few, "__block").sortWithinPartitions("__block", "__code", value).mapInArrow(
        lambda batches: _resolved(batches, folder), "__block long, values long")
    files = [(r[0], r[1]) for r in _kept(named, f"{folder}/files").collect()]  # two numbers a block
    _drop(f"{folder}/asked")  # read for the last time
    schema = T.StructType([rows.schema[key], T.StructField(name, T.ArrayType(found.schema[value].dataType, False))])

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                for keys, lists in _read(*files[i], folder):
                    yield pa.RecordBatch.from_arrays([keys, lists], names=[key, name])

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(run, schema)

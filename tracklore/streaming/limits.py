"""Rate limit of addresses of any size: composed tables of chunks instead of one fold per address.

A window opens with the first request after the last one has ended, so the state between two requests is the request that
opened the window. A chunk of at most ``CHUNK`` consecutive requests of one address maps the window it is entered with to the
window it leaves: a step function, as a later end never leads to an earlier start. Tables of ``FAN`` neighbours are composed
to one, level by level, until each address has a single table; then the entry of every chunk is handed down the levels, and
all chunks are replayed at once. An address that holds all rows uses as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.operators.ordered import positions
from tracklore.session import written

CHUNK, FAN = 1 << 13, 16
NEVER = -np.inf
TABLE = "node long, at array<double>, start array<double>, pos array<long>"


def by_group(df: DataFrame, keys: list[str], order: list[str], fn: Callable, schema: str) -> DataFrame:
    """``fn(rows)`` for each group of equal keys, rows as a dict of columns in order; a task holds one group at a time."""
    names = df.columns
    out = [f.name for f in df.sparkSession.createDataFrame([], schema).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def solved(part: pa.Table):
            got = fn({n: part.column(n) for n in names})
            return pa.RecordBatch.from_arrays([pa.array(got[n]) if not isinstance(got[n], (pa.Array, pa.ChunkedArray)) else got[n] for n in out], names=out)

        def flush():
            whole = pa.concat_tables(held).combine_chunks()
            held.clear()
            return solved(whole)

        last = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            if not part.num_rows:
                continue
            tags = list(zip(*(part.column(k).to_pylist() for k in keys)))
            first = [0] + [i for i in range(1, len(tags)) if tags[i] != tags[i - 1]]
            for a, z in zip(first, [*first[1:], len(tags)]):
                if held and tags[a] != last:
                    yield flush()
                held.append(part.slice(a, z - a))
                last = tags[a]
        if held:
            yield flush()

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def merged(at: np.ndarray, start: np.ndarray, pos: np.ndarray, seconds: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A table without lines that say the same as the next, and without those no entry can meet: a window that is open at the
    first request ends within `seconds` of it."""
    last = int(np.searchsorted(at, at[0] + seconds, "right"))  # the first line beyond stands for all later ends
    at, start, pos = at[:last + 1], start[:last + 1], pos[:last + 1]
    keep = np.append(pos[1:] != pos[:-1], True)
    return at[keep], start[keep], pos[keep]


def left(table, entry: tuple[float, int], seconds: float) -> tuple[float, int]:
    """The window (start, position of its first request) after a table that is entered with one."""
    at, start, pos = table
    i = int(np.searchsorted(at, entry[0] + seconds, "right"))
    return entry if i == len(at) else (float(start[i]), int(pos[i]))


def composed(one, two, seconds: float):
    """The table of a run of requests followed by another."""
    at, start, pos = one
    i = np.searchsorted(two[0], start + seconds, "right")
    goes_on = i < len(two[0])
    j = np.minimum(i, len(two[0]) - 1)
    later = two[0] > at[-1]
    return merged(np.concatenate([at, two[0][later]]), np.concatenate([np.where(goes_on, two[1][j], start), two[1][later]]),
                  np.concatenate([np.where(goes_on, two[2][j], pos), two[2][later]]), seconds)


def following(t: np.ndarray, seconds: float) -> np.ndarray:
    """Of each request the one that opens the next window, if it opened one itself (their number if none does)."""
    return np.searchsorted(t, t + seconds, "right")


def chunk_table(t: np.ndarray, pos: np.ndarray, seconds: float):
    nxt = following(t, seconds)
    last = np.where(nxt < len(t), nxt, np.arange(len(t)))
    while not np.array_equal(last[last], last):  # jumps of double length to the last window that opens here
        last = last[last]
    return merged(t, t[last], pos[last], seconds)


def replayed(t: np.ndarray, pos: np.ndarray, entry: tuple[float, int], most: int, seconds: float) -> tuple[np.ndarray, np.ndarray]:
    """(allowed, seconds to retry) of consecutive requests."""
    nxt, opens = following(t, seconds), []
    i = int(np.searchsorted(t, entry[0] + seconds, "right"))
    while i < len(t):
        opens.append(i)
        i = int(nxt[i])
    of = np.searchsorted(np.array(opens, np.int64), np.arange(len(t)), "right")
    begin = np.concatenate([[entry[0]], t[opens]])[of]
    rank = pos - np.concatenate([[entry[1]], pos[opens]])[of]
    allowed = rank < most
    return allowed, np.where(allowed, 0, np.trunc(np.where(allowed, 0, begin + seconds - t))).astype(np.int32)


def _table(rows, i: int):
    return tuple(np.asarray(rows[c][i].as_py()) for c in ("at", "start", "pos"))


def rate_limit(requests: DataFrame, key: str, order: list[str], event: str, seconds_at: str, most: int = 5, seconds: float = 900.0,
               chunk: int = CHUNK) -> DataFrame:
    """(key, event, allowed, retry_seconds) of every request: at most ``most`` in a window, which opens with its first request
    and lasts ``seconds``. ``seconds_at`` is the time in seconds and must not fall along ``order``. A null key is an address."""
    kind = requests.schema[key].dataType.simpleString()
    given = requests.select(*dict.fromkeys([key, event, *order]), F.col(seconds_at).cast("double").alias("_t"))
    placed = positions(given, [F.col(key), *[F.col(c) for c in order]], "_pos").withColumn("_node", F.floor(F.col("_pos") / chunk))
    placed = written(placed.select(key, event, "_t", "_pos", "_node"))
    spans = placed.groupBy(key).agg(F.min("_node").alias("_a"), F.max("_node").alias("_z")).where("_a < _z").select(F.col(key).alias("_key"))
    several = placed.join(spans, F.col(key).eqNullSafe(F.col("_key")), "left_semi")  # other addresses begin and end in one chunk
    numpy = lambda c: c.to_numpy()

    def first(rows):
        at, start, pos = chunk_table(numpy(rows["_t"]), numpy(rows["_pos"]), seconds)
        return {key: rows[key][:1].combine_chunks(), "node": rows["_node"][:1].combine_chunks(), "at": [at], "start": [start], "pos": [pos]}

    def up(rows):
        table = _table(rows, 0)
        for i in range(1, len(rows["node"])):
            table = composed(table, _table(rows, i), seconds)
        node = [rows["node"][0].as_py() // FAN]
        return {key: rows[key][:1].combine_chunks(), "node": node} | {n: [v] for n, v in zip(("at", "start", "pos"), table)}

    def down(rows):
        entry, out = (rows["entry"][0].as_py(), rows["entry_pos"][0].as_py()), []
        for i in range(len(rows["node"])):
            out.append(entry)
            entry = left(_table(rows, i), entry, seconds)
        return {key: rows[key].combine_chunks(), "node": rows["node"].combine_chunks(),
                "entry": [e for e, _ in out], "entry_pos": pa.array([p for _, p in out], pa.int64())}

    def replay(rows):
        entry, at = rows["entry"][0].as_py(), rows["entry_pos"][0].as_py()
        allowed, retry = replayed(numpy(rows["_t"]), numpy(rows["_pos"]), (NEVER if entry is None else entry, at or 0), most, seconds)
        return {key: rows[key].combine_chunks(), event: rows[event].combine_chunks(), "allowed": allowed, "retry_seconds": retry}

    key_node = f"`{key}` {kind}, "
    levels = [written(by_group(several, [key, "_node"], ["_pos"], first, key_node + TABLE))]
    while not levels[-1].groupBy(key).count().where("count > 1").isEmpty():
        parent = levels[-1].withColumn("_up", F.floor(F.col("node") / FAN))
        levels.append(written(by_group(parent, [key, "_up"], ["node"], up, key_node + TABLE)))
    entry = levels[-1].select(F.col(key).alias("_key"), F.col("node").alias("_up"), F.lit(NEVER).alias("entry"), F.lit(0).cast("long").alias("entry_pos"))
    for level in reversed(levels[:-1]):
        at = level.withColumn("_up", F.floor(F.col("node") / FAN)).alias("l").join(
            entry.alias("e"), F.col(f"l.{key}").eqNullSafe(F.col("e._key")) & (F.col("l._up") == F.col("e._up")))
        at = at.select(f"l.{key}", "l._up", "l.node", "at", "start", "pos", "entry", "entry_pos")
        entry = written(by_group(at, [key, "_up"], ["node"], down, key_node + "node long, entry double, entry_pos long"))
        entry = entry.withColumnRenamed(key, "_key").withColumnRenamed("node", "_up")
    whole = placed.alias("p").join(entry.alias("e"), F.col(f"p.{key}").eqNullSafe(F.col("e._key")) & (F.col("p._node") == F.col("e._up")), "left")
    whole = whole.select(f"p.{key}", event, "_t", "_pos", "_node", "entry", "entry_pos")
    event_kind = requests.schema[event].dataType.simpleString()
    return by_group(whole, [key, "_node"], ["_pos"], replay, key_node + f"`{event}` {event_kind}, allowed boolean, retry_seconds int")

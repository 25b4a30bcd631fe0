"""Operator 6: best-fit packing of token sequences by length patterns.

Only the histogram of piece lengths (at most `size` numbers) is planned on the driver. Patterns of one to four lengths
that fill a sequence are enumerated by rule, their repeat counts are fitted to the histogram by non-negative least
squares, rounded down, and what is left is packed best-fit, longest first, on counts. The plan is a table of ranges
for each length, whose size depends on `size` alone; pieces are numbered within their length by counts per task, and
every piece reads its place from the plan. No piece but its number meets another, so no length is a hot key.

Defined results: null text is empty; rows of equal doc_id are packed separately; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .tokens import encoder, worker_path


def patterns(size: int) -> np.ndarray:
    """Rows of four lengths (0: none) with sum `size`: all pairs, and triples and fours by halving and thirds."""
    rows = [(size, 0, 0, 0)]
    for a in range(1, size):
        rest = size - a
        if a >= rest:
            rows.append((a, rest, 0, 0))
        for share in (2, 3, 4, 6):
            b = rest // share
            if b and rest - b >= b:
                rows.append((a, rest - b, b, 0))
                c = (rest - b) // 2
                if c:
                    rows.append((a, rest - b - c, c, b))
    return np.unique(-np.sort(-np.array(rows), axis=1), axis=0)


def fit(counts: np.ndarray, rows: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeats x >= 0 that minimise the squared gap between the lengths the patterns use and `counts`.

    Accelerated projected gradient on the sparse incidence of patterns and lengths.
    """
    used = rows > 0
    flat = rows[used]
    owner = np.nonzero(used)[0]
    n = len(rows)
    step = 1 / (4 * np.bincount(flat, minlength=len(counts)).max() + 1)
    x = np.zeros(n)
    y, t = x, 1.0
    for _ in range(rounds):
        gap = np.bincount(flat, y[owner], len(counts)) - counts
        new = np.maximum(0, y - step * np.bincount(owner, gap[flat], n))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, new + (before - 1) / t * (new - x)
    return x


Group = tuple[list[tuple[int, int]], int]


def groups(counts: np.ndarray, size: int) -> list[Group]:
    """Sequences as (list of (length, times), repeats); every counted piece is in exactly one.

    Patterns of up to two, three and four pieces, fitted wholly or by half, are tried on the histogram; the fewest
    sequences win.
    """
    rows = patterns(size)
    tried = []
    for most in (2, 3, 4):
        some = rows[(rows > 0).sum(1) <= most]
        x = fit(counts.astype(float), some)
        tried += [filled(counts, size, some, x * share) for share in (1.0, 0.5, 0.25)]
    return min(tried, key=lambda gs: sum(n for _, n in gs))


def filled(counts: np.ndarray, size: int, rows: np.ndarray, x: np.ndarray) -> list[Group]:
    """Sequences of the patterns `rows`, each x times rounded down, and of what is left, best-fit and longest first."""
    left = counts.copy()
    out: list[Group] = []
    for i in np.argsort(-x, kind="stable").tolist():
        if x[i] < 1:
            break
        lengths, times = np.unique(rows[i][rows[i] > 0], return_counts=True)
        repeats = int(min(int(x[i]), (left[lengths] // times).min()))
        if repeats:
            left[lengths] -= repeats * times
            out.append((list(zip(lengths.tolist(), times.tolist(), strict=True)), repeats))
    room: dict[int, list[Group]] = {}  # open sequences by their free places
    for length in range(size, 0, -1):
        todo = int(left[length])
        while todo:
            space = min((s for s in room if s >= length), default=size)
            most = space // length
            have, repeats = room[space].pop() if space in room else ([], -(-todo // most))
            if space in room and not room[space]:
                del room[space]
            full = min(repeats, todo // most)
            rest = (todo - full * most) if full < repeats else 0
            for times, n in ((most, full), (rest, 1 if rest else 0), (0, repeats - full - (1 if rest else 0))):
                if n:
                    free = space - times * length
                    (room.setdefault(free, []) if free else out).append((have + [(length, times)] if times else have, n))
            todo -= full * most + rest
    return out + [g for gs in room.values() for g in gs if g[0]]


class Plan:
    """For each length, ranges of piece numbers with the sequences and offsets they go to."""

    def __init__(self, counts: np.ndarray, size: int) -> None:
        rows, taken, first = [], np.zeros(size + 1, np.int64), 0
        for parts, repeats in groups(counts, size):
            offset = 0
            for length, times in parts:
                rows.append((length, taken[length], first, times, offset))
                taken[length] += repeats * times
                offset += length * times
            first += repeats
        if (taken != counts).any():
            raise AssertionError("the plan misses pieces")
        self.sequences = first
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.table = table
        self.at = np.searchsorted(table[:, 0], np.arange(size + 2))

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where = np.zeros(len(length), np.int64)
        for n in np.unique(length):
            a, b = self.at[n], self.at[n + 1]
            of = length == n
            where[of] = a + np.searchsorted(self.table[a:b, 1], number[of], "right") - 1
        row = self.table[where]
        j = number - row[:, 1]
        return row[:, 2] + j // row[:, 3], row[:, 4] + j % row[:, 3] * length


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 [, ids]; only longer documents are cut."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def rows(batches):
        enc = encoder(worker_path(tokenizer))
        for batch in batches:
            for first, flat, at in enc.closed(batch.column(1), end_id):
                n = np.diff(at)
                many = -(-n // size)
                doc = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                head = (n - (many - 1) * size)[doc]
                start = np.where(piece, head + (piece - 1) * size, 0)
                length = np.where(piece, size, head)
                a = at[:-1][doc] + start
                ids = flat.astype("<u4")
                out = {
                    "doc_id": batch.column(0).take(pa.array(first + doc)), "piece": pa.array(piece, pa.int32()), "start": start,
                    "length": length, "ids_crc32": [zlib.crc32(ids[i:j]) for i, j in zip(a.tolist(), (a + length).tolist(), strict=True)],
                }
                if with_ids:  # pieces of a block are its ids in order
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(a, at[-1]), pa.int32()), pa.array(flat.view(np.int32)))
                yield out

    return store.map_arrow(store.texts(docs, "doc_id"), rows, schema)


def pack(items: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` of 1 to `size`.

    The rows are written once with their number among those of their task and length; counts of (task, length) turn that
    into a number among all rows of the length.
    """
    spark = items.sparkSession
    names = items.columns
    from_task = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)

    def numbered(batches):
        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            order = np.argsort(length, kind="stable")
            same = np.bincount(length, minlength=size + 1)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(np.cumsum(same) - same, same)
            yield {c: batch.column(i) for i, c in enumerate(names)} | {"_part": np.full(len(length), part), "_k": rank + seen[length]}
            seen += same

    rows = store.kept(store.map_arrow(items, numbered, f"{from_task}, _part long, _k long"), "pieces")
    of_task = rows.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    window = Window.partitionBy("length").orderBy("_part")
    before = store.kept(of_task.select("_part", "length", "_n", (F.sum("_n").over(window) - F.col("_n")).alias("_before")), "piece-counts")
    counts = np.zeros(size + 1, np.int64)
    for r in before.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most `size` rows
        counts[r["length"]] = r["n"]
    plan = Plan(counts, size)

    def placed(batches):
        for batch in batches:
            length, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (names.index("length"), len(names)))
            sequence, offset = plan.place(length, number)
            yield {c: batch.column(i) for i, c in enumerate(names)} | {"sequence_id": sequence, "offset": offset}

    joined = rows.join(before.drop("_n"), ["_part", "length"]).select(*names, (F.col("_k") + F.col("_before")).alias("_number"))
    return store.map_arrow(joined, placed, f"{from_task}, sequence_id long, offset long")


def packed(spark: SparkSession, docs: DataFrame, size: int = 1024, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places, and with their ids where asked for."""
    return pack(pieces(docs, tokenizer, end_id, size, with_ids), size)

"""Operator 2: token ids as binary files with Elias-Fano document boundaries.

Documents are dealt by ranges of doc_id, so files in (part, shard) order hold ascending ids; each task encodes its texts
and writes shards of bounded size. A shard is one concatenated id array (2 bytes an id when the vocabulary
allows, else 4) and two Elias-Fano sequences: the boundaries of its documents and their ids. A boundary is found
by a select on the upper bits, from one sample for every 256 ones, so no 64-bit offset table is stored.

Defined results: null text is empty (one end id). Rows of equal doc_id stand in order of their text; null ids come
first and read back as null. An empty table writes no file.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .tokens import encoder, worker_path

MAGIC = b"EFTOK1\n\0"
SAMPLE = 256
SHARD_IDS = 4_000_000


class EliasFano:
    """A non-decreasing sequence of n numbers below u in about n * (2 + log2(u / n)) bits."""

    def __init__(self, n: int, base: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.base, self.width, self.low, self.high, self.samples = n, base, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        base = int(values[0]) if n else 0
        v = (values.astype(np.int64) - base).astype(np.uint64)
        u = int(v[-1]) + 1 if n else 1
        width = max(0, (u // max(n, 1)).bit_length() - 1)
        shift = np.arange(width, dtype=np.uint64)
        low = np.packbits((v[:, None] >> shift & np.uint64(1)).astype(np.uint8), bitorder="little")
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, base, width, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """Position of the i-th one of the upper bits: from its sample, byte by byte."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at // 8
        word = int(self.high[byte]) >> at % 8 << at % 8
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def get(self, i: int) -> int:
        first = i * self.width
        bits = np.unpackbits(self.low[first // 8:(first + self.width + 7) // 8], bitorder="little")[first % 8:first % 8 + self.width]
        low = sum(int(b) << k for k, b in enumerate(bits))
        return self.base + ((self.select(i) - i) << self.width | low)

    def slab(self, k: int) -> np.ndarray:
        """Values of the k-th block of SAMPLE numbers: its upper bits lie between two samples, its lower ones at their place."""
        first, last = k * SAMPLE, min(self.n, (k + 1) * SAMPLE)
        begin = int(self.samples[k])
        end = int(self.samples[k + 1]) if k + 1 < len(self.samples) else len(self.high) * 8
        ones = np.flatnonzero(np.unpackbits(self.high[begin // 8:(end + 7) // 8], bitorder="little")) + begin // 8 * 8
        upper = ones[np.searchsorted(ones, begin):][:last - first] - np.arange(first, last)
        low = self.low[first * self.width // 8:(last * self.width + 7) // 8]  # SAMPLE numbers fill whole bytes
        bits = np.unpackbits(low, bitorder="little")[:(last - first) * self.width].reshape(last - first, self.width).astype(np.int64)
        return self.base + ((upper << self.width) | (bits << np.arange(self.width)).sum(1))

    def slabs(self):
        return (self.slab(k) for k in range(len(self.samples)))

    def all(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *self.slabs()])

    def pack(self) -> tuple[dict, list[bytes]]:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]
        return {"n": self.n, "base": self.base, "width": self.width, "bytes": [len(p) for p in parts]}, parts

    @classmethod
    def read(cls, head: dict, raw: memoryview, at: int) -> EliasFano:
        parts = []
        for size, kind in zip(head["bytes"], ("u1", "u1", "<u4"), strict=True):
            parts.append(np.frombuffer(raw[at:at + size], kind))
            at += size
        return cls(head["n"], head["base"], head["width"], *parts)


class TokenFile:
    """A shard read back: `doc(i)` finds one document by select, `offsets()` gives all boundaries."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != MAGIC:
            raise ValueError("not a token file")
        view = memoryview(raw)
        (size,) = struct.unpack_from("<I", raw, 8)
        head = json.loads(raw[12:12 + size])
        at = 12 + size
        self.ids = np.frombuffer(view[at:at + head["ids"] * head["width"]], f"<u{head['width']}")
        at += head["ids"] * head["width"]
        self.ends = EliasFano.read(head["ends"], view, at)
        self.doc_ids = EliasFano.read(head["docs"], view, at + sum(head["ends"]["bytes"]))
        self.nulls = head["nulls"]

    def doc(self, i: int) -> np.ndarray:
        return self.ids[self.ends.get(i - 1) if i else 0:self.ends.get(i)]

    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], self.ends.all()])

    def names(self) -> list[int | None]:
        return [None] * self.nulls + self.doc_ids.all().tolist()


def file_bytes(ids: list[np.ndarray], counts: np.ndarray, doc_ids: np.ndarray, nulls: int, width: int) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    ends, a = EliasFano.of(np.cumsum(counts)).pack()
    docs, b = EliasFano.of(doc_ids).pack()
    head = json.dumps({"ids": len(flat), "width": width, "nulls": nulls, "ends": ends, "docs": docs}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, flat.astype(f"<u{width}").tobytes(), *a, *b])


def write(docs: DataFrame, to: str, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the token files under `to`; returns the written files: part, shard, path, n_docs, n_ids.

    A shard is closed at `shard_ids` ids; only a longer document makes a longer shard.
    """
    ordered = store.texts(docs, "doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def rows(batches):
        enc = encoder(worker_path(tokenizer))
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        width = 2 if len(enc.last) <= 1 << 16 and end_id < 1 << 16 else 4
        done, ids, counts, names = [], [], [], []

        def close():
            size = np.concatenate(counts)
            who = pa.chunked_array(names).combine_chunks()
            path = f"{to}/part-{part:06d}-{len(done):06d}-{attempt}.tok"
            store.put(path, file_bytes(ids, size, who.drop_null().to_numpy(zero_copy_only=False), who.null_count, width))
            done.append((part, len(done), path, len(size), int(size.sum())))
            for x in (ids, counts, names):
                x.clear()

        held = 0
        for batch in batches:
            for first, flat, at in enc.closed(batch.column(1), end_id):
                a = 0
                while a < len(at) - 1:  # whole documents until the shard is full
                    b = max(a + 1, int(np.searchsorted(at, at[a] + shard_ids - held, "right")) - 1)
                    if held and at[b] - at[a] + held > shard_ids:
                        close()
                        held = 0
                        continue
                    ids.append(flat[at[a]:at[b]])
                    counts.append(np.diff(at[a:b + 1]))
                    names.append(batch.column(0).slice(first + a, b - a))
                    held += int(at[b] - at[a])
                    a = b
        if counts:
            close()
        if done:
            yield dict(zip(("part", "shard", "path", "n_docs", "n_ids"), map(list, zip(*done, strict=True)), strict=True))

    return store.kept(store.map_arrow(ordered, rows, "part long, shard long, path string, n_docs long, n_ids long"), "token-files")


def read(files: DataFrame) -> DataFrame:
    """Documents of the files in their order: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    spark = files.sparkSession
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("of_part"))  # a row for each writing task
    before = parts.select("part", (F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    placed = files.withColumn("inside", inside).join(before, "part").select("path", (F.col("before") + F.col("inside")).alias("start"))

    def rows(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, inner = store.filesystem(path)
                with system.open_input_file(inner) as f:
                    shard = TokenFile(f.read())
                ids, last, starts, sizes, sums = shard.ids.astype("<u4"), 0, [], [], []
                for ends in shard.ends.slabs():  # boundaries of a few documents at a time, by their select sample
                    at = np.concatenate([[last], ends])
                    starts.append(start + at[:-1])
                    sizes.append(np.diff(at))
                    sums += [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    last = int(at[-1])
                yield {"doc_id": pa.array(shard.names(), pa.int64()), "start": np.concatenate(starts), "n_tokens": np.concatenate(sizes), "ids_crc32": sums}

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return store.map_arrow(placed.repartition(n), rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    return read(write(docs, store.folder(spark, "tokens"), tokenizer, end_id))

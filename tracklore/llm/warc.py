"""Operator 7: WARC archives, written with revisit records and read back by byte ranges.

Writing: a digest's smallest page_id is found by a grouped minimum, so a digest shared by many pages is no hot group;
each task writes its pages as one gzip member a record into files of bounded size. Reading: files are cut into byte
ranges without regard to records. A task looks for the gzip magic in its range, takes a place as a member only if its
head decodes to a WARC header, owns the records that start inside the range, and reads past its end for the last.

Defined results: null html is an empty payload. Rows that repeat the smallest page_id of a payload are all responses;
a null page_id never is the smallest, and pages of a payload without any page_id are all responses. A payload that is
itself an archive of gzip members is safe as long as the writer compresses it, which hides its inner magic.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES = 16 << 20
RANGE_BYTES = 4 << 20
#: Fixed values of the format.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, first: int | None, date: str) -> bytes:
    """One gzip member: the page as a response, or a revisit of page `first`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = "" if page_id is None else page_id
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {''.join(c if c > ' ' else '%' + format(ord(c), '02X') for c in url)}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http;msgtype=response",
    ]
    if first is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{first}>"]
    body = http if first is not None else http + payload
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"
    return packer.compress(raw) + packer.flush()


def write(pages: DataFrame, to: str, least: int = 0, date: str = "2000-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives under `to`; returns path and bytes of each. Payloads under `least` bytes are never revisits."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    shared = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    marked = rows.join(shared.select("digest", "first"), "digest", "left").select("page_id", "url", "html", "first")

    def run(batches):
        context = TaskContext.get()
        done, held, size = [], [], 0

        def close():
            path = f"{to}/part-{context.partitionId():06d}-{len(done):06d}-{context.taskAttemptId()}.warc.gz"
            store.put(path, b"".join(held))
            done.append((path, size))

        for batch in batches:
            for page_id, url, text, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(page_id, url, text.encode(), None if first == page_id else first, date))
                size += len(held[-1])
                if size >= file_bytes:
                    close()
                    held, size = [], 0
        if held:
            close()
        if done:
            yield {"path": [p for p, _ in done], "bytes": [n for _, n in done]}

    return store.kept(store.map_arrow(marked, run, "path string, bytes long"), "warc-files")


def parse(raw: bytes) -> dict:
    """Headers (lower-case names) and block of one decoded record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    fields["block"] = rest[:int(fields["content-length"])]
    return fields


class Reader:
    """Bytes of one open file from `at` on, read as they are needed."""

    def __init__(self, source, at: int, size: int, step: int = 1 << 20) -> None:
        self.source, self.first, self.size, self.step, self.data = source, at, size, step, b""

    def upto(self, end: int) -> None:
        end = min(end, self.size)
        have = self.first + len(self.data)
        if end > have:
            self.source.seek(have)
            self.data += self.source.read(max(end - have, min(self.step, self.size - have)))
            if self.first + len(self.data) < end:
                raise EOFError(f"the archive ends before byte {end}")

    def drop(self, at: int) -> None:
        self.data = self.data[at - self.first:]
        self.first = at


def member(reader: Reader, at: int) -> tuple[bytes, int] | None:
    """The record of the gzip member at `at` and the place behind it; None if no WARC record starts there."""
    reader.upto(at + 4096)
    packer, out = zlib.decompressobj(31), []
    try:
        out.append(packer.decompress(reader.data[at - reader.first:at - reader.first + 4096]))
        if not out[0].startswith(b"WARC/1."):
            return None
        used = at + 4096
        while not packer.eof:
            if used >= reader.size:
                return None
            reader.upto(used + reader.step)
            part = reader.data[used - reader.first:used - reader.first + reader.step]
            out.append(packer.decompress(part))
            used += len(part)
        return b"".join(out), min(used, reader.size) - len(packer.unused_data)
    except zlib.error:
        return None


def records(source, start: int, end: int, size: int):
    """Records of an archive of `size` bytes whose members start in start..end-1."""
    reader, at = Reader(source, start, size), start
    while at < end:
        reader.upto(min(end + 2, at + reader.step))
        stop = min(end + 2, reader.first + len(reader.data))
        hit = reader.data.find(MAGIC, at - reader.first, stop - reader.first)
        if hit < 0:
            if stop >= min(end + 2, size):
                return
            at = stop - 2
            reader.drop(at)
            continue
        at = reader.first + hit
        found = member(reader, at)
        if found is None:
            at += 1
            continue
        yield found[0]
        at = found[1]
        reader.drop(at)


def read(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for revisits) of all records."""
    spark = files.sparkSession
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    number = lambda urn: int(urn[10:-1]) if urn and urn[10:-1] else None

    def run(batches):
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, inner = store.filesystem(path)
                with system.open_input_file(inner) as source:
                    held: list[dict] = []
                    for raw in records(source, start, min(start + range_bytes, size), size):
                        r = parse(raw)
                        http, _, payload = r["block"].partition(b"\r\n\r\n")
                        full = r["warc-type"] == "response"
                        length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        held.append({
                            "page_id": number(r["warc-record-id"]), "url": r["warc-target-uri"], "record_type": r["warc-type"],
                            "refers_to": number(r.get("warc-refers-to")), "payload_bytes": len(payload) if full else length,
                            "payload_digest": base32_sha1(payload) if full else r["warc-payload-digest"].removeprefix("sha1:"),
                            "payload": payload if full else None,
                        })
                        if len(held) >= 500:
                            yield columns(held)
                            held = []
                    if held:
                        yield columns(held)

    def columns(held):
        kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        return {k: pa.array([h[k] for h in held], kinds.get(k, pa.string())) for k in held[0]}

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    return store.map_arrow(ranges.repartition(n), run, schema)


def archives(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Digest of the records read back from archives of all pages."""
    found = read(write(pages, store.folder(spark, "warc"), least))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

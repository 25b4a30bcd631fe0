"""Operator 1: exact substring removal by interval expansion on Burrows-Wheeler transforms.

Every window of `length` bytes is named by its smallest `GRAM`-byte hash, so equal windows meet under one key wherever they
stand. Consecutive windows with the same key at the same place are one fragment (less than 2 * `length` bytes). Keys that
occur once are dropped by counting; equal fragments become one row with a weight. A task takes whole keys in
batches of bounded size, builds one suffix order and its transform, and expands intervals breadth-first by backward
extension: level l sets all common prefixes of l bytes, so after `length` levels the places not set are prefixes of
`length` bytes or more, which is as far as they are needed. Windows in such a class of weight two are removed.

A key with too many different fragments is split: windows are regrouped by their distance from the key's place, in ever
narrower strips, and by the text common to a strip. In a strip of width one a group is a single window, so
the split always ends, and no group is taken whole by its frequency.

Defined results: null text is empty; texts shorter than `length` lose nothing; rows of equal doc_id are documents of
their own, and repeated rows are copies of each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import textbytes as tb
from .tokens import spread

LENGTH, GRAM = 400, 32
BATCH = 1 << 20  # bytes of one transform
GROUP = 1000  # fragments of a key that stay together
STRIPS = (48, 6, 1)
_SALT = np.uint64(0xA24BAED4963EE407)


def anchors(b: tb.Block, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fragments of a block: text, first byte in it, windows, key, place of the key from the first byte."""
    n, gram = len(b.data), min(GRAM, length)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    sums = tb.prefix(b.data, False)
    first = np.arange(n - gram + 1)
    h = tb.span_hash(sums, first, first + gram)
    low = tb.window_argmin(h, length - gram + 1)
    place = np.arange(len(low))
    inside = np.repeat(b.at[1:], np.diff(b.at))[:len(low)] - place >= length
    new = inside.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~inside[:-1]
    start = np.flatnonzero(new)
    many = np.bincount((np.cumsum(new) - 1)[inside], minlength=len(start))
    text = np.searchsorted(b.at, start, "right") - 1
    return text, start - b.at[text], many, h[low[start]], low[start] - start


def packed(text: np.ndarray, k: int) -> np.ndarray:
    """The k symbols (at most seven, below 512) from each place on as one number."""
    wide = np.concatenate([text, np.zeros(k, text.dtype)]).astype(np.uint64)
    key = np.zeros(len(text), np.uint64)
    for i in range(k):
        key = key << np.uint64(9) | wide[i:len(text) + i]
    return key


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of symbols below 512 in the order of their first `depth` symbols or more, by prefix doubling."""
    n = len(text)
    key = packed(text, 7)
    order = np.argsort(key)
    new = np.ones(n + 1, bool)
    new[1:n] = key[order[1:]] != key[order[:-1]]
    rank = np.zeros(n + depth, np.int64)
    rank[order] = np.cumsum(new[:n])
    have = 7
    while have < depth:
        open_ = np.flatnonzero(~(new[:-1] & new[1:]))  # places in groups of more than one
        if not len(open_):
            break
        suffix = order[open_]
        key = (rank[suffix] << 32) | rank[suffix + have]
        by = np.argsort(key)
        order[open_], key = suffix[by], key[by]
        cut = np.ones(len(open_), bool)
        cut[1:] = key[1:] != key[:-1]
        new[open_] |= cut
        first = np.maximum.accumulate(np.where(new[:n], np.arange(n), 0))
        rank[order] = first + 1
        have *= 2
    return order


def classes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each place in it the number of its class of suffixes with `length` equal symbols.

    Breadth-first backward extension: an interval of suffixes that begin with some string gives, for each symbol before
    them, the interval of the longer string. The first time a border is met, the common prefix across it
    is one shorter than the string; intervals that meet no new border are not taken further. Letters of the transform are
    runs of k symbols, with k the largest divisor of `length` up to seven, so prefixes grow by k at a time.
    """
    k = max(d for d in range(1, 8) if length % d == 0)
    n = len(text)
    order = suffix_order(text, length)
    letter = packed(text, k)
    before = letter[order - k]
    back = np.empty(n, np.int32)  # backward step of each place
    back[np.argsort(before, kind="stable")] = np.arange(n, dtype=np.int32)
    start = np.ones(n, bool)  # where another first letter begins
    start[1:] = letter[order[1:]] != letter[order[:-1]]
    border = np.zeros(n + 1, bool)
    border[0] = border[n] = True
    mark = np.full(n, -1, np.int32)
    low, high = np.zeros(1, np.int32), np.full(1, n, np.int32)
    alone = np.zeros(0, np.int32)  # intervals of one suffix
    for _ in range(length // k):
        to = back[spread(low, high - low)]
        source = np.repeat(np.arange(len(low), dtype=np.int32), high - low)
        if len(to) * 16 > n:  # in order by scattering
            mark[to] = source
            to = np.flatnonzero(mark >= 0).astype(np.int32)
            source = mark[to]
            mark[to] = -1
        else:
            by = np.argsort(to)
            to, source = to[by], source[by]
        first = start[to]
        first[:1] = True
        first[1:] |= (source[1:] != source[:-1]) | (to[1:] != to[:-1] + 1)
        at = np.flatnonzero(first)
        low, high = to[at], to[np.append(at[1:], len(to)) - 1] + 1 if len(to) else to
        alone = back[alone]
        new, fresh = ~(border[low] & border[high]), ~(border[alone] & border[alone + 1])
        border[low] = border[high] = border[alone] = border[alone + 1] = True
        low, high = low[new], high[new]
        one = high - low == 1
        alone = np.concatenate([alone[fresh], low[one]])
        low, high = low[~one], high[~one]
        if not len(low) and not len(alone):
            break
    return order, np.cumsum(border[:n]) - 1


def repeated(fragments: list[bytes], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each fragment, which of its windows occur in fragments of a total weight of two or more."""
    sizes = np.array([len(f) for f in fragments])
    raw = np.frombuffer(b"\0".join(fragments) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    first = np.cumsum(sizes + 1) - sizes - 1
    raw[first + sizes] = 0
    order, kind = classes(raw, length)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    weight = np.bincount(kind, weights[owner[order]])
    twice = np.empty(len(raw), bool)
    twice[order] = weight[kind] >= 2
    return [twice[a:a + n - length + 1] for a, n in zip(first.tolist(), sizes.tolist(), strict=True)]


def live(fragments: list[bytes], key: np.ndarray, place: np.ndarray, weights: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Runs (fragment, first window, window behind) that can be repeated.

    Windows at nearly the same distance before the key share the text around it; where that text occurs once under
    the key, none of them is repeated.
    """
    width = max(1, length // 8)
    sizes = np.array([len(f) for f in fragments])
    first = np.cumsum(sizes) - sizes
    sums = tb.prefix(np.frombuffer(b"".join(fragments), np.uint8), False)
    low, high = (place - (sizes - length)) // width, place // width  # strips of distance
    owner = np.repeat(np.arange(len(sizes)), high - low + 1)
    strip = spread(low, high - low + 1)
    at = first[owner] + place[owner]
    core = tb.span_hash(sums, at - strip * width, at - (strip + 1) * width + 1 + length)
    name = tb.mix(core + key.astype(np.int64).view(np.uint64)[owner] * _SALT + strip.astype(np.uint64))
    _, same = np.unique(name, return_inverse=True)
    good = np.bincount(same, weights[owner])[same] >= 2
    owner, strip = owner[good], strip[good]
    a = np.maximum(place[owner] - (strip + 1) * width + 1, 0)
    z = np.minimum(place[owner] - strip * width, sizes[owner] - length) + 1
    by = np.lexsort((a, owner))
    owner, a, z = owner[by], a[by], z[by]
    new = np.ones(len(a), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (a[1:] > z[:-1])
    head = np.flatnonzero(new)
    return list(zip(owner[head].tolist(), a[head].tolist(), z[np.append(head[1:], len(a)) - 1].tolist(), strict=True)) if len(a) else []


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def transformed(parts: DataFrame, length: int) -> DataFrame:
    """key, name, low, high: ranges of repeated windows of the fragments (key, name, weight, place, fragment), whole keys together."""

    def solve(rows):
        """Rows of whole keys, sorted by key; a key of a single fragment is decided by its weight."""
        same = np.array([r[0] for r in rows])
        alone = np.ones(len(rows), bool)
        alone[1:] &= same[1:] != same[:-1]
        alone[:-1] &= same[1:] != same[:-1]
        out = [(k, m, 0, len(f) - length + 1) for (k, m, w, _, f), one in zip(rows, alone, strict=True) if one and w > 1]
        several = [r for r, one in zip(rows, alone, strict=True) if not one]
        if several:
            weights = np.array([min(r[2], 2) for r in several])
            runs = live([r[4] for r in several], np.array([r[0] for r in several]), np.array([r[3] for r in several]), weights, length)
            parts = [several[i][4][a:z - 1 + length] for i, a, z in runs]
            for (i, low, _), flags in zip(runs, repeated(parts, weights[[i for i, _, _ in runs]], length) if runs else (), strict=True):
                out += [(several[i][0], several[i][1], low + a, low + z) for a, z in _ranges(flags)]
        return {c: pa.array(v, t) for c, v, t in zip(("key", "name", "low", "high"), zip(*out, strict=True) if out else ((),) * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)}

    def rows(batches):
        held, size, done = [], 0, 0  # the first `done` rows are whole keys
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[-1][0]:
                    done = len(held)
                    if size >= BATCH:
                        yield solve(held)
                        held, size, done = [], 0, 0
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    ordered = parts.select("key", "name", "weight", "place", "fragment").repartition("key").sortWithinPartitions("key")
    return store.map_arrow(ordered, rows, "key long, name long, low int, high int")


def strips(parts: DataFrame, width: int, length: int) -> DataFrame:
    """Pieces of fragments in strips: key0, name0 and shift of the fragment, and the piece as key, name, weight, place, fragment."""

    def rows(batches):
        for batch in batches:
            out = []
            for key, name, weight, place, fragment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(fragment, np.uint8)
                sums = tb.prefix(data, False)
                distance = place - np.arange(len(data) - length + 1)  # of the key from each window
                strip = distance // width
                at = np.append(np.flatnonzero(np.diff(strip, prepend=strip[0] + 1)), len(strip))
                for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    q = int(strip[a])
                    core = np.array([place - q * width]), np.array([place - (q + 1) * width + 1 + length])
                    own = np.uint64((key + q * 0x9FB21C651E98DF25) % (1 << 64))
                    own = tb.mix(tb.span_hash(sums, *core) + own * _SALT).view(np.int64)[0]
                    named = tb.span_hash(sums, np.array([a]), np.array([z - 1 + length])).view(np.int64)[0]
                    out.append((key, name, a, own, named, weight, place - a, fragment[a:z - 1 + length]))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield {c: pa.array(v, t) for c, v, t in zip(("key0", "name0", "shift", "key", "name", "weight", "place", "fragment"), zip(*out, strict=True) if out else ((),) * 8, kinds, strict=True)}

    given = parts.select("key", "name", "weight", "place", "fragment")
    return store.map_arrow(given, rows, "key0 long, name0 long, shift int, key long, name long, weight long, place int, fragment binary")


def merged(parts: DataFrame) -> DataFrame:
    """Equal fragments as one row with their weights added."""
    return parts.groupBy("key", "name").agg(F.sum("weight").alias("weight"), F.first("place", True).alias("place"), F.first("fragment", True).alias("fragment"))


def resolved(parts: DataFrame, length: int, widths: tuple[int, ...], group: int) -> DataFrame:
    """Repeated ranges of all fragments: keys of up to `group` fragments at once, others by strips."""
    parts = store.kept(parts, "fragments")
    heavy = parts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > group).select("key") if widths else None
    if heavy is None or (heavy := store.kept(heavy, "heavy-keys")).isEmpty():
        return store.kept(transformed(parts, length), "ranges")
    light = store.kept(transformed(parts.join(heavy, "key", "left_anti"), length), "ranges")
    pieces = store.kept(strips(parts.join(heavy, "key"), widths[0], length), "strips")
    found = resolved(merged(pieces), length, widths[1:], group)
    back = pieces.select("key0", "name0", "shift", "key", "name").join(found, ["key", "name"])
    return light.unionByName(back.select(F.col("key0").alias("key"), F.col("name0").alias("name"), (F.col("low") + F.col("shift")).alias("low"), (F.col("high") + F.col("shift")).alias("high")))


def spans(docs: DataFrame, length: int, widths: tuple[int, ...] = STRIPS, group: int = GROUP) -> DataFrame:
    """uid, low, high: byte ranges to remove of the rows (uid, text)."""

    def cut(batches):
        for batch in batches:
            for b in tb.blocks(batch.column(1)):
                text, start, many, key, _ = anchors(b, length)
                yield {"uid": batch.column(0).take(pa.array(b.first + text)), "start": start.astype(np.int32), "key": key.view(np.int64)}

    runs = store.kept(store.map_arrow(docs, cut, "uid long, start int, key long"), "runs")
    often = runs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    wanted = runs.join(often, "key").groupBy("uid").agg(F.collect_set("start").alias("starts"))
    chosen = docs.join(store.kept(wanted, "wanted-runs"), "uid").select("uid", "text", "starts")

    def fragments(batches):
        for batch in batches:
            for b in tb.blocks(batch.column(1)):
                text, start, many, key, place = anchors(b, length)
                offsets = batch.column(2).offsets.to_numpy()
                own = batch.column(2).values.to_numpy(zero_copy_only=False)[offsets[b.first]:offsets[b.first + b.n]].astype(np.int64)
                of = np.repeat(np.arange(b.n), np.diff(offsets[b.first:b.first + b.n + 1]))
                hit = np.isin(b.at[text] + start, b.at[of] + own)
                text, start, many, key, place = (x[hit] for x in (text, start, many, key, place))
                a = b.at[text] + start
                name = tb.span_hash(tb.prefix(b.data, False), a, a + many - 1 + length)
                _, once = np.unique(name + key * _SALT, return_index=True)
                raw, first = b.data.tobytes(), np.zeros(len(a), bool)
                first[once] = True
                yield {
                    "uid": batch.column(0).take(pa.array(b.first + text)), "start": start.astype(np.int32), "key": key.view(np.int64),
                    "name": name.view(np.int64), "place": place.astype(np.int32),
                    "fragment": pa.array([raw[x:y] if f else None for x, y, f in zip(a.tolist(), (a + many - 1 + length).tolist(), first.tolist(), strict=True)], pa.binary()),
                }

    placed = store.kept(store.map_arrow(chosen, fragments, "uid long, start int, key long, name long, place int, fragment binary"), "occurrences")
    found = resolved(merged(placed.withColumn("weight", F.lit(1).cast("long"))), length, widths, group)
    hits = placed.select("uid", "start", "key", "name").join(found, ["key", "name"])
    return hits.select("uid", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high") - 1 + length).alias("high"))


def union(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the ranges."""
    by = np.argsort(low, kind="stable")
    low, high = low[by], np.maximum.accumulate(high[by])
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > high[:-1]
    at = np.flatnonzero(new)
    return low[at], high[np.append(at[1:], len(low)) - 1] if len(at) else high


def deduplicated(docs: DataFrame, length: int = LENGTH, with_text: bool = False, widths: tuple[int, ...] = STRIPS, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document [, kept: the remaining bytes]."""
    given = store.texts(docs, "doc_id").select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), "text")
    found = spans(given.select("uid", "text"), length, widths, group).groupBy(F.col("uid").alias("_uid")).agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    joined = given.join(found, given["uid"] == F.col("_uid"), "left").select("doc_id", "text", "ranges")

    def rows(batches):
        for batch in batches:
            ranges = batch.column(2)
            low, high = (ranges.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            offsets, there = ranges.offsets.to_numpy(), ranges.is_valid().to_numpy(zero_copy_only=False)
            data, at = tb.buffers(batch.column(1))
            removed, spans_of, sha, kept = [], [], [], []
            for i in range(batch.num_rows):
                raw = data[at[i]:at[i + 1]]
                a = z = np.zeros(0, np.int64)
                if there[i]:
                    a, z = union(low[offsets[i]:offsets[i + 1]], high[offsets[i]:offsets[i + 1]])
                    edges = np.concatenate([[0], np.column_stack([a, z]).ravel(), [len(raw)]])
                    raw = np.concatenate([raw[x:y] for x, y in edges.reshape(-1, 2).tolist()])
                removed.append(int((z - a).sum()))
                spans_of.append(len(a))
                body = raw.tobytes()
                sha.append(hashlib.sha256(body).hexdigest())
                kept.append(body)
            out = {"doc_id": batch.column(0), "n_bytes": np.diff(at), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans_of, pa.int64()), "kept_sha256": sha}
            yield out | ({"kept": pa.array(kept, pa.binary())} if with_text else {})

    return store.map_arrow(joined, rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)

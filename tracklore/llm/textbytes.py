"""Vector code on the UTF-8 bytes of many texts at once: pieces of bounded size, words, 64-bit hashes.

A block is a run of whole texts: one byte array and the offset of each text in it. A block has about `BLOCK` bytes,
more only where a single text is longer, so that a task's memory follows its longest text and not its input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_R = 0x9E3779B97F4A7C15 | 1
_FIELD = (1 << 61) - 1  # spans are hashed as polynomials over this prime field, so no text is built to collide
_BASE = 0x11C7A3D5E49B2F63 % _FIELD
_PIECE = 1 << 20  # powers that are tabled
_STEP = 1 << 14  # places worked on at a time, inside the processor's cache
_LOWER = np.arange(256)
_LOWER[65:91] += 32


@dataclass
class Block:
    first: int  # row of the first text in its batch
    data: np.ndarray  # uint8
    at: np.ndarray  # int64, one more than texts

    @property
    def n(self) -> int:
        return len(self.at) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.at[i]:self.at[i + 1]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[Block]:
    if not len(column):
        return
    data, at = buffers(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield Block(first, data[at[first]:at[last]], at[first:last + 1] - at[first])
        first = last


_P, _M31, _M30 = np.uint64(_FIELD), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_B1, _B30, _B31, _B61 = (np.uint64(k) for k in (1, 30, 31, 61))


def reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**64 in the field."""
    x = (x & _P) + (x >> _B61)
    x -= _P * (x >= _P)
    return x


def times(a, b) -> np.ndarray:
    """Products in the field, by halves of 31 bits."""
    a1, a0, b1, b0 = a >> _B31, a & _M31, b >> _B31, b & _M31
    mid = a1 * b0 + a0 * b1
    return reduced((a1 * b1 << _B1) + (mid >> _B30) + ((mid & _M30) << _B31) + a0 * b0)


@lru_cache(2)
def powers(base: int) -> np.ndarray:
    """Powers 0.._PIECE - 1 of a field element."""
    out = np.ones(_PIECE, np.uint64)
    have = 1
    while have < _PIECE:
        n = min(have, _STEP)
        out[have:have + n] = times(out[:n], np.uint64(pow(base, have, _FIELD)))
        have += n
    return out


def prefix(data: np.ndarray, fold: bool) -> np.ndarray:
    """Prefix sums of the polynomial of the bytes, one more than bytes; `fold` reads A-Z as a-z."""
    out = np.zeros(len(data) + 1, np.uint64)
    power = powers(_BASE)
    values = ((_LOWER if fold else np.arange(256)) + 1).astype(np.uint64)
    for first in range(0, len(data), _STEP):
        at = first % _PIECE
        value = values[data[first:first + _STEP]]
        p = power[at:at + len(value)]
        high, low = np.cumsum(value * (p >> _B31)), np.cumsum(value * (p & _M31))  # below 2**60
        own = reduced(((high & _M30) << _B31) + (high >> _B30) + low)
        if first >= _PIECE:
            own = times(own, np.uint64(pow(_BASE, first - at, _FIELD)))
        out[first + 1:first + 1 + len(own)] = reduced(own + out[first])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal spans have equal hashes wherever they stand."""
    back = pow(_BASE, -1, _FIELD)
    near = powers(back)
    far = np.array([pow(back, first, _FIELD) for first in range(0, len(sums), _PIECE)], np.uint64)
    out = np.empty(len(start), np.uint64)
    for i in range(0, len(start), _STEP):
        a, z = start[i:i + _STEP], end[i:i + _STEP]
        value = times(reduced(sums[z] + (_P - sums[a])), near[a % _PIECE])
        if len(far) > 1:
            value = times(value, far[a // _PIECE])
        out[i:i + _STEP] = mix(value + (z - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Look-up table: True for the bytes that are in no given range."""
    out = np.ones(256, bool)
    for a, b in ranges:
        out[a:b + 1] = False
    return out


#: What separates words in the two definitions used.
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
LETTERS = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def words(block: Block, kind: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of the first word of each text (one more than texts).

    Words never cross texts. With `fold`, A-Z count as their lower-case letters.
    """
    inside = (kind | _UPPER if fold else kind)[block.data]
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[block.at] = True
    start = inside.copy()
    end = inside.copy()
    if n:
        start[1:] &= ~inside[:-1] | edge[1:n]
        end[:-1] &= ~inside[1:] | edge[1:n]
    a = np.flatnonzero(start)
    b = np.flatnonzero(end) + 1
    return a, b, np.searchsorted(a, block.at)


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive hashes (empty if there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out + h[i:i + n]) * np.uint64(_R)
    return mix(out)


_PLACE = np.uint64((1 << 28) - 1)


def window_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the minimum of each run of w hashes, by their upper 36 bits and then the leftmost."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if len(h) > int(_PLACE):
        raise ValueError("a text of more than 2**28 places")
    low = h & ~_PLACE | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have * 2 <= w:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < w:
        low = np.minimum(low[:n], low[w - have:w - have + n])
    return (low & _PLACE).astype(np.int64)


def lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))

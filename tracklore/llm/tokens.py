"""Token ids of many texts: each distinct piece of text is encoded once by the tokenizers library and looked up afterwards.

A text is cut where no token of the byte-level or word tokenizers can cross: before white space that follows other
characters, and between an ASCII letter and one of `.,!?;:`. Pieces are named by a 64-bit hash, so that
splitting and looking up is vector code; the library sees only pieces that the table doesn't hold.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from . import textbytes as tb

LIMIT = 600_000  # pieces in the table; past it only those of the last block stay
SLICE = 4_096  # pieces that the library sees at once: it holds some hundred bytes for each token
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,!?;:"]] = True
_ODD = np.zeros(256, bool)  # separators on which the libraries' notions of white space differ
_ODD[0x1C:0x20] = True
_PLAIN = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ÿ]+")


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        # How plain words joined by newlines are told apart again: by the newline's own id, or by the ids that end words.
        vocab = self.lib.get_vocab()
        self.newline, self.last = vocab.get("\u010a"), np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        if self.last.any():
            self.newline = None
        self._reset()

    def _reset(self) -> None:
        self.names = np.zeros(0, np.uint64)  # sorted
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _one_by_one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.lib.encode_batch_fast(pieces, add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int32, len(found))
        return count, np.fromiter((i for ids in found for i in ids), np.uint32, int(count.sum()))

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not pieces or not self.last.any() and self.newline is None:
            return self._one_by_one(pieces)
        ids = np.array(self.lib.encode_batch_fast(["\n".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        if self.newline is None:
            end = np.flatnonzero(self.last[ids]) + 1
            gone = np.zeros(0, np.int64)
        else:
            gone = np.flatnonzero(ids == self.newline)
            end = np.append(gone - np.arange(len(gone)), len(ids) - len(gone))
        if len(end) != len(pieces):
            return self._one_by_one(pieces)
        return np.diff(end, prepend=0).astype(np.int32), np.delete(ids, gone)

    def _add(self, names: np.ndarray, pieces: list[str]) -> None:
        """Encode new pieces (their names sorted) and merge them into the table."""
        plain = np.fromiter((_PLAIN.fullmatch(p) is not None for p in pieces), bool, len(pieces))
        a, x = _sliced(self._joined, [p for p, is_plain in zip(pieces, plain, strict=True) if is_plain])
        b, y = _sliced(self._one_by_one, [p for p, is_plain in zip(pieces, plain, strict=True) if not is_plain])
        count, begin = np.zeros(len(pieces), np.int32), np.zeros(len(pieces), np.int64)
        count[plain], count[~plain] = a, b
        begin[plain] = np.cumsum(a) - a
        begin[~plain] = len(x) + np.cumsum(b) - b
        begin += len(self.ids)
        self.ids = np.concatenate([self.ids, x, y])
        at = np.searchsorted(self.names, names)
        self.names = np.insert(self.names, at, names)
        self.begin = np.insert(self.begin, at, begin)
        self.count = np.insert(self.count, at, count)

    def _shrink(self, keep: np.ndarray) -> None:
        self.names, begin, self.count = self.names[keep], self.begin[keep], self.count[keep]
        self.ids = self.ids[spread(begin, self.count)]
        self.begin = np.cumsum(self.count, dtype=np.int64) - self.count

    def block(self, b: tb.Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's texts and the number of the first id of each text."""
        data, n = b.data, len(b.data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(b.n + 1, np.int64)
        space = _SPACE[data]
        cut = np.zeros(n, bool)
        cut[1:] = space[1:] & ~space[:-1] | _LETTER[data[:-1]] & _STOP[data[1:]]
        odd = _ODD[data]
        if odd.any():  # such a text is one piece
            for i in np.unique(np.searchsorted(b.at, np.flatnonzero(odd), "right") - 1):
                cut[b.at[i]:b.at[i + 1]] = False
        cut[b.at[:-1][b.at[:-1] < b.at[1:]]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        name = tb.span_hash(tb.prefix(data, False), start, end)
        distinct, first, back = np.unique(name, return_index=True, return_inverse=True)
        at = np.searchsorted(self.names, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.names)
        new[inside] = self.names[at[inside]] != distinct[inside]
        if new.any():
            raw, f = data.tobytes(), first[new]
            self._add(distinct[new], [raw[x:y].decode() for x, y in zip(start[f].tolist(), end[f].tolist(), strict=True)])
            at = np.searchsorted(self.names, distinct)
        count = self.count[at][back]
        ids = self.ids[spread(self.begin[at][back], count)]
        sums = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, dtype=np.int64, out=sums[1:])
        if len(self.names) > LIMIT:
            self._shrink(at)
        return ids, sums[np.searchsorted(start, b.at)]

    def closed(self, column: pa.Array, end_id: int):
        """For each block of a column: the first row, all ids with `end_id` after each text, and the texts' offsets."""
        for b in tb.blocks(column):
            ids, at = self.block(b)
            yield b.first, np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))


def _sliced(encode, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and ids of all pieces, encoded some at a time."""
    found = [encode(pieces[i:i + SLICE]) for i in range(0, max(1, len(pieces)), SLICE)]
    return np.concatenate([count for count, _ in found]), np.concatenate([ids for _, ids in found])


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... (count[0] numbers), begin[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    jump = np.repeat(begin - (np.cumsum(count) - count), count)
    return jump + np.arange(total)


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker."""
    if path not in _made:
        _made.clear()
        _made[path] = Encoder(path)
    return _made[path]


def worker_path(path: str) -> str:
    """A tokenizer file by its path, or by its bare name in the installed package."""
    if os.path.sep in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)

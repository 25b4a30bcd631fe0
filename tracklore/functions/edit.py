"""Arrow UDFs on token pairs: edit operations and common subsequences.

The two dynamic programs below cannot be said with built-in expressions; one
row in, one row out, so partitioning is left to Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPS = T.StructType([T.StructField(n, T.LongType()) for n in ("s", "d", "i")])


def edit_counts(ref: list, hyp: list) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of one shortest edit script.

    Equal tokens always pair up; otherwise substitution wins over deletion over
    insertion.  Costs and counts move forward row by row, so memory is one row.
    """
    m = len(hyp)
    codes: dict = {}
    h = np.array([codes.setdefault(t, len(codes)) for t in hyp], dtype=np.int64)
    pos = np.arange(m + 1)
    cost = pos.copy()
    subs = np.zeros(m + 1, dtype=np.int64)
    dels = np.zeros(m + 1, dtype=np.int64)
    for i, token in enumerate(ref, 1):
        same = np.concatenate(([False], h == codes.get(token, -1)))
        up = cost + 1
        diag = np.concatenate(([i], cost[:-1] + ~same[1:]))
        # cheapest way into each cell without an insertion, equal tokens forced
        direct = np.where(same, diag, np.minimum(diag, up))
        direct[0] = i
        # an insertion run starts at the cell with the lowest cost minus column;
        # a pairing cell never extends a run
        best = np.minimum.accumulate(direct - pos) + pos
        insert = (best < direct) & ~same
        insert[0] = False
        origin = np.maximum.accumulate(np.where(insert, -1, pos))
        use_diag = same | (diag <= up)
        use_diag[0] = False
        prev_s = np.concatenate(([0], subs[:-1]))
        prev_d = np.concatenate(([0], dels[:-1]))
        s = np.where(use_diag, prev_s + ~same, subs)
        d = np.where(use_diag, prev_d, dels + 1)
        subs, dels = s[origin], d[origin]
        cost = np.where(insert, best, direct)
    s, d = int(subs[m]), int(dels[m])
    return s, d, m - len(ref) + d


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, one bit per token of ``a``."""
    full = (1 << len(a)) - 1
    masks: dict = {}
    for i, t in enumerate(a):
        masks[t] = masks.get(t, 0) | (1 << i)
    v = full
    for t in b:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@F.pandas_udf(_OPS)
def edit_ops(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    rows = [edit_counts(list(r), list(h)) for r, h in zip(ref, hyp)]
    return pd.DataFrame(rows, columns=["s", "d", "i"], dtype="int64")


@F.pandas_udf(T.LongType())
def lcs_len(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(r), list(h)) for r, h in zip(ref, hyp)], dtype="int64")


# fixed values: handshapes that are easily taken for one another, and short forms with the words they stand for
CONFUSION_GROUPS = (
    {"M", "N", "T", "S", "A", "E"},
    {"U", "V", "R", "W", "K"},
    {"D", "L", "I", "J", "Z", "1"},
    {"C", "O", "B"},
    {"G", "H", "P", "Q"},
)
SHORT_FORMS = {("u", "you"), ("r", "are"), ("ur", "your")}
_GROUP = np.zeros(128, np.int8)
for _n, _group in enumerate(CONFUSION_GROUPS, 1):
    for _letter in _group:
        _GROUP[ord(_letter.lower())] = _n


def _codes(words: list[str], width: int) -> np.ndarray:
    return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), width)


def _together(typed: list[str], words: list[str]) -> np.ndarray:
    """One table of costs for all pairs, each cell a vector over the pairs; a pair reads its own last cell."""
    n, m = (np.array([len(x) for x in side]) for side in (typed, words))
    s, w = _codes(typed, max(int(n.max()), 1)), _codes(words, max(int(m.max()), 1))
    of_s, of_w = (np.where(x < 128, _GROUP[np.minimum(x, 127)], 0) for x in (s, w))
    row = np.tile(np.arange(w.shape[1] + 1.0)[:, None], (1, len(n)))
    out = np.where(n == 0, m.astype(float), 0.0)
    last_e = np.zeros(w.shape, bool)
    ends = m > 0
    last_e[ends, m[ends] - 1] = w[ends, m[ends] - 1] == ord("e")
    for i in range(s.shape[1]):
        a = s[:, i]
        drop = np.where(s[:, i - 1] == a, 0.20, 1.0) if i else np.ones(len(n))
        new = np.empty_like(row)
        new[0] = i + 1
        for j in range(w.shape[1]):
            b = w[:, j]
            doubled = (w[:, j - 1] == b) & (a != b) if j else np.zeros(len(n), bool)
            add = np.where(doubled | last_e[:, j], 0.15, 1.0)
            swap = np.where(a == b, 0.0, np.where((of_s[:, i] == of_w[:, j]) & (of_s[:, i] > 0), 0.35, 1.0))
            new[j + 1] = np.minimum(np.minimum(row[j + 1] + drop, new[j] + add), row[j] + swap)
        row = new
        done = n == i + 1
        out[done] = row[m[done], np.flatnonzero(done)]
    return out


def spelling_costs(typed: list[str], words: list[str], cells: int = 1 << 21) -> np.ndarray:
    """Edit cost of fingerspelling of many pairs: alike handshapes, lost doubles and a lost final 'e' are cheap, and so
    is deleting a repeat.  Equal pairs are computed once, pairs of like lengths together, at most `cells` cells of a row of the
    tables at a time."""
    pairs = [(a.strip().lower(), b.strip().lower()) for a, b in zip(typed, words)]
    cost = dict.fromkeys(pairs, 0.0)
    for pair in cost.keys() & SHORT_FORMS:
        cost[pair] = 0.1
    classes: dict = {}
    for a, b in cost:
        if a != b and (a, b) not in SHORT_FORMS:
            classes.setdefault((-(-len(a) // 4), -(-len(b) // 4)), []).append((a, b))
    for (_, long), some in classes.items():
        step = max(1, cells // (4 * long + 1))
        for first in range(0, len(some), step):
            part = some[first:first + step]
            cost.update(zip(part, _together([a for a, _ in part], [b for _, b in part]).tolist()))
    return np.array([cost[p] for p in pairs], dtype=float)


def spelling_cost(typed: str, word: str) -> float:
    return float(spelling_costs([typed], [word])[0])


@F.pandas_udf(T.DoubleType())
def spelling_distance(typed: pd.Series, word: pd.Series) -> pd.Series:
    return pd.Series(spelling_costs(typed.to_list(), word.to_list()))


def dtw_costs(a: np.ndarray, b: np.ndarray, pairs: int = 1 << 10) -> np.ndarray:
    """Alignment cost of each row pair of two stacks of series, ``pairs`` at once: a cell of the table is a vector over them."""
    if len(a) > pairs:
        return np.concatenate([dtw_costs(a[i : i + pairs], b[i : i + pairs]) for i in range(0, len(a), pairs)])
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    n, m = len(a), len(b)
    prev = np.full((m + 1, a.shape[1]), np.inf)
    prev[0] = 0.0
    for i in range(n):
        cur = np.full_like(prev, np.inf)
        cost = np.abs(a[i] - b)
        way = np.minimum(prev[1:], prev[:-1])
        for j in range(m):
            np.minimum(way[j], cur[j], out=cur[j + 1])
            cur[j + 1] += cost[j]
        prev = cur
    return prev[m]


@F.pandas_udf(T.DoubleType())
def dtw_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.empty(len(a))
    shapes = pd.Series([(len(x), len(y)) for x, y in zip(a, b)])
    for _, idx in shapes.groupby(shapes).groups.items():
        out[idx] = dtw_costs(np.stack(a.iloc[idx].to_list()), np.stack(b.iloc[idx].to_list()))
    return pd.Series(out)

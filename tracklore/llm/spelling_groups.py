"""Operator 11: spelling variants by permuterm rotations.

Words are counted by Spark over whole texts. A word with its terminator is rotated to every place; the rotation from
place i + 1 on, without its last letter, is what remains of the word when letter i is skipped. Sorted by that
prefix, words that differ by a replaced letter share a prefix and go on with one letter each, and a word in which the letter is
missing is the whole prefix, so a scan of sorted rotations sees each group of neighbours as one run. A run holds
at most one word for each letter of the alphabet and one without, however large the vocabulary is. A letter that
repeats the one before it is skipped once for deletions, so that two words meet in one group only.

The scan gives each word the number of its neighbours in the group and the best one, never pairs. Words are carried
as their rank by (count downwards, code points), so the best neighbour is the smallest rank. Rotations of more than
`LITERAL` code points are named by a polynomial fingerprint modulo 2**127 - 1, made from prefix sums, so that a very long word
needs memory in proportion to its length; shorter ones are literal.

Defined results: null and empty texts have no words; a null doc_id counts as empty in the crc32 that chooses dropped letters;
repeated rows count as often as they stand; ties of counts go to the smaller word in code-point order, so chains of
forms rise in count and end.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.operators.ordered import positions

from . import store

END = "$"  # the terminator, no letter of a word
LITERAL = 64
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = ("".join(map(chr, range(a, a + 26))) for a in (65, 97))
_FIELD = (1 << 127) - 1
_BASE = random.Random(20240611).randrange(1 << 64, _FIELD)
_FULL, _AGAIN, _FIRST = 0, 1, 2  # kinds: whole word; skipped letter equal to the one before; any other skipped letter
_NONE = np.iinfo(np.int64).max


def words(docs: DataFrame, drop: int = 199) -> DataFrame:
    """word, n: lower-cased runs of letters of all texts, one letter dropped where `drop` divides the crc32 of doc_id:run."""
    given = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.translate("text", UPPER, LOWER).alias("_text"))
    runs = given.select("_id", F.explode(F.regexp_extract_all("_text", F.lit(RUN), F.lit(0))).alias("word"))
    h = F.crc32(F.concat("_id", F.lit(":"), "word"))
    size = F.length("word")
    at = (h % size).cast("int")
    shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, size))
    return runs.select(F.when(h % drop == 0, shorter).otherwise(F.col("word")).alias("word"))


def vocabulary(docs: DataFrame, least_letters: int = 6, least_count: int = 5) -> DataFrame:
    """rank, word, n of all words long and frequent enough; ranks from 1 by (n downwards, code points)."""
    counted = words(docs).where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    return positions(counted, [F.col("n").desc(), F.col("word")], "rank").select("rank", "word", "n")


def rotations(word: str) -> Iterator[tuple[str, int]]:
    """(prefix, kind): the whole rotations of a word, and each one without its last letter."""
    size = len(word)
    if size + 1 <= LITERAL:
        twice = word + END + word
        for i in range(size + 1):
            yield twice[i:i + size + 1], _FULL
    if size <= LITERAL:
        twice = word + END + word
        for i in range(size):
            yield twice[i + 1:i + 1 + size], _AGAIN if i and word[i] == word[i - 1] else _FIRST
    if size < LITERAL:
        return
    ring = [ord(c) for c in word + END] * 2
    sums = list(accumulate(ring, lambda h, c: (h * _BASE + c) % _FIELD, initial=0))

    def named(length: int, first: range) -> Iterator[str]:
        power = pow(_BASE, length, _FIELD)
        for i in first:
            yield f"{length}:{(sums[i + length] - sums[i] * power) % _FIELD:032x}"

    yield from ((x, _FULL) for x in named(size + 1, range(size + 1)))
    if size > LITERAL:
        for i, x in enumerate(named(size, range(1, size + 1))):
            yield x, _AGAIN if i and word[i] == word[i - 1] else _FIRST


def rotated(vocabulary: DataFrame) -> DataFrame:
    """prefix, rank, kind of all rotations."""

    def rows(batches):
        for batch in batches:
            prefix, rank, kind = [], [], []
            for r, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for p, k in rotations(word):
                    prefix.append(p)
                    rank.append(r)
                    kind.append(k)
                    if len(rank) >= 1 << 16:
                        yield {"prefix": pa.array(prefix, pa.string()), "rank": np.array(rank, np.int64), "kind": np.array(kind, np.int32)}
                        prefix, rank, kind = [], [], []
            if rank:
                yield {"prefix": pa.array(prefix, pa.string()), "rank": np.array(rank, np.int64), "kind": np.array(kind, np.int32)}

    return store.map_arrow(vocabulary.select("rank", "word"), rows, "prefix string, rank long, kind int")


def scanned(first: np.ndarray, rank: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(near, best) of each row of whole groups that start at `first`: how many neighbours, and the smallest rank of them."""
    size = np.diff(np.append(first, len(rank)))
    of = np.repeat(np.arange(len(first)), size)
    least = lambda some: np.minimum.reduceat(np.where(some, rank, _NONE), first)[of]
    skipped, once, full = kind != _FULL, kind == _FIRST, kind == _FULL
    many, deletions, whole = (np.add.reduceat(x.astype(np.int64), first)[of] for x in (skipped, once, full))
    low = least(skipped)
    second = least(skipped & (rank != low))
    other = np.where(rank == low, second, low)
    near = np.where(full, deletions, many - 1 + np.where(once, whole, 0))
    best = np.where(full, least(once), np.minimum(other, np.where(once, least(full), _NONE)))
    return near, best


def neighbours(table: DataFrame) -> DataFrame:
    """rank, n_near, best: how many neighbours a word has, and the smallest rank of them; only words that have some."""
    dealt = table.repartition("prefix").sortWithinPartitions("prefix")

    def rows(batches):
        held = None
        for batch in batches:
            batch = pa.table({n: batch.column(i) for i, n in enumerate(("prefix", "rank", "kind"))})
            batch = pa.concat_tables([held, batch]).combine_chunks() if held is not None else batch
            prefix = batch.column("prefix").combine_chunks()
            if not len(prefix):
                continue
            new = np.ones(len(prefix), bool)
            new[1:] = pa.compute.not_equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero(new)[-1])  # a group that may go on
            held = batch.slice(last)
            if last:
                yield found(batch.slice(0, last), new[:last])
        if held is not None and held.num_rows:
            yield found(held, np.arange(held.num_rows) == 0)

    def found(part, new):
        rank, kind = (part.column(c).to_numpy() for c in ("rank", "kind"))
        near, best = scanned(np.flatnonzero(new), rank, kind)
        some = near > 0
        return {"rank": rank[some], "near": near[some], "best": best[some]}

    return store.map_arrow(dealt, rows, "rank long, near long, best long").groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(up: DataFrame) -> DataFrame:
    """rank, root of the words that have a form (rank, up); each round doubles the length of the chains followed."""
    chain = store.kept(up.select("rank", F.col("up").alias("root")), "chains")
    while True:
        further = chain.select(F.col("rank").alias("root"), F.col("root").alias("above"))
        new = store.kept(chain.join(further, "root", "left").select("rank", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "chains")
        if new.where("moved").isEmpty():
            return new.select("rank", "root")
        chain = new.select("rank", "root")


def groups(docs: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n: each word of the vocabulary with its more frequent spelling, if any."""
    known = store.kept(vocabulary(docs), "vocabulary")
    near = store.kept(neighbours(rotated(known)), "neighbours")
    named = known.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    best = near.join(named, "best").join(known.select("rank", "n"), "rank")
    good = F.col("form_n") >= ratio * F.col("n")
    picked = best.select("rank", "n_near", *(F.when(good, F.col(c)).alias(c) for c in ("best", "form", "form_n")))
    picked = store.kept(picked, "forms")
    last = roots(picked.where("best is not null").select("rank", F.col("best").alias("up")))
    last = last.join(known.select(F.col("rank").alias("root"), F.col("word").alias("_root")), "root").select("rank", F.col("_root").alias("root"))
    out = known.join(picked, "rank", "left").join(last, "rank", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")

"""Operator 10: benchmark decontamination by winnowing.

A text's word k-grams are hashed and in each window of consecutive grams the smallest hash is kept with its place, so any
two texts that share `span` words keep a common fingerprint inside them. Fingerprints of documents and benchmark
items are joined on the hash; Spark broadcasts the item side only if its written size is under its threshold and
shuffles both otherwise. Each hit is then extended word by word in both directions, and runs of
`span` words or more (whole items where they are shorter) are marked.

Equal items are one item with several ids. Items shorter than `span` are winnowed with a window for their own length,
and documents once more for each such length that occurs (at most span - 1).

Defined results: null and empty texts have no words; a null item_id marks words but is not listed; documents of equal
doc_id are judged by their own text; empty tables give no hits.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import textbytes as tb

#: Fixed values of the contract: what a word is, after A-Z are lower-cased.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = re.compile(PATTERN)
LOWER = {c: c + 32 for c in range(65, 91)}


def word_list(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER))


def winnow(h: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints that guarantee spans of `span` words inside the texts at[i]..at[i+1]."""
    k = span // 2 + 2 if span > 3 else span
    gram = tb.gram_hash(h, k)
    low = tb.window_argmin(gram, span - k + 1)
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    left = np.repeat(at[1:], np.diff(at))[:len(low)] - np.arange(len(low))
    place = np.unique(low[left >= span])
    return place, tb.mix(gram[place] + np.uint64(span))


def _hashed(b: tb.Block) -> tuple[np.ndarray, np.ndarray]:
    start, end, at = tb.words(b, tb.LETTERS, fold=True)
    return tb.span_hash(tb.prefix(b.data, True), start, end), at


def fingerprints(rows: DataFrame, span: int, lengths: list[int] | None) -> DataFrame:
    """key, pos, fp of a table (key, text): for all `lengths`, or for each text the one for its own length."""

    def run(batches):
        for batch in batches:
            for b in tb.blocks(batch.column(1)):
                h, at = _hashed(b)
                size = np.minimum(np.diff(at), span)
                for n in lengths if lengths is not None else np.unique(size[size > 0]).tolist():
                    place, fp = winnow(h, at, n)
                    doc = np.searchsorted(at, place, "right") - 1
                    if lengths is None:
                        own = size[doc] == n
                        place, fp, doc = place[own], fp[own], doc[own]
                    yield {"key": batch.column(0).take(pa.array(b.first + doc)), "pos": (place - at[doc]).astype(np.int32), "fp": fp.view(np.int64)}

    return store.map_arrow(rows, run, f"key {rows.schema[0].dataType.simpleString()}, pos int, fp long")


def extended(words: list[str], item: list[str], seeds, span: int) -> list[tuple[int, int]]:
    """Maximal runs (first, end) of equal words through the seeds (place in words, place in item), of min(span, item) or more."""
    need, done, out = min(span, len(item)), {}, []
    for p, q in sorted(seeds):
        if p < done.get(p - q, 0) or p >= len(words) or words[p] != item[q]:  # equal hashes of different words
            continue
        a, i = p, q
        while a and i and words[a - 1] == item[i - 1]:
            a, i = a - 1, i - 1
        z, j = p, q
        while z < len(words) and j < len(item) and words[z] == item[j]:
            z, j = z + 1, j + 1
        done[p - q] = z
        if z - a >= need:
            out.append((a, z))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = 13) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    normal = F.array_join(F.regexp_extract_all(F.translate("text", "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))), F.lit(PATTERN), F.lit(0)), " ")
    items = store.kept(
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), normal.alias("words")).where("words <> ''")
        .groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("ids")).select(F.md5("words").alias("item"), "words", "ids"), "items")
    size = F.least(F.size(F.split("words", " ")), F.lit(span))
    lengths = sorted({r[0] for r in items.select(size.alias("n")).distinct().collect()})  # at most `span` numbers
    given = store.texts(docs, "doc_id").withColumn("_row", F.xxhash64("doc_id", "text"))  # rows of equal doc_id have places of their own
    marks = store.kept(fingerprints(items.select("item", "words"), span, None), "item-fingerprints")
    marks = marks.select(F.col("key").alias("item"), F.col("pos").alias("item_pos"), "fp")
    seeds = (
        fingerprints(given.select("_row", "text"), span, lengths).join(marks, "fp").select(F.col("key").alias("_row"), "item", "pos", "item_pos")
        .groupBy("_row", "item").agg(F.collect_set(F.struct("pos", "item_pos")).alias("at"))
        .join(items, "item").groupBy("_row").agg(F.collect_list(F.struct("words", "ids", "at")).alias("seeds"))
    )
    joined = given.join(store.kept(seeds, "seeds"), "_row", "left").select("doc_id", "text", "seeds")

    def rows(batches):
        for batch in batches:
            n_words = np.concatenate([np.diff(tb.words(b, tb.LETTERS, fold=True)[2]) for b in tb.blocks(batch.column(1))] or [np.zeros(0, np.int64)])
            n_hit = np.zeros(len(n_words), np.int64)
            found: list[list[str]] = [[] for _ in n_words]
            for i in np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False)).tolist():
                words = word_list(batch.column(1)[i].as_py())
                hit, ids = np.zeros(len(words), bool), set()
                for seed in batch.column(2)[i].as_py():
                    runs = extended(words, seed["words"].split(" "), [(s["pos"], s["item_pos"]) for s in seed["at"]], span)
                    for a, z in runs:
                        hit[a:z] = True
                    if runs:
                        ids.update(seed["ids"])
                n_hit[i], found[i] = hit.sum(), sorted(ids)
            yield {
                "doc_id": batch.column(0), "n_words": n_words, "n_hit": n_hit, "n_items": pa.array([len(x) for x in found], pa.int64()),
                "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in found],
                "contaminated": (n_hit > 0) & (20 * n_hit >= n_words),
            }

    return store.map_arrow(joined, rows, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")

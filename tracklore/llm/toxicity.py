"""Operator 12: toxicity by non-negative positive-unlabelled learning.

The classifier learns from confirmed toxic documents and from all documents as unlabelled text; a document that is not
labelled toxic is never taken for clean. Evidence comes from hashed words and word beginnings: how many confirmed and
how many unlabelled documents have each of them is counted over all rows by Spark. A document is described by the
strongest excesses of its features over their expected count, and by how many of them are in excess. When the
confirmed documents themselves are described, each is left out of its own counts.

Linear classifiers over these statistics are trained in numpy, one per bag of unlabelled rows, all bags in parallel tasks, and
averaged. Each minimises the class-prior-corrected logistic risk  prior * R+(P) + max(0, R-(U) - prior * R-(P)); where the
second term turns negative, a step is taken back up along it. A bag sees at most `POSITIVES` confirmed documents (those
of the smallest hash of doc_id); counts, bags, means and scores cover all rows.

Defined results: null and empty texts are the document without words and get a score; labels that are null, or whose
doc_id is null, are not learned from, and a null doc_id is not held out; a doc_id labelled both ways is confirmed; rows
that share a doc_id share its label and are scored by their own texts; without confirmed documents every score is the
class prior (0 where no labels are given).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import textbytes as tb
from .discriminant import held_out

BITS = 19  # features are hashed to 2**BITS places
BEGINNINGS = (4, 5, 6, 7)  # bytes of a word's beginning
TOP = 8  # strongest excesses of a document
STRONG = (0.7, 1.2)  # log ratios that count as evidence
SMOOTH = 2.0  # documents added to observed and expected counts
POSITIVES = 4096  # confirmed documents a classifier is fitted on: the documented bound of the labelled sample
BAG = 1 << 15  # unlabelled rows of a classifier
ROWS = 1 << 17  # rows a training task holds on average
STATS = [f"s{i}" for i in range(TOP + 1 + 2 * len(STRONG))]


def features(b: tb.Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text and the offsets of the texts."""
    start, end, at = tb.words(b, tb.LETTERS, fold=True)
    sums, size = tb.prefix(b.data, True), end - start
    doc = np.repeat(np.arange(b.n, dtype=np.uint64), np.diff(at))
    name, owner = [tb.span_hash(sums, start, end)], [doc]
    for k in BEGINNINGS:
        long = size > k
        name.append(tb.mix(tb.span_hash(sums, start[long], start[long] + k) + np.uint64(k)))
        owner.append(doc[long])
    key = np.sort(np.concatenate(owner) << np.uint64(BITS) | np.concatenate(name) >> np.uint64(64 - BITS))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), np.searchsorted(key >> np.uint64(BITS), np.arange(b.n + 1, dtype=np.uint64))


def counts(docs: DataFrame) -> DataFrame:
    """place, n: the number of documents with each feature; one array a task, added up by Spark. Place -1 counts documents."""

    def rows(batches):
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for b in tb.blocks(batch.column(0)):
                total += np.bincount(features(b)[0], minlength=1 << BITS)
        place = np.flatnonzero(total)
        yield {"place": np.concatenate([[-1], place]), "n": np.concatenate([[n], total[place]])}

    return store.map_arrow(store.texts(docs), rows, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))


def dense(table: DataFrame) -> tuple[np.ndarray, int]:
    got = table.toPandas()  # at most 2**BITS + 1 rows
    out = np.zeros(1 << BITS)
    known = got[got.place >= 0]
    out[known.place.to_numpy()] = known.n.to_numpy()
    return out, int(got[got.place < 0].n.sum())


class Evidence:
    """Counts of features in confirmed and in all documents, and the statistics of a text by them."""

    def __init__(self, confirmed: tuple[np.ndarray, int], every: tuple[np.ndarray, int]) -> None:
        (p, self.n_confirmed), (u, n) = confirmed, every
        self.p, self.u = p.astype(np.float32), u.astype(np.float32)
        self.rate = self.n_confirmed / max(n, 1)

    def describe(self, b: tb.Block, confirmed: bool = False) -> np.ndarray:
        """A row of statistics for each text; a confirmed text is left out of the confirmed counts."""
        name, at = features(b)
        size = np.diff(at)
        doc = np.repeat(np.arange(b.n), size)
        seen = self.p[name] - np.float32(confirmed)
        expected = (self.u[name] - 1) * np.float32(self.rate)
        ratio = np.log((np.maximum(seen, 0) + SMOOTH) / (np.maximum(expected, 0) + SMOOTH))
        excess = (seen - expected) / np.sqrt(np.maximum(expected, 0) + SMOOTH)
        some = np.flatnonzero(excess > 0)
        order = some[np.lexsort((-excess[some], doc[some]))]
        many = np.bincount(doc[order], minlength=b.n)
        first = np.cumsum(many) - many
        out = np.zeros((b.n, len(STATS)), np.float32)
        for k in range(TOP):
            has = many > k
            out[has, k] = excess[order[first[has] + k]]
        out[:, TOP] = np.log1p(size)
        for i, limit in enumerate(STRONG):
            strong = np.bincount(doc, ratio > limit, minlength=b.n)
            out[:, TOP + 1 + 2 * i] = np.log1p(strong)
            out[:, TOP + 2 + 2 * i] = np.sqrt(strong / np.maximum(size, 1))
        return out


def fitted(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 250, rate: float = 0.05, ridge: float = 1e-4) -> np.ndarray:
    """Weights and, last, the shift of a linear classifier of least non-negative risk (Adam steps over whole arrays)."""
    p, u = (np.column_stack([x, np.ones(len(x))]) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1])
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        at_p, at_u = np.clip(p @ w, -30, 30), np.clip(u @ w, -30, 30)
        toxic_p, toxic_u = 1 / (1 + np.exp(-at_p)), 1 / (1 + np.exp(-at_u))
        clean_risk = np.logaddexp(0, at_u).mean() - prior * np.logaddexp(0, at_p).mean()
        clean = u.T @ toxic_u / len(u) - prior * (p.T @ toxic_p) / len(p)
        g = prior * (p.T @ (toxic_p - 1)) / len(p) + clean if clean_risk >= 0 else -clean
        g[:-1] += ridge * w[:-1]
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w -= rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return w


def matrix(batch, first: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(first, first + len(STATS))])


def trained(table: DataFrame, positive: np.ndarray, prior: float) -> np.ndarray:
    """Mean weights of the classifiers of all bags, over statistics as they stand (standardised inside)."""
    got = table.agg(F.count("*").alias("n"), *(f(s).alias(f"{f.__name__}_{s}") for f in (F.avg, F.stddev_pop) for s in STATS)).first()
    mean, scale = (np.array([got[f"{f}_{s}"] for s in STATS]) for f in ("avg", "stddev_pop"))
    scale = np.maximum(scale, 1e-6)
    p = (positive - mean) / scale

    def rows(batches):
        held, n = [], 0

        def classifier():
            u = (np.concatenate(held) - mean) / scale
            w = fitted(p, u, prior) * len(u)
            return {f"w{i}": w[i:i + 1] for i in range(len(w))} | {"n": np.array([len(u)])}

        for batch in batches:
            for first in range(0, batch.num_rows, BAG):
                part = batch.slice(first, BAG)
                if n + part.num_rows > BAG and n:
                    yield classifier()
                    held, n = [], 0
                held.append(matrix(part, 0))
                n += part.num_rows
        if n:
            yield classifier()

    names = [f"w{i}" for i in range(len(STATS) + 1)]
    bags = table.select(*STATS).repartition(-(-got["n"] // ROWS))  # dealt in turn: a bag mixes all sources
    w = store.map_arrow(bags, rows, ", ".join(f"{x} double" for x in names) + ", n long").agg(*(F.sum(x) / F.sum("n") for x in names)).first()
    w = np.array(list(w))
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def scored(docs: DataFrame, labels: DataFrame, cut: float = 0.5, prior: float | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; `labels` has doc_id and toxic (1: confirmed).

    The class prior is the share of toxic rows among the labels learned from, unless given.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    confirmed = store.kept(known.where("toxic = 1").select("doc_id"), "confirmed")
    if prior is None:
        prior = float(known.agg(F.avg("toxic")).first()[0] or 0.0)
    given = docs.select("doc_id", "text")
    toxic = store.kept(given.join(confirmed, "doc_id", "left_semi"), "confirmed-texts")
    evidence = Evidence(dense(counts(toxic)), dense(counts(given)))
    if not evidence.n_confirmed or not 0 < prior < 1:
        return given.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(prior).alias("score"), F.lit(int(prior >= cut)).alias("predicted"))

    def describe(own: bool):
        def rows(batches):
            for batch in batches:
                for b in tb.blocks(batch.column(1)):
                    x = evidence.describe(b, own)
                    yield {"doc_id": batch.column(0).slice(b.first, b.n)} | {s: x[:, i] for i, s in enumerate(STATS)}

        return rows

    schema = "doc_id long, " + ", ".join(f"{s} float" for s in STATS)
    table = store.kept(store.map_arrow(store.texts(given, "doc_id"), describe(False), schema), "statistics")
    sample = toxic.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(POSITIVES)
    positive = store.map_arrow(store.texts(sample, "doc_id"), describe(True), schema).orderBy(*STATS).select(*STATS).toPandas().to_numpy(float)
    w = trained(table, positive, prior)

    def judge(batches):
        for batch in batches:
            s = 1 / (1 + np.exp(-np.clip(matrix(batch, 1) @ w[:-1] + w[-1], -40, 40)))
            yield {"doc_id": batch.column(0), "score": s, "predicted": (s >= cut).astype(np.int32)}

    out = store.map_arrow(table, judge, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

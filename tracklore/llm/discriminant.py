"""Operator 4: document quality by a regularised quadratic discriminant.

One pass over whole texts turns each document into transformed statistics (counts as logarithms, shares as square
roots). The class means and covariances come from sums over all labelled training rows, added up by Spark; each
covariance is shrunk towards a multiple of the identity by the oracle-approximating rule. The score is the difference
of the two Gaussian log densities, from Mahalanobis distances by cached Cholesky factors, put on 0..1 by a logistic
curve that is fitted on a histogram of the training differences.

Defined results: null and empty texts are the document of zero words and get a score; labels that are null, and rows
whose doc_id is null, are not learned from (a null doc_id is not held out); repeated labels count as often as they
stand; with fewer than two rows of a class every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from . import textbytes as tb
from .quality_rules import measure

BINS, BIN = 400, 0.1  # histogram of asinh(difference), from -20 to 20
_DIGIT, _PUNCT = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True


def features(b: tb.Block) -> np.ndarray:
    """A row of transformed statistics for each text of a block."""
    m = {k: v.astype(float) for k, v in measure(b).items()}
    size = np.diff(b.at)
    doc = np.repeat(np.arange(b.n), size)
    bytes_of = np.bincount(doc * 256 + b.data, minlength=b.n * 256).reshape(b.n, 256).astype(float)
    total = np.maximum(size, 1)[:, None]
    share = bytes_of / total
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    start, end, at = tb.words(b, tb.SPACED, fold=False)
    name = tb.span_hash(tb.prefix(b.data, True), start, end) + np.repeat(np.arange(b.n, dtype=np.uint64), np.diff(at)) * np.uint64(0xA24BAED4963EE407)
    first = np.zeros(len(name), bool)
    first[np.unique(name, return_index=True)[1]] = True
    sums = np.concatenate([[0], np.cumsum(first)])
    words, lines, letters = np.maximum(m["n_words"], 1), np.maximum(m["n_lines"], 1), np.maximum(m["n_ascii_letters"], 1)
    distinct = sums[at[1:]] - sums[at[:-1]]
    part = lambda flags: np.sqrt(bytes_of[:, flags].sum(1) / total[:, 0])
    return np.column_stack([
        np.log1p(m["n_words"]), np.log1p(m["n_lines"]), np.log(words / lines), np.log1p(m["word_chars"] / words),
        np.sqrt(m["n_symbols"] / words), np.sqrt(m["n_dup_lines"] / lines), np.sqrt(m["n_repeat_words"] / words),
        np.sqrt(m["n_upper"] / letters), np.sqrt(m["n_exclaim"] / words), np.sqrt(1 - m["n_alpha_words"] / words),
        np.log(np.maximum(distinct, 1) / words), part(_DIGIT), part(_PUNCT), part(np.arange(256) >= 128), entropy,
    ])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def shrunk(s: np.ndarray, n: float) -> np.ndarray:
    """Covariance drawn towards a multiple of the identity by the oracle-approximating shrinkage."""
    p = len(s)
    square, trace = (s * s).sum(), np.trace(s)
    gap = (n + 1 - 2 / p) * (square - trace ** 2 / p)
    rho = 1.0 if gap <= 0 else min(1.0, ((1 - 2 / p) * square + trace ** 2) / gap)
    return (1 - rho) * s + (rho * trace / p + 1e-4) * np.eye(p)


class Discriminant:
    """Two Gaussians in standardised coordinates with the inverse Cholesky factors of their covariances."""

    def __init__(self, moments: dict[int, np.ndarray], p: int) -> None:
        """moments: for classes 0 and 1 the flat (count, sums, outer products)."""
        self.n = np.array([moments[c][0] if c in moments else 0.0 for c in (0, 1)])
        self.ready = bool((self.n >= 2).all())
        self.share = float(self.n[1] / self.n.sum()) if self.n.sum() else 0.5
        self.curve = (1.0, 0.0)
        if not self.ready:
            return
        both = moments[0] + moments[1]
        self.mean = both[1:p + 1] / both[0]
        self.scale = np.sqrt(np.maximum(np.diag(both[p + 1:].reshape(p, p)) / both[0] - self.mean ** 2, 1e-6))
        self.factors = []
        for c in (0, 1):
            m = moments[c]
            mu = m[1:p + 1] / m[0]
            s = (m[p + 1:].reshape(p, p) / m[0] - np.outer(mu, mu)) / np.outer(self.scale, self.scale)
            low = np.linalg.cholesky(shrunk(s, m[0]))
            self.factors.append(((mu - self.mean) / self.scale, np.linalg.inv(low), 2 * np.log(np.diag(low)).sum()))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0."""
        z = (x - self.mean) / self.scale
        d = [((z - mu) @ inverse.T) for mu, inverse, _ in self.factors]
        return 0.5 * ((d[0] ** 2).sum(1) + self.factors[0][2] - (d[1] ** 2).sum(1) - self.factors[1][2])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.share)
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * np.arcsinh(self.difference(x)) + b, -40, 40)))


def logistic(t: np.ndarray, n0: np.ndarray, n1: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of the logistic curve through a histogram (damped Newton steps, a small ridge on the slope)."""
    a, b = 1.0, 0.0
    n = n0 + n1
    loss = lambda a, b: (n0 * np.logaddexp(0, a * t + b) + n1 * np.logaddexp(0, -a * t - b)).sum() + 0.5 * (a - 1) ** 2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * t + b, -40, 40)))
        g = np.array([((p * n - n1) * t).sum() + a - 1, (p * n - n1).sum()])
        w = p * (1 - p) * n
        h = np.array([[(w * t * t).sum() + 1, (w * t).sum()], [(w * t).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        while loss(a - step[0], b - step[1]) > loss(a, b) and abs(step).max() > 1e-9:
            step = step / 2
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return max(float(a), 1e-3), float(b)


def matrix(batch, first: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(first, batch.num_columns)])


def fit(rows: DataFrame) -> Discriminant:
    """From rows (class int, statistics...): sums over all of them, then a histogram of all their differences."""
    p = len(rows.columns) - 1

    def moments(batches):
        total = np.zeros((2, 1 + p + p * p))
        for batch in batches:
            c, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch, 1)
            for k in (0, 1):
                y = x[c == k]
                total[k] += np.concatenate([[len(y)], y.sum(0), (y.T @ y).ravel()])
        n = total.shape[1]
        yield {"c": np.repeat([0, 1], n), "i": np.tile(np.arange(n), 2), "v": total.ravel()}

    got: dict[int, np.ndarray] = {}
    for r in store.map_arrow(rows, moments, "c long, i long, v double").groupBy("c", "i").agg(F.sum("v").alias("v")).collect():  # 2 * (1 + p + p * p) sums
        got.setdefault(r["c"], np.zeros(1 + p + p * p))[r["i"]] = r["v"]
    model = Discriminant(got, p)
    if not model.ready:
        return model

    def histogram(batches):
        n = np.zeros((2, BINS), np.int64)
        for batch in batches:
            c, t = batch.column(0).to_numpy(zero_copy_only=False), np.arcsinh(model.difference(matrix(batch, 1)))
            place = np.clip((t / BIN + BINS / 2).astype(int), 0, BINS - 1)
            for k in (0, 1):
                n[k] += np.bincount(place[c == k], minlength=BINS)
        c, i = np.nonzero(n)
        yield {"c": c, "i": i, "n": n[c, i]}

    n = np.zeros((2, BINS))
    for r in store.map_arrow(rows, histogram, "c long, i long, n long").groupBy("c", "i").agg(F.sum("n").alias("n")).collect():  # 2 * BINS counts
        n[r["c"], r["i"]] = r["n"]
    model.curve = logistic((np.arange(BINS) - BINS / 2 + 0.5) * BIN, n[0], n[1])
    return model


def scored(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; `labels` has doc_id and quality (0 or 1)."""
    p = features(tb.Block(0, np.zeros(0, np.uint8), np.zeros(2, np.int64))).shape[1]

    def run(batches):
        for batch in batches:
            for b in tb.blocks(batch.column(1)):
                x = features(b)
                yield {"doc_id": batch.column(0).slice(b.first, b.n)} | {f"f{i}": x[:, i] for i in range(p)}

    stats = [f"f{i}" for i in range(p)]
    table = store.kept(store.map_arrow(store.texts(docs, "doc_id"), run, "doc_id long, " + ", ".join(f"{s} double" for s in stats)), "statistics")
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("class"))
    model = fit(store.kept(table.join(known, "doc_id").select("class", *stats), "training"))

    def judge(batches):
        for batch in batches:
            s = model.score(matrix(batch, 1))
            yield {"doc_id": batch.column(0), "score": s, "predicted": (s >= cut).astype(np.int32)}

    out = store.map_arrow(table, judge, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

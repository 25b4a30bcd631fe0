"""Best paths along a sequence: exemplars over frames, dictionary words over unspaced text.

The model (exemplars, dictionary) is a file of the shared folder, the sequences stay where Spark has dealt them. Both passes
go once along a sequence and keep a back pointer for each place, so memory is linear in its length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.session import ship, spread
from tracklore.sources import side

FRAMES = 1 << 14  # frames of one batch of sequences


class Network:
    """States of all exemplars in a row; a word is entered at its first state and left from its last."""

    def __init__(self, exemplars: pa.Table, cosine: bool) -> None:
        order = sorted(range(exemplars.num_rows), key=lambda i: (exemplars["token"][i].as_py(), exemplars["state"][i].as_py()))
        token = [exemplars["token"][i].as_py() for i in order]
        self.vec = np.array([exemplars["vec"][i].as_py() for i in order], float)
        begin = [i for i in range(len(token)) if not i or token[i] != token[i - 1]]
        self.first, self.tokens = np.array(begin, np.int64), [token[i] for i in begin]
        self.last = np.append(self.first[1:], len(token)) - 1
        self.inner = np.setdiff1d(np.arange(len(token)), self.first)
        self.cosine = cosine

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Frames x states."""
        if self.cosine:
            size = lambda v: np.maximum(np.linalg.norm(v, axis=1), 1e-8)
            return 1 - (x @ self.vec.T) / size(x)[:, None] / size(self.vec)[None, :]
        return np.stack([np.sqrt(((x - v) ** 2).sum(1)) for v in self.vec], 1)

    def pass_tokens(self, series: list[np.ndarray], penalty: float) -> list[tuple[float, list[tuple]]]:
        """(cost, [(token, first frame, last frame)]) of each sequence; all advance together, a frame at a time.

        A state is reached by staying or from the one before it, a first state also from the best word that has ended, for
        `penalty`; on equal costs the way named first is taken, and the first word.
        """
        b, s = len(series), len(self.vec)
        order = np.argsort([-len(x) for x in series], kind="stable")  # those that go on stand in front
        length = np.array([len(series[i]) for i in order])
        start = np.cumsum(length) - length
        far = self.distances(np.concatenate([series[i] for i in order])) if length.sum() else np.zeros((0, s))
        cost = np.full((b, s), np.inf)
        cost[:, self.first] = 0.0
        entered = np.zeros((b, s), np.int64)
        t_max = int(length.max(initial=0))
        ended, since = np.zeros((b, t_max), np.int64), np.zeros((b, t_max), np.int64)  # best word before a frame, and where it began
        for t in range(t_max):
            n = int(np.searchsorted(-length, -t, "left"))  # sequences with more than t frames
            c, e = cost[:n], entered[:n]
            word = c[:, self.last].argmin(1)
            row = np.arange(n)
            done = c[row, self.last[word]]
            ended[:n, t], since[:n, t] = word, e[row, self.last[word]]
            new_c, new_e = c.copy(), e.copy()
            step = c[:, self.inner - 1] < c[:, self.inner]
            new_c[:, self.inner] = np.where(step, c[:, self.inner - 1], c[:, self.inner])
            new_e[:, self.inner] = np.where(step, e[:, self.inner - 1], e[:, self.inner])
            turn = (done + penalty)[:, None] < c[:, self.first]
            new_c[:, self.first] = np.where(turn, (done + penalty)[:, None], c[:, self.first])
            new_e[:, self.first] = np.where(turn, t, e[:, self.first])
            cost[:n], entered[:n] = new_c + far[start[:n] + t], new_e
        out: list = [None] * b
        for k, i in enumerate(order.tolist()):
            word = int(cost[k, self.last].argmin())
            total, begin, end = float(cost[k, self.last[word]]), int(entered[k, self.last[word]]), int(length[k]) - 1
            spans = []
            while math.isfinite(total) and end >= 0:
                spans.append((self.tokens[word], begin, end))
                if not begin:
                    break
                word, begin, end = int(ended[k, begin]), int(since[k, begin]), begin - 1
            out[i] = (total, spans[::-1])
        return out


def token_spans(frames: DataFrame, key: str, order: str, vec: str, exemplars: DataFrame, penalty: float = 1.5, cosine: bool = False) -> DataFrame:
    """(key, number, token, first, last, cost): the sequence of exemplars that spells each clip at the least cost, with the
    frames of each, counted from 0; cost is that of the whole clip.

    exemplars(token, state, vec) must fit a task's memory. A clip shorter than every exemplar's way has no rows. Clips
    are dealt by key and solved some together, about ``FRAMES`` frames at a time.
    """
    ship(frames.sparkSession)
    path = side.put(exemplars.select("token", "state", "vec"))
    kinds = f"`{key}` {frames.schema[key].dataType.simpleString()}, number int, token {exemplars.schema['token'].dataType.simpleString()}, first int, last int, cost double"
    names = [key, "number", "token", "first", "last", "cost"]

    def run(batches):
        net = Network(side.get(path), cosine)
        clips, rows, held = [], [], 0

        def solved():
            got = net.pass_tokens([np.concatenate(r) for r in rows], penalty)
            flat = [(k, i, *span, total) for k, (total, spans) in zip(clips, got) for i, span in enumerate(spans)]
            clips.clear()
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], out.field(i).type) for i in range(len(names))], names=names)

        for batch in batches:
            tags, values = batch.column(0).to_pylist(), batch.column(1)
            x = np.asarray(values.flatten()).reshape(batch.num_rows, -1) if batch.num_rows else None
            first = [i for i in range(len(tags)) if not i or tags[i] != tags[i - 1]]
            for a, z in zip(first, [*first[1:], len(tags)]):
                if not clips or tags[a] != clips[-1]:
                    if held >= FRAMES:
                        yield solved()
                        held = 0
                    clips.append(tags[a])
                    rows.append([])
                rows[-1].append(x[a:z])
                held += z - a
        if clips:
            yield solved()

    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(frames.sparkSession.createDataFrame([], kinds).schema)
    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = frames.where(F.col(key).isNotNull()).repartition(n, key).sortWithinPartitions(key, order)
    return dealt.select(key, F.col(vec).cast("array<double>")).mapInArrow(run, kinds)


class Words:
    """Costs of dictionary words, and every beginning of one, so that a walk from a place ends where no word goes on."""

    def __init__(self, cost: dict[str, float]) -> None:
        self.cost = cost
        self.begins = {w[:i] for w in cost for i in range(1, len(w) + 1)}

    def split(self, text: str, unknown: float) -> tuple[list[str], float]:
        """The cheapest split; ties go to the longer last word. Letters outside every word stand alone."""
        n = len(text)
        best, back = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            end = i + 1
            alone = round(here + unknown, 9)
            if alone < best[end]:
                best[end], back[end] = alone, i
            while end <= n and (part := text[i:end]) in self.begins:
                c = self.cost.get(part)
                if c is not None and (total := round(here + c, 9)) < best[end]:
                    best[end], back[end] = total, i
                end += 1
        words, end = [], n
        while end:
            words.append(text[back[end]:end])
            end = int(back[end])
        return words[::-1], float(best[n])


def segment(texts: DataFrame, unigrams: DataFrame, unknown: float = 10.0) -> DataFrame:
    """(key, text, cost): cheapest split of texts(key, text) into dictionary words, each for -log10 of its share.

    The dictionary(word, freq) must fit a task's memory. A null text stays null, at no cost; an empty one has no words.
    """
    ship(texts.sparkSession)
    share = unigrams.where("word <> ''").groupBy("word").agg(F.sum("freq").alias("freq"))
    total = unigrams.agg(F.sum("freq").alias("total"))
    path = side.put(share.join(total, F.lit(True)).select("word", (-F.log10(F.col("freq") / F.col("total"))).alias("cost")))

    def run(batches):
        table = side.get(path)
        words = Words(dict(zip(table["word"].to_pylist(), table["cost"].to_pylist())))
        for batch in batches:
            got = [(None, 0.0) if t is None else words.split(t, unknown) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([w if w is None else " ".join(w) for w, _ in got], pa.string()), pa.array([c for _, c in got], pa.float64())],
                names=["key", "text", "cost"])

    kind = texts.schema["key"].dataType.simpleString()
    return spread(texts.select("key", "text")).mapInArrow(run, f"key {kind}, text string, cost double")

"""Recursive filters in segments against the plain recursion."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore.operators import tracks as T
from tracklore.streaming import guard as G


def clamped(x, threshold):
    out = list(x[:1]) if len(x) > 2 else list(x)
    for i in range(len(out), len(x)):
        p = out[-1]
        far = math.dist(x[i], p) > threshold
        out.append(tuple(0.5 * (a + b) for a, b in zip(p, x[i + 1])) if far and i + 1 < len(x) else p if far else x[i])
    return out


def tracks(seed):
    rnd = np.random.default_rng(seed)
    jumpy = {(c, 0): rnd.normal(0, 0.2, (n, 2)) for c, n in enumerate((1, 2, 3, 40, 129, 400))}
    drift = {(9, 1): np.cumsum(rnd.normal(0.4, 0.1, (300, 2)), 0), (9, 2): np.cumsum(rnd.normal(0, 0.05, (300, 2)), 0)}  # always over the limit; never
    return {k: [tuple(p) for p in v.tolist()] for k, v in (jumpy | drift).items()}


@pytest.mark.parametrize("span", [4, 16, 256])
def test_jump_clamp_in_segments(spark, span):
    given = tracks(span)
    rows = [(c, k, 7 + 3 * i, *p) for (c, k), x in given.items() for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "clip_id int, kp int, frame_idx int, x double, y double").repartition(5)
    got = {(r.clip_id, r.kp, r.frame_idx): (r.x, r.y) for r in T.jump_clamp(df, 0.25, span).collect()}
    want = {(c, k, 7 + 3 * i): p for (c, k), x in given.items() for i, p in enumerate(clamped(x, 0.25))}
    assert got == want
    assert T.jump_clamp(df.where("clip_id < 0"), 0.25, span).count() == 0


@pytest.mark.parametrize("span", [8, 256])
def test_one_euro_in_segments(spark, span):
    rnd = np.random.default_rng(span)
    clips = {c: np.cumsum(rnd.normal(0, 0.02, (n, 2)), 0).tolist() for c, n in enumerate((1, 5, 300, 700))}
    gain = lambda cut: 1 / (1 + 30 / (2 * math.pi * cut + 1e-6))
    df = spark.createDataFrame([(c, i, *p) for c, x in clips.items() for i, p in enumerate(x)], "clip_id int, frame_idx int, x double, y double")
    got = {(r.clip_id, r.frame_idx): (r.x, r.y) for r in G.one_euro(df, "x", "y", span=span).collect()}
    assert len(got) == sum(map(len, clips.values()))
    for c, x in clips.items():
        at, speed = x[0], [0.0, 0.0]
        for i, v in enumerate(x):
            if i:
                speed = [gain(1) * (a - b) * 30 + (1 - gain(1)) * s for a, b, s in zip(v, at, speed)]
                at = [(k := gain(1 + 10 * abs(s))) * a + (1 - k) * b for a, b, s in zip(v, at, speed)]
            assert np.allclose(got[c, i], at, atol=1e-11)


def test_a_long_clip_costs_in_proportion(spark):
    took = []
    for n in (100_000, 400_000):
        df = spark.range(n, numPartitions=4).select(
            F.lit(1).alias("clip_id"), F.lit(0).alias("kp"), F.col("id").cast("int").alias("frame_idx"),
            F.sin(F.col("id") / 50).alias("x"), F.when(F.col("id") % 97 == 0, 5.0).otherwise(0.1).alias("y"))
        start = time.time()
        assert T.jump_clamp(df).where("abs(y - 0.1) > 1e-9").count() > 0
        took.append(time.time() - start)
    assert took[1] < 8 * took[0] + 5

"""Hand-made tracks against independent NumPy code, and segment borders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore.operators import tracks as T


def frames(spark, clips):
    rows = [(c, 0, t, float(v), bool(ok)) for c, (xs, oks) in clips.items() for t, (v, ok) in enumerate(zip(xs, oks))]
    return spark.createDataFrame(rows, "clip_id string, kp int, frame_idx int, x double, valid boolean")


def series(df, col="x"):
    out = {}
    for r in df.orderBy("clip_id", "frame_idx").collect():
        out.setdefault(r.clip_id, []).append(r[col])
    return out


def gaps(n, missing):
    return [i not in missing for i in range(n)]


def test_interpolate_gap_lengths(spark):
    clips = {
        "none": ([1, 2, 3], [1, 1, 1]),
        "five": (list(range(8)), gaps(8, range(1, 6))),
        "six": (list(range(9)), gaps(9, range(1, 7))),
        "ends": ([9, 9, 1, 2, 9], [0, 0, 1, 1, 0]),
        "single": ([9, 4, 9], [0, 1, 0]),
    }
    got = series(T.interpolate_gaps(frames(spark, {k: ([v if ok else -1 for v, ok in zip(xs, oks)], oks) for k, (xs, oks) in clips.items()})))
    assert np.allclose(got["five"], range(8))
    assert got["six"][1:7] == [-1.0] * 6
    assert got["ends"] == [-1.0, -1.0, 1.0, 2.0, -1.0]
    assert got["single"] == [-1.0, 4.0, -1.0]


def kinematics(x):
    """Straight NumPy restatement for one channel."""
    n, dt = len(x), 1 / 30
    p = x.copy()
    if n > 2:
        p[1:-1] = np.convolve(x, [0.25, 0.5, 0.25], "valid")
    v, a = np.zeros(n), np.zeros(n)
    for i in range(n):
        if n >= 5 and 2 <= i < n - 2:
            w = p[i - 2 : i + 3]
            v[i] = np.dot(w, [-2, -1, 0, 1, 2]) / (10 * dt)
            a[i] = np.dot(w, [2, -1, -2, -1, 2]) / (7 * dt * dt)
        elif n > 1:
            lo, hi = max(0, i - 1), min(n - 1, i + 1)
            v[i] = (p[hi] - p[lo]) / ((hi - lo) * dt)
            if n > 2:
                j = min(max(i, 1), n - 2)
                a[i] = (p[j + 1] - 2 * p[j] + p[j - 1]) / dt**2
    v, a = v.clip(-12, 12), a.clip(-45, 45)
    still = np.abs(p) < 1e-5
    v[still] = a[still] = 0
    return v, a


@pytest.mark.parametrize("smooth", [True])
def test_kinematics_short_and_clipped(spark, smooth):
    rng = np.random.default_rng(1)
    clips = {f"n{n}": (rng.normal(0, 0.02, n), [1] * n) for n in (1, 2, 3, 4, 5, 9)}
    clips["fast"] = (np.array([0, 5, -5, 5, -5, 5.0]), [1] * 6)
    clips["still"] = (np.zeros(6), [1] * 6)
    k = T.kinematics(frames(spark, clips), smooth=smooth)
    v, a = series(k, "vx"), series(k, "ax")
    for name, (xs, _) in clips.items():
        want = kinematics(np.asarray(xs, dtype=float))
        assert np.allclose(v[name], want[0], atol=1e-9), name
        assert np.allclose(a[name], want[1], atol=1e-6), name


@pytest.mark.parametrize("fn", [
    lambda f: T.kinematics(f), lambda f: T.binomial_smooth(f), lambda f: T.gaussian_smooth(f), lambda f: T.rolling_mean(f, 6),
    lambda f: T.simple_kinematics(f), lambda f: T.interpolate_gaps(f), lambda f: T.impute_all(f)])
def test_segments_do_not_change_results(spark, monkeypatch, fn):
    rng = np.random.default_rng(2)
    clips = {"a": (rng.normal(size=70), rng.random(70) > 0.3), "b": (rng.normal(size=5), [1] * 5)}
    df = frames(spark, clips)
    cols = lambda d: d.select(*sorted(d.columns)).orderBy("clip_id", "frame_idx").collect()
    whole = cols(fn(df))
    real = T.stencil
    monkeypatch.setattr(T, "SPAN", 16)
    monkeypatch.setattr(T, "stencil", lambda d, halo, span=16: real(d, halo, span))
    cut = cols(fn(df))
    for x, y in zip(whole, cut, strict=True):
        assert all(p == q or abs(p - q) < 1e-9 for p, q in zip(x, y) if not isinstance(p, str))


def test_ema_over_segments(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=1500)
    want = [x[0]]
    for v in x[1:]:
        want.append(0.9 * want[-1] + 0.1 * v)
    real = T.stencil
    monkeypatch.setattr(T, "SPAN", 500)
    monkeypatch.setattr(T, "stencil", lambda d, halo, span=500: real(d, halo, span))
    got = series(T.ema(frames(spark, {"a": (x, [1] * 1500)})))["a"]
    assert np.allclose(got, want, atol=1e-12)


def test_min_frames_lengths(spark):
    clips = {str(n): (np.linspace(0, 1, n) if n > 1 else np.array([0.7]), [1] * n) for n in (1, 7, 40, 41)}
    got = series(T.ensure_min_frames(frames(spark, clips)))
    assert got["1"] == [0.7] * 40
    assert np.allclose(got["7"], np.linspace(0, 1, 40))
    assert len(got["40"]) == 40 and len(got["41"]) == 41


def test_spans_minimum_and_open_end(spark):
    clips = {"three": ([1, 1, 1, 0], [1] * 4), "four": ([0, 1, 1, 1, 1, 0], [1] * 6), "open": ([0, 1, 1, 1, 1], [1] * 5)}
    got = {r.clip_id: (r.start, r.end) for r in T.spans(frames(spark, clips), F.col("x") > 0.5).collect()}
    assert got == {"four": (1, 5), "open": (1, 5)}

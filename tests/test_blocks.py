"""Narrow shards and alignment in packs."""

import numpy as np

from tracklore.functions import edit
from tracklore.plans import sources


def test_shards_are_numbered_without_texts(spark, sf, monkeypatch):
    seen = []
    real = sources.W.numbered_shards
    monkeypatch.setattr(sources.W, "numbered_shards", lambda df, *a: seen.extend(df.columns) or real(df, *a))
    assert sources.Q.plans["s8_shard_list"](spark, sf).count() > 0
    assert "text" not in seen


def test_alignment_in_packs_equals_one_table():
    rnd = np.random.default_rng(4)
    a, b = rnd.normal(size=(11, 9)), rnd.normal(size=(11, 7))
    want = []
    for x, y in zip(a, b):
        d = np.full((10, 8), np.inf)
        d[0, 0] = 0
        for i in range(9):
            for j in range(7):
                d[i + 1, j + 1] = abs(x[i] - y[j]) + min(d[i, j + 1], d[i, j], d[i + 1, j])
        want.append(d[9, 7])
    assert np.allclose(edit.dtw_costs(a, b, pairs=4), want, rtol=0, atol=1e-12)

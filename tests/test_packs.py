"""Nearest items by packs: brute force on data without clusters, copies, strange vectors; queries are not copied to cells."""

import numpy as np

from tracklore.operators import metric as M
from tracklore.operators import packs

PARTS = {"a": 0.6, "b": 0.4}


def rows(spark, v, label):
    data = [(i, label[i], None if x is None else x[:3], None if x is None else x[3:]) for i, x in enumerate(v)]
    return spark.createDataFrame(data, "id int, label int, a array<double>, b array<double>")


def answers(spark, v, label):
    df = rows(spark, v, label)
    return {r.id: (round(r.distance, 9), r.negative) for r in M.nearest(df, df.withColumnRenamed("id", "negative"), "id", "negative", PARTS, "label", 9).collect()}


def brute(v, label):
    out, m = {}, np.array([x for x in v])
    for i, x in enumerate(m):
        d = 0.6 * np.sqrt(((m[:, :3] - x[:3]) ** 2).sum(1)) + 0.4 * np.sqrt(((m[:, 3:] - x[3:]) ** 2).sum(1))
        out[i] = min((round(d[j], 9), j) for j in range(len(m)) if label[j] != label[i])
    return out


def test_queries_are_not_copied_to_the_cells_they_reach(spark, monkeypatch):
    monkeypatch.setattr(M, "reached", None)
    monkeypatch.setattr(packs, "PACK", 64)  # in this process: the numbers of tasks
    rnd = np.random.default_rng(4)
    v = rnd.normal(0, 1, (700, 8))
    v[:400] = rnd.integers(0, 2, (400, 8))  # many ties, and copies of other labels
    v[-1] = v[-2] + 1e-8
    label = rnd.integers(0, 3, 700).tolist()
    assert answers(spark, v.tolist(), label) == brute(v, label)


def test_rows_without_vectors_or_labels(spark):
    rnd = np.random.default_rng(9)
    v = rnd.normal(0, 1, (300, 8)).tolist()
    label = [i % 2 for i in range(300)]
    want = brute(np.array(v), label)
    got = answers(spark, v + [None, [float("nan")] * 8, [0.1] * 6, v[5]], label + [0, 1, 1, None])
    assert {i: got[i] for i in range(300)} == want and 303 not in got


def test_an_item_without_a_distance_comes_first(spark):
    rnd = np.random.default_rng(2)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rnd.normal(0, 1, (20, 4)))], "id int, v array<double>")
    items = spark.createDataFrame([(0, [0.0] * 4), (1, [None, 0.0, 0.0, 0.0]), (2, None)], "code int, v array<double>")
    got = M.nearest(q, items, "id", "code", {"v": 1.0}).collect()
    assert len(got) == 20 and all(r.code == 1 and r.distance is None for r in got)

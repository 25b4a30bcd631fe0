import random
import zlib

import numpy as np
import pytest

from tracklore.llm import textbytes as tb
from tracklore.llm import toxicity as tx

from .conftest import table


def held(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0


def corpus(n=3000, seed=2):
    rng = random.Random(seed)
    say = lambda k: " ".join("".join(rng.choice(["to", "ra", "li", "men", "sa", "ko"]) for _ in range(rng.randint(1, 4))) for _ in range(k))
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.12
        text = say(rng.randint(5, 200))
        if bad:
            text += " " + " ".join(rng.choice(["grobian", "schuftig", "zounds"]) for _ in range(rng.randint(2, 6))) + " " + say(5)
        rows.append((i, text))
        if rng.random() < 0.5:
            labels.append((i, int(bad)))
    return rows, labels


def risk(w, p, u, prior):
    at_p, at_u = (np.column_stack([x, np.ones(len(x))]) @ w for x in (p, u))
    return prior * np.logaddexp(0, -at_p).mean(), np.logaddexp(0, at_u).mean() - prior * np.logaddexp(0, at_p).mean()


def test_fitted_lowers_the_risk_and_keeps_it_from_turning_negative():
    rng = np.random.default_rng(1)
    p, clean = rng.normal(2, 1, (300, 3)), rng.normal(-1, 1, (1700, 3))
    u = np.concatenate([rng.normal(2, 1, (300, 3)), clean])
    w = tx.fitted(p, u, 0.15)
    first, second = risk(w, p, u, 0.15)
    assert first + max(0, second) < 0.2 * sum(risk(np.zeros(4), p, u, 0.15)) and second > -0.05
    score = np.column_stack([clean, np.ones(len(clean))]) @ w
    assert (score > 0).mean() < 0.03


def test_statistics_match_brute_force():
    texts = ["Alpha beta alpha gammagamma", "beta", "", "gammagam delta, delta!", "alpha " * 50]
    b = tb.Block(0, np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts]))
    name, at = tx.features(b)
    sets = [set(name[at[i]:at[i + 1]].tolist()) for i in range(5)]
    grams = [{w for x in t.lower().replace(",", "").replace("!", "").split() for w in {x, *((k, x[:k]) for k in tx.BEGINNINGS if len(x) > k)}} for t in texts]
    assert [len(s) for s in sets] == [len(g) for g in grams] and len(sets[0] & sets[4]) == 2 and sets[1] < sets[0]
    p, u = (np.bincount([x for i in some for x in sets[i]], minlength=1 << tx.BITS) for some in ((0, 3), range(5)))
    for own in (False, True):
        got = tx.Evidence((p, 2), (u, 5)).describe(b, own)
        for i, s in enumerate(sets):
            e = {x: (u[x] - 1) * 0.4 for x in s}
            z = sorted((v for x in s if (v := (p[x] - own - e[x]) / (e[x] + 2) ** 0.5) > 0), reverse=True)[:tx.TOP]
            assert np.allclose(got[i, :tx.TOP], z + [0] * (tx.TOP - len(z)), atol=1e-5)
            strong = [sum(np.log((max(p[x] - own, 0) + 2) / (e[x] + 2)) > t for x in s) for t in tx.STRONG]
            assert np.allclose(got[i, tx.TOP:], [np.log1p(len(s)), *(v for c in strong for v in (np.log1p(c), (c / max(len(s), 1)) ** 0.5))], atol=1e-5)


def test_held_out_documents_are_found(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    known = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in tx.scored(docs, known).collect()}
    assert len(got) == len(rows)
    truth = {i: "grobian" in t or "schuftig" in t or "zounds" in t for i, t in rows}
    out = [r for r in got.values() if r.held_out]
    assert all(r.held_out == held(r.doc_id) for r in got.values())
    assert np.mean([r.predicted for r in out if truth[r.doc_id]]) > 0.97
    assert np.mean([r.predicted for r in out if not truth[r.doc_id]]) < 0.02
    # labels of held-out rows change nothing, and confirmed ones alone are taken for toxic
    flipped = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, y in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in tx.scored(docs, flipped).collect()}
    assert max(abs(again[i] - got[i].score) for i in got) < 1e-9


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(None, 1)]])
def test_without_confirmed_documents(spark, docs, rows, labels):
    got = tx.scored(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {(r.score, r.predicted) for r in got.collect()} == {(0.0, 0)} and got.count() == len(rows)


def test_awkward_rows_get_scores(spark, docs, rows, none):
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(30), *range(100, 140)]] * 2, "doc_id long, toxic int")
    got = tx.scored(docs, labels)
    assert table(got.select("doc_id", "held_out")) == sorted(((d, d is not None and held(d)) for d, _ in rows), key=repr)
    assert got.where("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.5)").isEmpty()
    assert tx.scored(none, labels).count() == 0

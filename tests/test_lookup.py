"""Spelling, alignment and nearest-item queries against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tracklore.functions import edit
from tracklore.operators import decoding as D
from tracklore.operators import metric as M
from tracklore.operators import similarity as S
from tracklore.operators import spelling as P

WORDS = {"hello": 50, "help": 40, "held": 12, "world": 60, "word": 70, "old": 30, "cold": 20, "name": 90, "game": 15, "you": 8, "my": 3, "mr": 900, "anne": 50}
PAIRS = {("hello", "world"): 500, ("cold", "game"): 90, ("help", "old"): 300, ("you", "game"): 4000, ("my", "name"): 12}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def scalar_cost(s, w):
    """The cost of one pair, cell by cell."""
    if s == w:
        return 0.0
    if (s, w) in edit.SHORT_FORMS:
        return 0.1
    alike = lambda a, b: any({a.upper(), b.upper()} <= g for g in edit.CONFUSION_GROUPS)
    row = [float(j) for j in range(len(w) + 1)]
    for i, a in enumerate(s, 1):
        new = [float(i)]
        for j, b in enumerate(w, 1):
            add = 0.15 if (j > 1 and w[j - 2] == b and a != b) or (j == len(w) and b == "e") else 1.0
            swap = 0.0 if a == b else 0.35 if alike(a, b) else 1.0
            new.append(min(row[j] + (0.20 if i > 1 and s[i - 2] == a else 1.0), new[-1] + add, row[j - 1] + swap))
        row = new
    return row[-1]


def test_costs_of_many_pairs():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("aabemnué1") for _ in range(rnd.randint(0, 12)))
    pairs = [(word(), word()) for _ in range(3000)] + [("u", "you"), ("", ""), ("", "e"), ("x" * 70, "x" * 69 + "e")]
    got = edit.spelling_costs([a for a, _ in pairs], [b for _, b in pairs], cells=500)
    assert np.allclose(got, [scalar_cost(a, b) for a, b in pairs])


def near_words(spark, words, terms, crowd):
    q = spark.createDataFrame([(w,) for w in words], "word string")
    u = spark.createDataFrame([(t, 7) for t in terms], "word string, freq long")
    return P.near_pairs(q, u, crowd=crowd)


def test_segment_index_finds_all_pairs(spark):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9))) for _ in range(120)] + ["https://a.example/" + "".join(rnd.choice("xyz") for _ in range(5)) for _ in range(80)]
    def changed(w):
        for _ in range(rnd.randint(0, 3)):
            p = rnd.randrange(len(w) + 1)
            w = rnd.choice([w[:p] + "b" + w[p:], w[:p] + w[p + 1:], w[:p] + "c" + w[p + 1:]])
        return w
    words = sorted({changed(w) for w in base} | {"", "é", "éé"})
    want = {(w, t): n for w in words for t in set(base) if (n := levenshtein(w, t)) <= 2}
    for crowd in (1, 6, 10 ** 6):  # every key cut again, some, none
        got = near_words(spark, [*words, None], sorted(set(base)), crowd).collect()
        assert len(got) == len(want) and {(r.word, r.term): r.distance for r in got} == want


def test_words_with_a_common_beginning_meet_few_candidates(spark):
    """Address-like words: the pairs compared grow with the input, not with its square."""
    rnd = random.Random(1)
    rows = {}
    for n in (2000, 8000):
        urls = sorted({"https://www.example.org/page/" + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(n)})
        near = near_words(spark, [u[:-3] + "q" + u[-2:] for u in urls], urls, 64)
        assert near.count() >= n - 1
        plan = near._jdf.queryExecution().executedPlan()
        rows[n] = max(int(m.split(":")[1]) for m in compared(plan))
    assert rows[8000] < 8 * rows[2000] and rows[8000] < 40 * 8000


def compared(plan):
    """Output rows of the joins of an executed plan."""
    plan = plan.finalPhysicalPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    plan = plan.plan() if "QueryStage" in plan.nodeName() else plan
    if "Join" in plan.nodeName():
        yield f"{plan.nodeName()}:{plan.metrics().apply('numOutputRows').value()}"
    for i in range(plan.children().size()):
        yield from compared(plan.children().apply(i))


def best(word, prev):
    """Straight restatement: settled words, else nearest twelve, then cost with frequency and context."""
    if word in ("anna",) or len(word) <= 1 and not (
            word == "u" and prev in ("can", "how") or word == "r" and prev == "you" or word in ("i", "l") and prev in (None, "and")):
        return word
    if len(word) == 1:
        return {"u": "you", "r": "are"}.get(word, "i")
    near = sorted((levenshtein(word, t), -f, t) for t, f in WORDS.items() if levenshtein(word, t) <= 2)[:12]
    def cost(t):
        c = scalar_cost(word, t) - 0.25 * math.log10(max(10, {"name": 4500000000, "hello": 5000000000, "help": 4000000000, "you": 6000000000, "my": 5000000000}.get(t, WORDS[t])))
        return c - 3 if (prev, t) in {("hello", "my"), ("my", "name")} else c - (0.25 * math.log10(max(10, PAIRS[prev, t])) if (prev, t) in PAIRS else 0)
    return min(((round(cost(t), 9), i, t) for i, (_, _, t) in enumerate(near)), default=(0, 0, word))[2]


def tables(spark):
    u = spark.createDataFrame(list(WORDS.items()), "word string, freq long")
    b = spark.createDataFrame([(*k, v) for k, v in PAIRS.items()], "w1 string, w2 string, freq long")
    return u, b


def test_phrases_and_candidates(spark):
    u, b = tables(spark)
    phrases = [["helo", "wrld"], ["hepl", "ol"], ["cod", "gme", "zzzzz"], ["nam"], ["wold", "wold"], ["helo", "mi", "nme"], ["anna", "cn", "u", "gme"], ["i", "r", "l"], ["can", "u", "r", "nae"], ["u", "gme"]]
    rows = [(i, j, w) for i, p in enumerate(phrases) for j, w in enumerate(p)]
    got = {r.key: r.words for r in P.correct_phrases(
        spark.createDataFrame(rows, "key int, pos int, word string"), u, b, "key", ["anna"]).collect()}
    for i, p in enumerate(phrases):
        prev, want = None, []
        for w in p:
            prev = best(w, prev)
            want.append(prev)
        assert got[i] == want
    pairs = [(i, w, p) for i, (w, p) in enumerate((w, x) for w in {w for p in phrases for w in p} for x in (None, "hello", "my", "can", "you", "help"))]
    single = P.correct_words(spark.createDataFrame(pairs, "key int, word string, prev string"), u, b, ["anna"]).collect()
    assert {r.key: r.corrected for r in single} == {i: best(w, p) for i, w, p in pairs}
    words = sorted({w for p in phrases for w in p})
    c = P.candidates(spark.createDataFrame([(w,) for w in words], "word string"), u).collect()
    assert {(r.word, r.term) for r in c} == {(w, t) for w in words for t in WORDS if levenshtein(w, t) <= 2}


def clustered(n, clusters, labels, seed=3):
    rnd = np.random.default_rng(seed)
    v = np.concatenate([rnd.normal(c, 0.05, (n // clusters, 4)) for c in rnd.normal(0, 8, (clusters, 4))])
    return v, [int(i * labels // len(v)) if labels > 4 else int(i % labels) for i in range(len(v))]


def hard(spark, v, label, **cuts):
    data = [(i, label[i], x[:2].tolist(), x[2:].tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(data, "id int, label int, a array<double>, b array<double>")
    if not cuts:
        return S.hard_negatives(df, "id", "label", {"a": ("a", 0.7), "b": ("b", 0.3)})
    return M.nearest(df, df.withColumnRenamed("id", "negative"), "id", "negative", {"a": 0.7, "b": 0.3}, "label", 9, **cuts)


def test_hard_negatives_brute(spark):
    for v, label, cuts in [(*clustered(120, 3, 4), {}), (*clustered(600, 6, 6), {"fan": 4, "cell": 5}), (*clustered(400, 4, 3), {"fan": 3, "cell": 2})]:
        v[7] = v[100]  # equal vectors of two labels, and of one
        v[20:26] = v[20]
        got = {r.id: r for r in hard(spark, v, label, **cuts).collect()}
        assert len(got) == len(v)
        gap = lambda x, y: 0.7 * np.linalg.norm(x[:2] - y[:2]) + 0.3 * np.linalg.norm(x[2:] - y[2:])
        for i, x in enumerate(v):
            near = min((round(gap(x, y), 9), j) for j, y in enumerate(v) if label[j] != label[i])
            assert (round(got[i].distance, 9), got[i].negative) == near
    assert hard(spark, v, [1] * len(v)).count() == 0 and hard(spark, v[:0], []).count() == 0


def test_nearest_visits_grow_with_the_rows_on_clustered_data(spark):
    visits = {}
    for n in (1000, 4000):
        v, label = clustered(n, n // 20, n // 20)
        df = spark.createDataFrame([(i, label[i], x.tolist()) for i, x in enumerate(v)], "id int, label int, v array<double>")
        t = M.tree(df, "id", {"v": 1.0}, "label", fan=8, cell=16)
        visits[n] = M.reached(M.bounded(M.asked(df, t, "id", "label"), t), t).count()
        assert t.leaves.selectExpr("max(size(members)) as n").first().n <= 16 and len(t.nodes) > 1
    assert visits[4000] < 8 * visits[1000] and visits[4000] < 16 * 4000  # of 4000 * 400 leaves


def test_shares_of_many_candidates(spark):
    rnd = np.random.default_rng(5)
    c, v = rnd.normal(0, 1, (300, 6)), rnd.normal(0, 1, (50, 6))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, v array<double>")
    got = S.classify(rows, "id", "v", spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "label int, centre array<double>"), "label", "centre").collect()
    cos = (v / np.linalg.norm(v, axis=1)[:, None]) @ (c / np.linalg.norm(c, axis=1)[:, None]).T
    share = np.exp(100 * (cos - cos.max(1)[:, None]))
    assert len(got) == 50
    for r in got:
        assert r.predicted == cos[r.id].argmax() and abs(r.probability - 1 / share[r.id].sum()) < 1e-9


def test_time_warping_costs():
    rnd = random.Random(2)
    a = np.array([[rnd.random() for _ in range(5)] for _ in range(6)])
    b = np.array([[rnd.random() for _ in range(7)] for _ in range(6)])
    got = edit.dtw_costs(a, b)
    for k in range(6):
        t = np.full((6, 8), np.inf)
        t[0, 0] = 0
        for i in range(1, 6):
            for j in range(1, 8):
                t[i, j] = abs(a[k, i - 1] - b[k, j - 1]) + min(t[i - 1, j], t[i, j - 1], t[i - 1, j - 1])
        assert abs(got[k] - t[5, 7]) < 1e-12


def test_segmentation_prefers_words(spark):
    u, _ = tables(spark)
    t = spark.createDataFrame([(1, "helloworld"), (2, "coldxname"), (3, ""), (4, None)], "key int, text string")
    assert {r.key: r.text for r in D.segment(t, u).collect()} == {1: "hello world", 2: "cold x name", 3: "", 4: None}


def test_segmentation_is_the_cheapest_split():
    rnd = random.Random(6)
    cost = {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 4))): round(rnd.uniform(0.3, 3), 3) for _ in range(12)}
    def cheapest(t):
        return min((c + cheapest(t[i:]) for i in range(1, len(t) + 1) if (c := cost.get(t[:i], 10.0 if i == 1 else None)) is not None), default=0.0)
    for _ in range(40):
        t = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 11)))
        words, total = D.Words(cost).split(t, 10.0)
        assert "".join(words) == t and abs(total - min(cheapest(t), sum([10.0] * len(t)))) < 1e-6


def test_segmentation_of_a_long_text_is_linear():
    cost = {w: 1.0 for w in ("hello", "help", "world", "a" * 9)}
    text = "helloworldhelp" * 1500 + "a" * 5000
    words, _ = D.Words(cost).split(text, 10.0)
    assert len(text) > 20_000 and "".join(words) == text and words[:3] == ["hello", "world", "help"]


def passed(frames, exemplars, penalty):
    """Least cost over all ways, by plain recursion over places (frame, word, state)."""
    far = lambda t, w, s: float(np.linalg.norm(frames[t] - exemplars[w][s]))
    best = {(w, s): (0.0 if s == 0 else math.inf, [(w, 0)]) for w in exemplars for s in range(len(exemplars[w]))}
    for t in range(len(frames)):
        end = min(((best[w, len(e) - 1][0], i, w) for i, (w, e) in enumerate(exemplars.items())))
        new = {}
        for w, s in best:
            ways = [best[w, s]] + ([best[w, s - 1]] if s else [(end[0] + penalty, best[end[2], len(exemplars[end[2]]) - 1][1] + [(w, t)])])
            c, h = min(ways, key=lambda x: x[0])
            new[w, s] = (c + far(t, w, s), h)
        best = new
    c, _, w = min((best[w, len(e) - 1][0], i, w) for i, (w, e) in enumerate(exemplars.items()))
    h = best[w, len(exemplars[w]) - 1][1]
    return c, [(w, b, (h[i + 1][1] if i + 1 < len(h) else len(frames)) - 1) for i, (w, b) in enumerate(h)]


def test_token_passing_matches_brute_force(spark):
    rnd = np.random.default_rng(9)
    exemplars = {w: rnd.normal(0, 1, (n, 3)) for w, n in ((1, 1), (2, 3), (5, 2), (7, 6))}
    clips = {c: np.concatenate([rnd.normal(0, 0.2, (len(e), 3)) + e for e in (exemplars[w] for w in rnd.choice([1, 2, 5], c % 6 + 1))]) for c in range(30)}
    clips[40] = rnd.normal(0, 1, (1, 3))
    e = spark.createDataFrame([(w, i, v.tolist()) for w, x in exemplars.items() for i, v in enumerate(x)], "token int, state int, vec array<double>")
    f = spark.createDataFrame([(c, i * 10, v.tolist()) for c, x in clips.items() for i, v in enumerate(x)] + [(None, 1, [0.0] * 3)], "clip int, n int, v array<double>")
    got = {}
    for r in D.token_spans(f.repartition(6), "clip", "n", "v", e, penalty=0.7).orderBy("clip", "number").collect():
        got.setdefault(r.clip, (round(r.cost, 9), []))[1].append((r.token, r.first, r.last))
    assert got == {c: (round(w[0], 9), w[1]) for c, x in clips.items() for w in [passed(x, exemplars, 0.7)]}
    assert D.token_spans(f.limit(0), "clip", "n", "v", e).count() == 0


def test_phrases_join_choices_and_not_candidates(spark):
    """Choices that the word before turns, against a plain left-to-right fold; tokens carry no lists of candidates."""
    import re

    from tracklore.operators import spelling as S

    words = "then than them they thin than the there three her here hear heat head bread brad beat boat".split()
    uni = spark.createDataFrame([(w, 10 * 3 ** (i % 5)) for i, w in enumerate(dict.fromkeys(words))], "word string, freq long")
    pairs = [("then", "hear", 10), ("than", "heat", 100_000), ("the", "heat", 10**18), ("her", "bread", 50), ("here", "boat", 10_000), ("you", "heat", 10), ("are", "here", 10**8)]
    bi = spark.createDataFrame(pairs, "w1 string, w2 string, freq long")
    phrases = ["thxn hea bre boa", "u hea r her", "thn heax hee brad", "zzzzzzzz hea", "i hea they r herr boqt", "anna hea"]
    tokens = spark.createDataFrame([(k, i, w) for k, p in enumerate(phrases) for i, w in enumerate(p.split())], "key long, pos int, word string")
    out = S.correct_phrases(tokens, uni, bi, "key", ["anna"])
    assert not re.search(r"struct\(pos, [^)]*, c, ", out._jdf.queryExecution().optimizedPlan().toString())

    found = {}
    for r in S.scored_candidates(tokens.select("word"), uni).collect():
        found.setdefault(r["word"], []).append((r["rank"], r["term"], r["score"]))
    bonus = {(r["w1"], r["w2"]): r["bonus"] for r in S._bonus(bi).collect()}

    def settled(w, prev):
        if w == "anna" or w == "u" and prev in ("can", "thank", "love", "see", "meet", "how", "are"):
            return w if w == "anna" else "you"
        if w == "r" and prev in ("you", "they", "we"):
            return "are"
        if w in ("i", "1", "l") and prev in (None, "and", "that", "so", "but"):
            return "i"
        return w if len(w) <= 1 else None

    want = []
    for k, p in enumerate(phrases):
        said = []
        for w in p.split():
            prev = said[-1] if said else None
            best = min(((round(s + bonus.get((prev, t), 0.0), 9), rank, t) for rank, t, s in found.get(w, [])), default=(0, 0, w))[2]
            said.append(settled(w, prev) or best)
        want.append((k, said))
    assert sorted((r["key"], r["words"]) for r in out.collect()) == want
    usual = [[settled(w, None) or min(((round(s, 9), rank, t) for rank, t, s in found.get(w, [])), default=(0, 0, w))[2] for w in p.split()] for p in phrases]
    assert usual != [said for _, said in want]  # some choice is turned

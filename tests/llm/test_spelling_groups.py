import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracklore.llm import spelling_groups as sg

from .conftest import table

UPPER = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute(rows, drop=199, letters=6, least=5):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % drop == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= letters and c >= least}
    friends = {w: sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: f[0] if f and n[f[0]] >= 5 * n[w] else None for w, f in friends.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(friends[w]), n[form[w]] if form[w] else None) for w in n), key=repr)


def spelled(seed=3):
    """Texts with many variants: insertions, deletions and replacements, runs of one letter, words of 60 to 70 letters."""
    rng = random.Random(seed)
    base = ["straße", "kettle", "aaaaaa", "Mississippi", "résumés", "letters", "x" * 63, "abc" * 21 + "d", "long" * 17]
    rows = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = rng.choice(base)
            if rng.random() < 0.3:
                p = rng.randrange(len(w) + 1)
                w = rng.choice([w[:p] + rng.choice("aesß") + w[p:], w[:p] + w[p + 1:], w[:p] + rng.choice("aes") + w[p + 1:]])
            words.append(w)
        rows.append((rng.choice([i, i, i, None, 7]), " ".join(words)))
    rows += [(9, " ".join(["x" * 64] * 6)), (9, " ".join(["x" * 65] * 6)), (9, " ".join(["y" + "x" * 64] * 6))]
    return rows + [(1, None), (2, ""), (3, "× ÷×÷×÷× " * 9), (5, "ab1cdefgh_ijklmnop " * 6), (5, "ab1cdefgh_ijklmnop " * 6)]


def test_groups_match_brute_force(spark, docs, rows, none):
    assert table(sg.groups(docs)) == brute(rows)
    assert sg.groups(none).count() == 0
    many = spelled()
    got = spark.createDataFrame(many, "doc_id long, text string").selectExpr("*", "1 as rank", "'a' as word", "2 as n").repartition(5)
    want = brute(many)
    assert table(sg.groups(got)) == want and sum(r[4] for r in want) > 300
    assert {len(r[0]) for r in want if r[4]} >= {62, 63, 64, 65, 67}  # on both sides of literal rotations


def test_chains_of_forms_end_at_the_root(spark):
    words = {"abcdefg": 5, "abcdefgh": 25, "abcdefghi": 125, "abcdefghij": 625, "abcdefghijk": 624}
    text = [(None, " ".join([w] * n)) for w, n in words.items()]
    got = {r.word: r for r in sg.groups(spark.createDataFrame(text, "doc_id long, text string")).collect()}
    assert [got[w].root for w in words][:4] == ["abcdefghij"] * 4 and got["abcdefghijk"].form is None


@pytest.mark.parametrize("word", ["abcdef", "aaaaaa", "b" * 63, "b" * 64, "b" * 65, "xy" * 40])
def test_two_words_meet_in_one_group_only(word):
    rng = random.Random(word)
    for _ in range(30):
        p = rng.randrange(len(word))
        for other in (word[:p] + "q" + word[p + 1:], word[:p] + word[p + 1:], word[:p] + word[p] + word[p:]):
            if other == word:
                continue
            one, two = dict(sg.rotations(word)), dict(sg.rotations(other))
            assert len(one) == 2 * len(word) + 1
            meet = [x for x in one if x in two and (one[x] and two[x] or max(one[x], two[x]) == sg._FIRST)]
            assert len(meet) == 1


def test_memory_of_a_long_word_is_linear():
    n, longest = 0, 0
    for key, _ in sg.rotations("ab" * 20_000):
        n, longest = n + 1, max(longest, len(key))
    assert n == 80_001 and longest < 50


def test_scan_of_one_group():
    rank, kind = np.array([5, 2, 9, 4]), np.array([0, 2, 1, 2])  # the whole word, a letter, a repeated letter, a letter
    near_, best = sg.scanned(np.array([0]), rank, kind)
    assert near_.tolist() == [2, 3, 2, 3] and best.tolist() == [2, 4, 2, 2]

"""Edit operations, overlap metrics and lookups against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tracklore.functions import edit
from tracklore.functions import text as X
from tracklore.operators import metrics as M


def brute(ref, hyp):
    """Full table with backtrace: match, then substitution, deletion, insertion."""
    n, m = len(ref), len(hyp)
    d = [[i + j if i * j == 0 else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = d[i - 1][j - 1] if ref[i - 1] == hyp[j - 1] else 1 + min(d[i - 1][j - 1], d[i - 1][j], d[i][j - 1])
    s = dl = ins = 0
    i, j = n, m
    while i or j:
        if i and j and ref[i - 1] == hyp[j - 1]:
            i, j = i - 1, j - 1
        elif i and j and d[i][j] == d[i - 1][j - 1] + 1:
            s, i, j = s + 1, i - 1, j - 1
        elif i and (not j or d[i][j] == d[i - 1][j] + 1):
            dl, i = dl + 1, i - 1
        else:
            ins, j = ins + 1, j - 1
    return s, dl, ins


def test_edit_counts_match_backtrace():
    rnd = random.Random(5)
    for _ in range(400):
        a = [rnd.choice("abc") for _ in range(rnd.randint(0, 9))]
        b = [rnd.choice("abc") for _ in range(rnd.randint(0, 9))]
        assert edit.edit_counts(a, b) == brute(a, b), (a, b)


def test_lcs_matches_table():
    rnd = random.Random(6)
    for _ in range(200):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 12))]
        b = [rnd.choice("abcd") for _ in range(rnd.randint(0, 12))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
        assert edit.lcs_length(a, b) == t[-1][-1]


@pytest.mark.parametrize("typed,word,cost", [
    ("hello", "hello", 0.0), ("helo", "hello", 1.0), ("nam", "name", 0.15), ("u", "you", 0.1), ("cat", "cot", 1.0),
    ("mat", "nat", 0.35), ("heello", "hello", 0.20)])
def test_spelling_cost(typed, word, cost):
    assert edit.spelling_cost(typed, word) == pytest.approx(cost)


def pairs(spark, data):
    return spark.createDataFrame([(i, r, h) for i, (r, h) in enumerate(data)], "id int, ref string, hyp string")


def words(c):
    return X.tokens(F.col(c))


def test_error_rates_and_empties(spark):
    p = pairs(spark, [("a b c", "a x c"), ("", "q"), ("k l", "")])
    r = M.error_rates(p, words("ref"), words("hyp")).first()
    assert (r.ref_tokens, r.sub_rate, r.del_rate, r.ins_rate) == (5, 20.0, 40.0, 20.0)


def test_bleu_short_hypothesis_and_zero_match(spark):
    r = M.bleu(pairs(spark, [("a b c d e", "a b c")]), ["id"], words("ref"), words("hyp")).first()
    assert r.bleu_1 == pytest.approx(100 * 2.718281828459045 ** (1 - 5 / 3))
    assert r.bleu_4 == 0.0


def test_rouge_both_empty(spark):
    assert M.rouge_l(pairs(spark, [("", "")]), words("ref"), words("hyp")).first().rouge_l == 100.0


def test_split_known_fractions(spark):
    df = spark.createDataFrame([("0",), ("3",)], "id string").select("id", X.hash_fraction("id").alias("h"), X.split_of("id").alias("s"))
    got = {r.id: (round(r.h, 7), r.s) for r in df.collect()}
    assert got == {"0": (0.8117237, "val"), "3": (0.9249845, "test")}

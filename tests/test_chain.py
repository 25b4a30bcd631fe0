"""Frames to sentences: the machine on hand-made frames, the joins against plain look-ups."""

import pytest

from tracklore.operators import spelling as P
from tracklore.streaming import chain as C

WORDS = {"hello": 50, "help": 40, "held": 12, "hat": 40, "cat": 30, "anna": 1}


def frames(*steps):
    """'A' spells a letter, '_' is a pause of 12, '>' submits, '<' takes back, ' ' is an open palm, '.' a pause of 45."""
    sign = {">": "SUBMIT", "<": "BACKSPACE", " ": "SPACE"}
    out = []
    for ch in "".join(steps):
        if ch in sign:
            out.append((sign[ch], None, 0.0))
        elif ch in "_.":
            out += [(None, None, 0.0)] * (12 if ch == "_" else 45)
        else:
            out += [(None, ch, 0.9)] * 8 + [(None, None, 0.0)] * 4
    return out


def run(*steps):
    m = C.FrameChain()
    return [e for f in frames(*steps) for e in m.step(f)] + m.finish()


def ended(*steps):
    return [(e[5], e[6]) for e in run(*steps) if e[1] == "END_SENTENCE"]


def test_gestures_close_take_back_and_submit():
    assert ended("HI YOU>") == [(1, ["HI", "YOU"])]
    assert ended("HI <YO>") == [(1, ["HIYO"])]  # at a word border the word is opened again
    assert ended("HI <<U>") == [(1, ["HU"])]
    assert ended("HI>CAT") == [(1, ["HI"]), (2, ["CAT"])]  # what is open ends with the session
    assert ended(">") == [(1, [])]
    assert ended("HI.A>") == [(1, ["HI"]), (2, ["A"])]


def test_events_are_numbered_and_letters_carry_their_word():
    out = run("HI O>")
    assert [e[0] for e in out] == list(range(1, len(out) + 1))
    assert [(e[2], e[3], e[4]) for e in out if e[1] == "LETTER"] == [("H", "H", "H"), ("I", "HI", "HI"), ("O", "HI O", "O")]


def test_a_control_frame_does_not_reach_the_letters():
    m = C.FrameChain()
    for _ in range(5):
        assert m.step((None, "A", 0.9)) == []
    assert m.step(("SPACE", "A", 0.9))[0][1] == "SPACE"
    assert m.step((None, "A", 0.9))[0][1:3] == ("LETTER", "A")


@pytest.fixture(scope="module")
def said(spark):
    rows = []
    for session, steps in (("a", "HELO ANNA>CAT>"), ("b", "HELO ANNA>"), ("c", ">"), ("d", "MY NAME IS BOB>")):
        rows += [(session, i, *f) for i, f in enumerate(frames(steps))]
    df = spark.createDataFrame(rows, "session string, i int, control string, letter string, conf double")
    return C.events(df, "session", ["i"])


def test_suggestions_are_the_commonest_words_of_the_prefix(spark, said):
    uni = spark.createDataFrame(list(WORDS.items()), "word string, freq int")
    got = C.suggestions(said, "session", uni).where("session = 'a'").orderBy("seq").collect()
    for r in got:
        prefix = r.preview.split(" ")[-1].lower()
        assert r.suggestions == [w for _, w in sorted((-n, w) for w, n in WORDS.items() if w.startswith(prefix))][:3]
    assert got[0].suggestions == ["hello", "hat", "help"] and got[-1].suggestions == ["cat"]


def test_sentences_keep_names_and_translate(spark, said):
    uni = spark.createDataFrame([*WORDS.items(), ("ann", 900), ("my", 9), ("name", 9), ("is", 9), ("bob", 9)], "word string, freq int")
    bi = spark.createDataFrame([("my", "name", 5)], "w1 string, w2 string, freq int")
    lexicon = spark.createDataFrame([("a", ["anna"])], "session string, names array<string>")
    words = spark.createDataFrame([("hello", "chào {lp}"), ("anna", "x"), ("hat", "mũ")], "word string, translation string")
    phrases = spark.createDataFrame([("cat", "{sp} có mèo")], "phrase string, translation string")
    got = {(r.session, r.sentence): (r.raw, r.english, r.translation) for r in C.sentences(said, "session", uni, bi, lexicon, words, phrases).collect()}
    assert got["a", 1] == ("HELO ANNA", "Hello Anna.", "Chào bạn Anna.")
    assert got["a", 2] == ("CAT", "Cat.", "Tôi có mèo.")
    assert got["b", 1][1].startswith("Hello a") and got["b", 1][2].startswith("Chào bạn ")  # no name of that session
    assert got["c", 1] == ("", "", "")
    assert got["d", 1][2] == "Xin chào, tên tôi là Bob."


def test_controls_of_hands(spark):
    def hand(fingers, thumb):
        kps = [(0.0, 0.0, 0.0)] * 21
        for tip in (8, 12, 16, 20):
            kps[tip] = (0.0, -1.0 if fingers else 1.0, 0.0)
        kps[4] = (1.0 if thumb else 0.0, -1.0, 0.0)
        return [dict(zip("xyz", p)) for p in kps]

    rows = [("s", i, hand(True, True) if i == 50 else hand(False, True) if i == 51 else hand(False, False)) for i in range(60)]
    h = spark.createDataFrame(rows, "session string, frame_idx int, kps array<struct<x: double, y: double, z: double>>")
    from pyspark.sql import functions as F

    got = sorted((r.frame_idx, r.control) for r in C.controls(h, ["session"], F.col("frame_idx") / 7, 20).collect())
    assert got == [(19, "BACKSPACE"), (39, "BACKSPACE"), (50, "SPACE"), (51, "SUBMIT")]


def test_two_patterns_and_a_question(spark):
    s = spark.createDataFrame([(1, "Hi, my name is anna."), (2, "hat anna?"), (3, "?")], "id int, t string")
    words = spark.createDataFrame([("hat", "mũ")], "word string, translation string")
    none = spark.createDataFrame([], "phrase string, translation string")
    got = {r.id: r.translated for r in P.translate(s, "id", "t", words, none).collect()}
    assert got == {1: "Xin chào, tên tôi là Anna.", 2: "Mũ anna?", 3: ""}

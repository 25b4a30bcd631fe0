import numpy as np
import pytest

from tracklore.llm import quality_rules, set_join, substring_dedup
from tracklore.llm import textbytes as tb



def word(n, one, two):
    """The Thue-Morse word of n letters and its complement: equal under every polynomial hash modulo a power of two."""
    flip = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((one, two)[b] for b in flip), "".join((two, one)[b] for b in flip)


@pytest.mark.parametrize("n", [512, 1024, 2048])
def test_words_that_collide_modulo_a_power_of_two(spark, n):
    a, b = word(n, "t", "u")
    both = np.frombuffer((a + b).encode(), np.uint8)
    h = tb.span_hash(tb.prefix(both, False), np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] != h[1]
    docs = spark.createDataFrame([(1, f"{a}\n{b}"), (2, a), (3, b), (4, f"x {a} y"), (5, f"x {b} y")], "doc_id long, text string")
    assert {r.doc_id: r.n_dup_lines for r in quality_rules.quality(docs).collect()} == dict.fromkeys(range(1, 6), 0)
    assert {r.component_id for r in set_join.linked(docs).collect()} == {1, 2, 3, 4, 5}
    shared = spark.createDataFrame([(1, a), (2, "q" + b)], "doc_id long, text string")
    long = 400
    same = any(a[i:i + long] in b for i in range(n - long + 1))
    assert (substring_dedup.deduplicated(shared, long).agg({"n_removed": "max"}).first()[0] > 0) == same


def test_field_arithmetic_matches_integers():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, tb._FIELD, 1000, dtype=np.uint64) for _ in range(2))
    assert [int(x) for x in tb.times(a, b)] == [int(x) * int(y) % tb._FIELD for x, y in zip(a, b)]
    top = np.full(3, tb._FIELD - 1, np.uint64)
    assert [int(x) for x in tb.times(top, top)] == [(tb._FIELD - 1) ** 2 % tb._FIELD] * 3
    data = rng.integers(0, 256, 700, dtype=np.uint8)
    assert int(tb.prefix(data, False)[-1]) == sum((int(x) + 1) * pow(tb._BASE, i, tb._FIELD) for i, x in enumerate(data)) % tb._FIELD


def test_spans_of_texts_over_many_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    data[4000:4300] = data[90:390]
    whole = tb.span_hash(tb.prefix(data, True), np.array([90, 4000, 91]), np.array([390, 4300, 391]))
    monkeypatch.setattr(tb, "_PIECE", 256)
    monkeypatch.setattr(tb, "_STEP", 64)
    tb.powers.cache_clear()
    pieces = tb.span_hash(tb.prefix(data, True), np.array([90, 4000, 91]), np.array([390, 4300, 391]))
    tb.powers.cache_clear()
    assert whole.tolist() == pieces.tolist() and whole[0] == whole[1] != whole[2]

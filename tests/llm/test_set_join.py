import re
from collections import defaultdict

import numpy as np
import pytest

from tracklore.llm import set_join, store
from tracklore.llm.components import components, extended

from .conftest import table

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text, k=4):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(rows, k=4, percent=85):
    sets = [(d, shingle_set(t, k)) for d, t in rows]
    distinct = list(dict.fromkeys(s for _, s in sets if s))
    parent = list(range(len(distinct)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(distinct):
        for x in s:
            where[x].append(i)
    for i, s in enumerate(distinct):
        common = defaultdict(int)
        for x in s:
            for j in where[x]:
                common[j] += j < i
        for j, both in common.items():
            if 100 * both >= percent * (len(s) + len(distinct[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    smallest = defaultdict(list)
    number = {s: i for i, s in enumerate(distinct)}
    for d, s in sets:
        if s and d is not None:
            smallest[find(number[s])].append(d)
    return sorted(((d, len(s), min(smallest[find(number[s])], default=None) if s else d) for d, s in sets), key=repr)


def test_join_matches_brute_force(spark, docs, rows, none):
    assert table(set_join.linked(docs)) == brute(rows)
    assert set_join.linked(none).collect() == []


def test_join_matches_brute_force_on_a_table(spark, sf):
    documents = spark.read.parquet(f"{sf[:-5]}0.01/documents.parquet")
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert table(set_join.linked(documents)) == brute(rows)


def test_chains_of_edits_link_through_each_other(spark):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        words[10 * i] = f"new{i}"
        rows.append((40 - i, " ".join(words)))
    got = set_join.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["component_id"] for r in got} == {1} and table(spark.createDataFrame(got)) == brute(rows)


@pytest.mark.parametrize("size", [6, 7, 9, 13, 14, 20, 35, 60, 90, 150, 400, 1000])
def test_linked_sets_share_a_signature(size):
    rng = np.random.default_rng(size)
    for trial in range(60):
        a = rng.integers(0, 1 << 62, size).astype(np.uint64)
        apart = 15 * 2 * size // 185
        cut = int(rng.integers(0, apart + 1))
        b = np.concatenate([a[cut:], rng.integers(0, 1 << 62, int(rng.integers(0, apart - cut + 1))).astype(np.uint64)])
        both = len(a) - cut
        if 185 * both < 85 * (len(a) + len(b)):
            continue
        sig, doc = set_join.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)]), 85)
        assert set(sig[doc == 0].tolist()) & set(sig[doc == 1].tolist()), (trial, cut, len(b))


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_linked_sets_of_any_threshold_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for size in [*range(1, 40), *range(40, 1500, 61)]:
        apart = (100 - percent) * 2 * size // (100 + percent)
        cut = int(rng.integers(0, apart + 1))
        a = rng.integers(0, 1 << 62, size).astype(np.uint64)
        b = np.concatenate([a[cut:], rng.integers(0, 1 << 62, int((100 - percent) * size / percent) if not cut else int(rng.integers(0, apart - cut + 1))).astype(np.uint64)])
        if (100 + percent) * (size - cut) < percent * (len(a) + len(b)):
            continue
        sig, doc = set_join.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)]), percent)
        assert set(sig[doc == 0].tolist()) & set(sig[doc == 1].tolist()), (size, cut, len(b))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def recorded(monkeypatch):
    """(name, number of rows) of the tables that are kept from now on."""
    seen, kept = [], store.kept

    def counted(df, name):
        out = kept(df, name)
        seen.append((name, out.count()))
        return out

    monkeypatch.setattr(store, "kept", counted)
    return seen


def test_edges_inside_a_component_are_read_once(spark, monkeypatch):
    pairs = [(i, j) for i in range(50) for j in range(i)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7), (200, 200), (250, 251), (251, 250)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    seen = recorded(monkeypatch)
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(50)} | {i: 100 for i in range(100, 131)} | {200: 200, 250: 250, 251: 250}
    assert [n for name, n in seen if name == "edges"] == [50 * 49 // 2 + 30 + 3, 0]


def test_more_edges_extend_components_without_reading_the_first(spark, monkeypatch):
    rng = np.random.default_rng(8)
    first, more = ([tuple(int(x) for x in p) for p in rng.integers(0, 400, (n, 2))] for n in (150, 120))
    df = lambda pairs: spark.createDataFrame(pairs, "a long, b long").repartition(3)
    root, want = components(df(first)), components(df(first + more))
    seen = recorded(monkeypatch)
    named = lambda of: {r["node"]: r["root"] for r in of.collect() if r["node"] != r["root"]}
    assert named(extended(root, df(more))) == named(want)
    assert max(n for name, n in seen if name == "edges") <= len(more)


def test_suspected_sets_of_many_groups_are_connected_once_a_task(spark, monkeypatch):
    monkeypatch.setattr(set_join, "SKETCHES", 2000)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 120).astype(np.uint64)
    sets = [np.unique(np.append(base, rng.integers(0, 1 << 62, 3).astype(np.uint64))) for _ in range(40)]
    sketch = set_join.sketched(spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "node long, tokens binary"))
    rest = spark.createDataFrame([(100 + g, i, i) for g in range(30) for i in range(40) if i != g], "sig long, node long, root long")
    got = set_join.suspected(rest, sketch, 85).collect()
    assert {r["node"]: r["root"] for r in components(spark.createDataFrame(got)).collect()} == dict.fromkeys(range(40), 0)
    assert len(got) <= 4 * 39  # four tasks


def test_stars_connect_what_the_edges_connect(monkeypatch):
    rng = np.random.default_rng(9)
    edges = [tuple(int(x) for x in p) for p in rng.integers(0, 300, (260, 2))]

    def groups(some):
        parent = {}
        set_join.forest(some, parent)
        return {x: set_join.top(parent, x) for x in range(300)}

    whole = list(set_join.stars(edges * 3))
    assert len(whole) == 1 and all(a < b for a, b in whole[0]) and len({b for _, b in whole[0]}) == len(whole[0])
    assert groups(whole[0]) == groups(edges)
    monkeypatch.setattr(set_join, "NODES", 20)
    parts = list(set_join.stars(edges * 3))
    assert len(parts) > 5 and all(len(p) <= 21 for p in parts) and groups(e for p in parts for e in p) == groups(edges)


@pytest.mark.parametrize("shingles,sketches", [(300, 1000), (100_000, 1 << 18)])
def test_families_of_many_components_are_compared_in_blocks(spark, monkeypatch, shingles, sketches):
    monkeypatch.setattr(set_join, "SHINGLES", shingles)
    monkeypatch.setattr(set_join, "SKETCHES", sketches)
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):  # copies with edits of their own: some pairs are linked, most are not
        words = list(base)
        for k in rng.choice(120, int(rng.integers(1, 6)), replace=False):
            words[k] = f"e{i}-{k}" if rng.random() < 0.8 else f"e{k}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert table(set_join.linked(df)) == brute(rows)


def test_sketches_never_hide_a_link_and_tell_most_others(spark):
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 1 << 62, int(n)).astype(np.uint64)) for n in rng.integers(1, 500, 60)]
    sets = base + [np.unique(np.append(s[rng.random(len(s)) > d], rng.integers(0, 1 << 62, int(d * len(s))).astype(np.uint64))) for s in base for d in (0.02, 0.07, 0.3)]
    sets = [s for s in sets if len(s)]
    table_ = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "node long, tokens binary")
    sketch = set_join.sketched(table_)
    of = {r.node: r for r in sketch.collect()}
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if i < j and (j - len(base)) // 3 == i or rng.random() < 0.02 and i < j]
    both = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    linked = {(i, j) for i, j in pairs if 185 * both(i, j) >= 85 * (len(sets[i]) + len(sets[j]))}
    kept = {(r.a, r.b) for r in set_join.close(spark.createDataFrame(pairs, "a long, b long"), sketch, 85).collect()}
    assert linked <= kept and len(kept) < len(linked) + 30 and len(linked) > 60
    n = np.array([of[i].n for i in range(len(sets))])
    edges = set_join.unproved(np.arange(len(sets)), np.arange(len(sets)), np.zeros(len(sets), int), n, [of[i].bits for i in range(len(sets))], 85)
    groups = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(groups[i] == groups[j] for i, j in linked)


def test_products_find_what_joins_components():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 400, 200).astype(np.uint64)) for _ in range(20)]
    sets += [np.unique(np.append(s[:-5], rng.integers(500, 900, 4).astype(np.uint64))) for s in sets]
    n = len(sets)
    both = lambda a, b: len(set(a.tolist()) & set(b.tolist()))
    want = {(i, j) for i in range(n) for j in range(i) if 185 * both(sets[i], sets[j]) >= 85 * (len(sets[i]) + len(sets[j]))}
    for side in (np.zeros(n, int), np.arange(n) % 2, (np.arange(n) >= 20).astype(int)):
        got = set_join.products(np.arange(n), np.arange(n), side, sets, 85)
        expected = {(i, j) for i, j in want if side[i] != side[j] or not side.any()}
        assert {(max(p), min(p)) for p in got} <= expected and len(got) == len(expected)

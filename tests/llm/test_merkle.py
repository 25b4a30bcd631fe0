import hashlib
import zlib

from pyspark.sql import functions as F

from tracklore.llm import merkle as mk

from .conftest import table

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def fold(nodes, place, path):
    """Root of a list of digests; the runs that `place` passes are added to path as (run, place in it)."""
    while len(nodes) > 1:
        runs = [nodes[i:i + 16] for i in range(0, len(nodes), 16)]
        if path is not None:
            path.append((runs[place // 16], place % 16))
        nodes, place = [H(*r) for r in runs], place // 16
    return nodes[0]


def brute(rows):
    first = lambda v: (v is not None, v)
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    kept = {s: sorted(by[s], key=lambda r: (first(r[0])[0], r[0] or 0, leaf(r, r[4]))) for s in sources}
    subroots = [fold([leaf(r, r[4]) for r in kept[s]], 0, None) for s in sources]
    root = fold(subroots, 0, None)
    out = []
    for g, s in enumerate(sources):
        leaves = [leaf(r, r[4]) for r in kept[s]]
        for i, r in enumerate(kept[s]):
            path = []
            fold(leaves, i, path)
            fold(subroots, g, path)
            proof = H(*(d for run, at in path for j, d in enumerate(run) if j != at))
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = text.translate({c: c + 32 for c in range(65, 91)})
            own = leaf(r, text)
            for run, at in path:
                own = H(*run[:at], own, *run[at + 1:])
            out.append((r[0], leaves[i], subroots[g], root, proof, own, own == root))
    return sorted(out, key=repr)


def made():
    rows = [(i, "hot", "en", i % 7, f"Text {i} ÄÖ") for i in range(700)] + [(i, "Füü", None, None, "UPPER") for i in range(16)]
    rows += [(i, f"src{i}", "de", 1, None) for i in range(40)] + [(i, None, "fr", 3, "lower only") for i in range(17)]
    return rows + [(None, "hot", None, None, None)] * 3 + [(5, "hot", "en", 5, "Other")] + [(9, "Füü", None, None, "UPPER")] * 40 + [(1, "", "", 0, "")]


def test_proofs_match_brute_force(spark, none):
    rows = made()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 as g", "2 as place", "'x' as digest", "'y' as children", "3 as m", "'z' as top")
    got = table(mk.verified(docs))
    assert got == brute(rows)
    assert {r[-1] for r in got} == {True, False}


def test_small_tables(spark):
    for rows in ([], [(1, "a", "en", 1, "X")], [(None, None, None, None, None)], [(i, "a", "en", 1, "X") for i in range(16)], [(i, str(i), "en", 1, "x") for i in range(17)]):
        assert table(mk.verified(spark.createDataFrame(rows, SCHEMA))) == (brute(rows) if rows else [])


def test_requests_for_some_rows_and_records_once(spark):
    rows = made()
    m = mk.manifest(spark.createDataFrame(rows, SCHEMA))
    assert m.records.count() == m.records.select("digest").distinct().count()
    some = mk.proofs(m, m.leaves.where("place % 97 = 3"))
    whole = mk.proofs(m, m.leaves)
    key = ["g", "place", "leaf", "path"]
    assert table(some.select(*key)) == table(whole.where("place % 97 = 3").select(*key))
    assert some.where(mk.folded(F.col("path"), F.col("leaf")) != m.root).count() == 0

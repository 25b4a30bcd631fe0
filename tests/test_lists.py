"""Items of lists looked up by blocks: brute force on odd keys and tables, small blocks, few rows at the table."""

import random
from itertools import groupby

import pyarrow as pa
from pyspark.sql import functions as F

from tracklore.operators import corpus as C
from tracklore.operators import lists


def expected(rows, table, missing, drop=()):
    out = {}
    for key, items in rows:
        for place, x in enumerate(items or []):
            if x is not None and x not in drop:
                out.setdefault(key, []).extend((place, missing if v is None else v) for t, v in table for _ in [0] if t == x)
                if all(t != x for t, _ in table):
                    out[key].append((place, missing))
    return {k: [v for _, v in sorted(x)] for k, x in out.items()}


def many(seed):
    rnd = random.Random(seed)
    words = [None, "", "é", "日本", *"abcdefgh", *(f"w{i}" for i in range(300))]
    keys = [None, *range(40), 7, 7, 7, None]
    return [(k, None if rnd.random() < 0.05 else [rnd.choice(words) for _ in range(rnd.randrange(30))]) for k in keys] + [(99, [None]), (98, [])]


def test_encode_and_decode_equal_brute_force(spark):
    rows = many(3)
    vocab = [(w, 4 + i) for i, w in enumerate(["", "a", "b", "é", "日本", *(f"w{i}" for i in range(0, 300, 2))])]
    vocab += [("a", 400), ("w4", None), (None, 500), ("z", 4)]  # a token with two ids, one without, an id with two tokens
    docs = spark.createDataFrame(rows, "doc_id long, w array<string>")
    voc = spark.createDataFrame(vocab, "token string, id long")
    ids = C.encode(docs, F.col("w"), voc, "doc_id")
    assert [t for _, t in ids.dtypes] == ["bigint", "array<bigint>"]
    got = ids.collect()
    assert len(got) == len({r.doc_id for r in got})
    assert {r.doc_id: r.ids for r in got} == expected(rows, vocab, 3)
    given = [(k, None if w is None else [1, 2, *(None if x is None else len(x) for x in w), 5, 6]) for k, w in rows]
    text = C.decode(spark.createDataFrame(given, "doc_id long, ids array<long>"), voc, "doc_id").collect()
    back = expected(given, [(i, t) for t, i in vocab], "<UNK>", (0, 1, 2))
    assert len(text) == len(back) and {r.doc_id: r.text for r in text} == {k: " ".join(v) for k, v in back.items()}


def test_no_rows_and_keys_of_text(spark):
    voc = spark.createDataFrame([("a", 4)], "token string, id long")
    docs = spark.createDataFrame([("x", ["a", "q"]), (None, ["q"]), ("x", ["b"]), ("", ["a"])], "k string, w array<string>")
    assert C.encode(docs.where("k = 'none'"), F.col("w"), voc, "k").collect() == []
    assert sorted(((r.k, r.ids) for r in C.encode(docs, F.col("w"), voc.where("id < 0"), "k").collect()), key=str) == [
        ("", [3]), ("x", [3, 3, 3]), (None, [3])]
    assert {r.k: r.ids for r in C.encode(docs, F.col("w"), voc, "k").collect()} == {"x": [3, 4, 3], None: [3], "": [4]}


def test_only_distinct_tokens_of_blocks_meet_the_vocabulary(spark, monkeypatch):
    met = []
    real = C.lookup_ids
    monkeypatch.setattr(C, "lookup_ids", lambda tokens, *a: met.append(tokens.count()) or real(tokens, *a))
    monkeypatch.setattr(lists, "_together", None)  # keys differ, documents stay where they are
    docs = spark.range(400).select("id", F.split(F.repeat(F.lit("a b c d "), 250), " ").alias("w"))
    voc = spark.createDataFrame([("a", 4), ("c", 5)], "token string, id long")
    ids = C.encode(docs, F.col("w"), voc, "id")
    text = C.decode(ids, voc, "id")
    assert ids.where(F.array_contains("ids", 5)).count() == text.where("text like 'a <UNK> c <UNK> a%'").count() == 400
    assert met and max(met) <= 5 * 8  # 400,400 tokens, a block a task


def test_small_blocks_hold_whole_keys(tmp_path, monkeypatch):
    monkeypatch.setattr(lists, "BLOCK", 300)
    monkeypatch.setattr(lists, "BATCH", 64)
    monkeypatch.setattr(lists, "SLICE", 16)
    rows = sorted(many(5), key=lambda r: (r[0] is not None, r[0] or 0))
    given = pa.table({"key": pa.array([k for k, _ in rows], pa.int64()), "items": pa.array([w for _, w in rows], pa.list_(pa.string()))})
    asked = list(lists._coded(given.to_batches(max_chunksize=3), str(tmp_path)))
    found = [(b.column(0)[0].as_py(), b.column(1)[0].as_py() + i, x.upper()) for b in asked for i, x in enumerate(b.column(2)[0].as_py() or [])]
    found.sort()
    table = pa.table({"__block": pa.array([f[0] for f in found]), "code": pa.array([f[1] for f in found], pa.int32()), "value": [f[2] for f in found]})
    files = [f for b in lists._resolved(table.to_batches(max_chunksize=7), str(tmp_path)) for f in zip(*(c.to_pylist() for c in b.columns))]
    assert len(files) == len({f[0] for f in found}) == len(list(groupby(f[0] for f in found))) > 5
    got = [(k, v) for f in files for keys, values in lists._read(*f, str(tmp_path)) for k, v in zip(keys.to_pylist(), values.to_pylist())]
    words = {x for _, w in rows for x in w or [] if x is not None}
    assert len(got) == len(dict(got)) and dict(got) == expected(rows, [(x, x.upper()) for x in words], None)
    assert sorted((k for b in asked for k in b.column(3)[0].as_py() or []), key=str) == sorted((k for k, w in rows if w), key=str)

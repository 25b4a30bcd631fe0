from pyspark.sql import functions as F

import corpus_pipeline
from tracklore.llm import packing, pseudonyms, quality_rules, store

from .conftest import PASSAGE, table
from .test_rules import contaminated
from .test_set_join import brute as linked


def prepared(spark, docs, tmp_path, items):
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_stages_match_brute_force(spark, docs, rows, tmp_path):
    items = [(1, PASSAGE)]
    sf = prepared(spark, docs, tmp_path, items)
    now = spark.read.parquet(f"{sf}/documents.parquet")
    names = now.columns
    plain = sorted(set(rows), key=repr)
    assert len(plain) == len(rows)
    good = {(r["doc_id"], r["text"]) for r in now.collect()} & {(d, t) for d, t in rows if t and len(t.split()) >= 50 and d not in (12, 19, 20, 21)}
    steps = dict(corpus_pipeline.STAGES)
    now = store.kept(steps["quality_rules"](spark, now, sf), "s1")
    assert now.columns == names and {(r["doc_id"], r["text"]) for r in now.collect()} == good
    numbered = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    group = [g for _, _, g in sorted(linked([(i, t) for i, (_, t) in enumerate(numbered)]))]
    first = {numbered[i] for i, g in enumerate(group) if g == i}
    now = store.kept(steps["near_duplicates"](spark, now, sf), "s2")
    assert now.columns == names and {(r["doc_id"], r["text"]) for r in now.collect()} == first and now.count() == len(first)
    bad = {r[0] for r in contaminated(sorted(first, key=repr), items) if r[-1]}
    clean = {r for r in first if r[0] not in bad}
    assert 0 < len(clean) < len(first)
    now = store.kept(steps["decontamination"](spark, now, sf), "s3")
    assert now.columns == names and {(r["doc_id"], r["text"]) for r in now.collect()} == clean
    now = store.kept(steps["pseudonyms"](spark, now, sf), "s4")
    want = {(d, pseudonyms.masked(t, __import__("hashlib").sha256(corpus_pipeline.KEY.encode()).digest())[0]) for d, t in clean}
    assert now.columns == names and {(r["doc_id"], r["text"]) for r in now.collect()} == want
    last = steps["packing"](spark, now, sf)
    digest = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert table(last.select(*digest)) == table(packing.packed(spark, now).select(*digest))
    assert table(corpus_pipeline.run(spark, sf).select(*digest)) == table(last.select(*digest))


def between_the_rules():
    """Pairs with a 5-word similarity from 0.8 up and a 4-word one below 0.85, and pairs below 0.8 by 5 words."""
    def changed(words, n):
        return [f"new{i}" if i % (len(words) // n) == len(words) // n // 2 and i // (len(words) // n) < n else w for i, w in enumerate(words)]

    texts, linked_ = [], []
    for j, (size, tail, edits, near) in enumerate([(400, 71, 0, True), (400, 99, 0, True), (400, 100, 0, False), (100, 0, 2, True), (1000, 0, 21, True), (1000, 0, 22, True), (1000, 0, 23, False), (60, 0, 1, True), (70, 15, 0, True), (70, 17, 0, False)]):
        words = [f"p{j}w{i}" for i in range(size)]
        other = (changed(words, edits) if edits else words) + [f"p{j}t{i}" for i in range(tail)]
        texts += [(2 * j, " ".join(words)), (2 * j + 1, " ".join(other))]
        linked_.append(near)
    return texts, linked_


def test_near_duplicates_are_linked_by_five_words_and_80_percent(spark, rows):
    pairs, near = between_the_rules()
    data = sorted({(d, t) for d, t in rows if t and t.strip() and d is not None and d not in (8,)}) + [(1000 + d, t) for d, t in pairs]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    first = {d for d, _, g in linked(data, k=5, percent=80) if d == g}
    assert [1001 + 2 * j not in first for j in range(len(near))] == near
    apart = {d for d, _, g in linked(data) if d == g}
    assert sum(1001 + 2 * j in apart and n for j, n in enumerate(near)) >= 5
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, df, None)
    assert {r["doc_id"] for r in got.collect()} == first and got.count() == len(first)


def test_an_empty_table_passes_all_stages(spark, docs, tmp_path):
    sf = prepared(spark, docs.limit(0), tmp_path, [(1, "x")])
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_columns_named_like_measurements_are_kept(spark):
    df = spark.createDataFrame([(1, "word " * 60 + "end", 0, 7), (2, "few", 999, 8)], "doc_id long, text string, n_words int, fail_bits int")
    assert quality_rules.accepted(df).columns == df.columns and quality_rules.accepted(df).collect() == []

"""Readers and writers on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore.operators import corpus as C
from tracklore.operators import learner as L
from tracklore.operators import similarity as S
from tracklore.sources import readers as R
from tracklore.sources import writers as W


def test_transcripts_sniff_clean_and_override(spark, tmp_path):
    a, b = tmp_path / "a.tsv", tmp_path / "b.csv"
    a.write_text("SENTENCE_NAME\tSENTENCE\nx1-rgb_front\told\ny\tkeep\nz\t\n")
    b.write_text("video_id,transcript\nx1,new\n")
    got = {r.clip_id: r.text for r in R.transcripts(spark, [str(a), str(b)]).collect()}
    assert got == {"x1-rgb_front": "old", "x1": "new", "y": "keep"}


def test_transcripts_of_unknown_headers_take_first_and_last_column(spark, tmp_path):
    files = {"a.csv": "foo,bar,baz\nx1,1,one\n", "b.csv": "clip_id,bar,baz\nx2,2,two\n", "c.tsv": "foo\ttext\tbar\nx3\tthree\t3\n", "d.csv": "sentence_name,said\nx4,four\n"}
    for name, content in files.items():
        (tmp_path / name).write_text(content)
    got = {r.clip_id: r.text for r in R.transcripts(spark, [str(tmp_path / n) for n in files]).collect()}
    assert got == {"x1": "one", "x2": "two", "x3": "three", "x4": "four"}


def test_nested_index_shifts_start(spark, tmp_path):
    p = tmp_path / "i.json"
    p.write_text(json.dumps([{"gloss": "BOOK", "instances": [
        {"video_id": "1", "split": "train", "frame_start": 1, "frame_end": -1, "signer_id": 2}]}]))
    r = R.nested_index(spark, str(p)).first()
    assert (r.gloss, r.frame_start, r.split) == ("book", 0, "train")


def test_split_and_partition_files(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("Participant ID,Video file,Gloss,ASL-LEX Code\nP1 , v.mp4,HI,A_1\n")
    r = R.split_csvs(spark, {"train": str(p), "val": str(p)}).collect()
    assert {x.split for x in r} == {"train", "val"} and r[0].participant == "P1"
    q = tmp_path / "q.csv"
    q.write_text("filename,label,partition\na,hello,dev\nb,,train\nc,x,test\n")
    assert {x.filename: x.split for x in R.partitioned_index(spark, str(q)).collect()} == {"a": "val", "c": "test"}


def test_keypoint_arrays(spark, tmp_path):
    np.save(tmp_path / "ok.npy", np.arange(2 * 133 * 3, dtype=float).reshape(2, 133, 3))
    np.save(tmp_path / "flat.npy", np.zeros((3, 180)))
    np.save(tmp_path / "bad.npy", np.zeros((3, 7, 3)))
    rows = R.keypoint_arrays(spark, str(tmp_path)).collect()
    assert {r.clip_id for r in rows if r.reason} == {"bad"}
    first = next(r for r in rows if r.clip_id == "ok" and r.frame_idx == 0)
    assert first.kps[0].x == 91 * 3 and len(first.kps) == 60
    assert sum(r.clip_id == "flat" for r in rows) == 3


def test_media_names_and_listing(spark, tmp_path):
    for n in ("A.mp4", "food_red_apple.mp4", "wave.mp4"):
        (tmp_path / n).write_bytes(b"x")
    c = R.media_catalog(spark, str(tmp_path))
    got = {r.file: (r.category, r.title) for r in c.collect()}
    assert got == {"A.mp4": ("Alphabet", "ASL Letter: A"), "food_red_apple.mp4": ("food", "red_apple"), "wave.mp4": ("General", "wave")}
    assert R.media_listing(c).count() == 3
    assert [r.id for r in R.number_rows(c).orderBy("file").collect()] == [1, 2, 3]


def test_metrics_csv_tolerates_bad_lines(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("epoch,acc\n1,0.5\n2,x,y\n3,0.75\n")
    assert [r.accuracy for r in R.training_metrics(spark, str(p)).orderBy("epoch").collect()] == [0.5, 0.75]


def test_parallel_corpus_and_audit_log(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text("id,gloss,text\n1,ME GO,I go\n2,,x\n")
    assert [tuple(r) for r in R.parallel_corpus(spark, str(p)).collect()] == [("ME GO", "I go")]
    j = tmp_path / "log.json"
    j.write_text('{"EventType":"Login","Status":"Success","Timestamp":"2024-01-01T00:00:00Z"}\n')
    assert R.audit_log(spark, str(j)).first().EventType == "Login"


def test_sharded_write_resume_and_manifest(spark, tmp_path):
    df = spark.range(23).select(
        F.col("id"), F.when(F.col("id") < 20, "train").otherwise("val").alias("split"), F.lit("s").alias("source"), F.lit("ab").alias("text"))
    W.write_sharded(df.coalesce(1), str(tmp_path / "c"), 5)
    got = {r.split: (r.shards, r.rows, r.largest) for r in W.shard_counts(spark.read.parquet(str(tmp_path / "c"))).collect()}
    assert got == {"train": (4, 20, 5), "val": (1, 3, 3)}
    assert W.resume_filter(df, df.where("id < 9"), "id").count() == 14
    assert {r.split: r.breakdown for r in W.manifest(df).collect()} == {"train": '{"s":20}', "val": '{"s":3}'}


def test_vocab_gaps(spark):
    v = spark.createDataFrame([(i, f"w{i}") for i in (0, 1, 2, 4, 5, 9)], "id long, token string")
    r = C.vocab_contiguity(v).first()
    assert (r.min_id, r.max_id, r.missing, r.duplicates, r.negative) == (0, 9, 4, 0, 0)
    assert sorted(x.id for x in C.missing_ids(v).collect()) == [3, 6, 7, 8]


def test_sm2_server_branches(spark):
    rows = [("a", 1, q, i) for i, q in enumerate([5.0, 5.0, 5.0, 2.9, 3.0])]
    rows += [("b", 1, q, i) for i, q in enumerate([5.0, 4.0, 3.0])]
    rows += [("long", 1, 5.0, i) for i in range(150)]
    df = spark.createDataFrame(rows, "user_id string, item int, quality double, event_id int").withColumn(
        "ts", F.timestamp_seconds(F.col("event_id") * 3600))
    got = {r.user_id: r for r in L.sm2_server(df, ["user_id", "item"], ["ts", "event_id"], F.floor(F.col("event_id") / 4)).collect()}
    assert (got["a"].repetitions, got["a"].interval) == (1, 1)
    assert (got["b"].repetitions, got["b"].interval, round(got["b"].ease, 2)) == (3, 8, 2.46)
    assert got["long"].interval == L.MAX_INT and abs(got["long"].ease - 17.5) < 1e-6


def test_codebook_by_kmeans(spark):
    df = spark.createDataFrame([(i, [float(i % 2) * 10, 0.0]) for i in range(20)], "id int, v array<double>")
    codes = S.fit_codes(df, "v", 2)
    out = S.nearest_code(df, "id", "v", codes, "code", "centre").collect()
    assert len({r.code for r in out}) == 2 and max(r.distance for r in out) < 1e-9


def _records(spark, n, text="ab"):
    return spark.range(n).repartition(5).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "01").when(F.col("id") % 3 == 1, "val").alias("split"), F.lit(text).alias("text"))


def test_packed_shards_are_exact_and_committed_last(spark, tmp_path):
    path = str(tmp_path / "c")
    with pytest.raises(FileNotFoundError):
        W.read_packed(spark, path)
    df = _records(spark, 100)
    totals = {r.split: (r.shards, r.rows, r.largest, r.last_rows) for r in W.pack(df, path, "v1", rows=8, invariants={"text": F.col("text") == "ab"}).collect()}
    assert totals == {"01": (5, 34, 8, 2), "val": (5, 33, 8, 1), None: (5, 33, 8, 1)}
    back = W.read_packed(spark, path)
    assert sorted((r.split or "", r.shard, r.place, r.id) for r in back.collect()) == sorted(
        (("01", "val", "")[i % 3], i // 3 // 8, i // 3, i) for i in range(100))
    # a second run of a committed version changes nothing
    W.pack(_records(spark, 7, "zz"), path, "v1", rows=8)
    assert W.read_packed(spark, path).count() == 100 and W.commits(spark, path).count() == 3


def test_a_run_that_dies_leaves_the_former_version_and_can_run_again(spark, tmp_path):
    path = str(tmp_path / "c")
    W.pack(_records(spark, 30), path, "v1", rows=8)
    with pytest.raises(ValueError, match="not committed"):
        W.pack(_records(spark, 50), path, "v2", rows=8, invariants={"text": F.col("text") == "other"})
    assert (tmp_path / "c" / "data" / "v2").exists()
    assert W.read_packed(spark, path).count() == 30
    W.pack(_records(spark, 40), path, "v2", rows=8)
    assert W.read_packed(spark, path).count() == 40 and W.read_packed(spark, path, "v1").count() == 30


def test_packing_an_empty_table_commits_no_split(spark, tmp_path):
    W.pack(_records(spark, 0), str(tmp_path / "c"), "v1", rows=8)
    assert W.read_packed(spark, str(tmp_path / "c")).count() == 0


def test_micro_shards_clear_odd_values(spark):
    parts = spark.createDataFrame([("a", [1.0, float("nan"), float("inf"), float("-inf")]), ("b", [])], "label string, features array<double>")
    vocab = spark.createDataFrame([("a", 7)], "token string, id long")
    got = {r.label: (r.label_idx, r.features) for r in W.merge_micro_shards(parts, vocab).collect()}
    assert got == {"a": (7, [1.0, 0.0, 0.0, 0.0]), "b": (-1, [])}

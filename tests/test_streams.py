"""Machines on hand-made frames, and the stream against its batch twin."""

import random
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore.streaming import guard as G
from tracklore.streaming import machines as M
from tracklore.streaming import run as R


def spell(machine, frames):
    return [e for f in frames for e in machine.step(f)]


def hold(letter, n, conf=0.9):
    return [(letter, conf)] * n


def test_words_sentence_and_pauses():
    out = spell(M.LetterStabilizer(), hold("H", 8) + hold(None, 5) + hold("I", 8) + hold(None, 60))
    assert [e[:2] for e in out] == [("LETTER", "H"), ("LETTER", "I"), ("SPACE", None), ("END", None), ("SPACE", None)]
    assert out[3][2] == "HI"


def test_double_letter_by_hold_and_by_release():
    held = spell(M.LetterStabilizer(), hold("L", 6 + 5 + 25))
    assert [e[1] for e in held] == ["L", "L"]
    again = spell(M.LetterStabilizer(), hold("L", 6) + hold(None, 4) + hold("L", 8))
    assert [e[1] for e in again] == ["L", "L"]


def test_weak_frames_commit_nothing():
    assert spell(M.LetterStabilizer(), hold("A", 11, 0.4)) == []


def test_backspace_crosses_words():
    m = M.LetterStabilizer()
    spell(m, hold("A", 8) + hold(None, 12))
    m.backspace()
    assert (m.words, m.word) == ([], "A")


def test_noisy_words_are_recovered():
    rnd = random.Random(9)
    frames = []
    for ch in "CAT":
        frames += [(rnd.choice("XYZ") if rnd.random() < 0.1 else ch, 0.9) for _ in range(12)] + hold(None, 4)
    text = [e for e in spell(M.LetterStabilizer(), frames + hold(None, 50)) if e[0] == "END"][0][2]
    assert text == "CAT"


def test_rate_limit_window():
    m = M.RateLimit()
    got = [m.step((i, t))[0][1:] for i, t in enumerate([0, 1, 2, 3, 4, 5, 899, 900, 900.5])]
    assert [g[0] for g in got] == [True] * 5 + [False] * 3 + [True]
    assert got[5][1] == 895


def test_stroke_z():
    m = M.StrokeTracker(1.0)
    path = [(0, 0)] * 3 + [(0.3, 0)] * 3 + [(0.6, 0)] * 3 + [(0.6, 0.6)] * 3 + [(1.2, 0.6)] * 3
    out = [e for f, (x, y) in enumerate(path) for e in m.step((f, x, y, 0, 0, "D", 0.9))]
    assert [e[1] for e in out] == ["Z"]


def test_chunks_close_at_pause_or_when_full():
    m = M.AdaptiveChunk(3, 5)
    out = [e for f, p in enumerate([0, 1, 0, 1, 0, 0, 0, 0, 0]) for e in m.step((f, p))]
    assert out == [(0, 0, 3, False), (1, 4, 8, True)]


def test_guard_repairs_swapped_hands(spark):
    left, right = [-3.0, 0.1, 0.2], [3.0, 0.3, 0.1]
    close = [0.01, 0.0, 0.0], [0.02, 0.0, 0.0]
    given = [(left, right), (right, left), (right, left), (left, right), (right, left), close, (right, left), (left, right)]
    df = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(given)], "clip_id int, frame_idx int, left array<double>, right array<double>")
    wrists, want = None, []
    for a, b in given:  # frame by frame: exchange when that follows the wrists clearly better
        d = lambda p, q: np.linalg.norm(np.subtract(p, q), axis=1).sum()
        swap = wrists is not None and d((a, b), wrists) - d((a, b), wrists[::-1]) > G.SWAP_MARGIN
        wrists = (b, a) if swap else (a, b)
        want.append(bool(swap))
    got = [r.swapped for r in G.orientation(df).orderBy("frame_idx").collect()]
    assert got == want and True in got


def test_open_sentences_and_chunks_are_finished():
    m = M.LetterStabilizer()
    spell(m, hold("A", 8) + hold(None, 12) + hold("B", 8))
    assert m.finish() == [("OPEN", None, "A B")]
    c = M.AdaptiveChunk(3, 5)
    assert [e for f in range(7) for e in c.step((f, 0))] + c.finish() == [(0, 0, 4, True), (1, 5, 6, True)]
    s = M.SlidingCommit(4, 2, 15)
    assert [e for f, t in enumerate([1, 1, 0]) for e in s.step((f, t))] + s.finish() == [(2, [1])]


def test_every_letter_reaches_a_sentence(spark, sf):
    import __spark_entry__ as entry_module

    q = entry_module.queries()
    letters = q["t1_letter_stabilizer"](spark, sf).where("event = 'LETTER'").count()
    texts = q["t2_sentence_buffer"](spark, sf)
    assert texts.agg(F.sum(F.length(F.replace("text", F.lit(" "), F.lit(""))))).first()[0] == letters
    sentences = q["t4_letters_to_sentence"](spark, sf)
    assert sentences.count() == texts.where("text <> ''").count()


@pytest.mark.parametrize("machine,inputs", [
    (M.LetterStabilizer, ["letter", "conf"]), (partial(M.RateLimit, 5, 900.0), ["n", "t"]), (M.OneEuroTrack, ["i", "x", "y", "z"])])
def test_stream_equals_batch(spark, tmp_path, machine, inputs):
    rnd = random.Random(1)
    rows = []
    for s in ("a", "b", "c"):
        for i in range(120):
            letter = "AB"[i // 14 % 2] if i % 30 < 20 else None
            rows.append((s, i, letter, 0.9, i, float(i * 37), rnd.random(), rnd.random(), rnd.random()))
    df = spark.createDataFrame(rows, "session string, i int, letter string, conf double, n int, t double, x double, y double, z double")
    batch = R.fold_batch(df, "session", ["i"], inputs, machine)
    if "event" in batch.columns:
        batch = batch.where("event <> 'OPEN'")  # in arrival order a stream has no end of a session
    src = tmp_path / "in"
    for k in range(3):
        df.where(F.col("i").between(k * 40, k * 40 + 39)).coalesce(1).write.mode("append").parquet(str(src))
    # file order is the order of arrival
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    out = R.fold_stream(stream, "session", ["i"], inputs, machine)
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = (out.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.unset(conf)
    got = spark.read.schema(batch.schema).parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))


def test_event_time_restores_order_drops_late_rows_and_ends_sessions(spark, tmp_path):
    rows = []
    for s in ("a", "b"):
        rows += [(s, i, "AB"[i // 14 % 2] if i % 30 < 20 else None, 0.9) for i in range(120)]
    df = spark.createDataFrame(rows, "session string, i int, letter string, conf double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("i")))
    want = R.fold_batch(df, "session", ["i"], ["letter", "conf"], M.LetterStabilizer)
    later = df.where("i = 0").withColumn("session", F.lit("c"))
    src = tmp_path / "in"
    parts = [df.where(F.col("i").between(k * 40, k * 40 + 39)).orderBy(F.rand(k)) for k in range(3)]  # shuffled within their files
    parts += [later.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000 + 10_000 * k))) for k in (1, 2)]
    parts += [df.where("i = 5").withColumn("letter", F.lit("Z"))]  # hours too late
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    out = R.fold_stream(stream, "session", ["i"], ["letter", "conf"], M.LetterStabilizer, event_time="ts", idle_seconds=600)
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = (out.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.unset(conf)
    got = spark.read.schema(want.schema).parquet(str(tmp_path / "out")).where("session <> 'c'")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_ingest_reads_new_files_once(spark, tmp_path):
    src, dst, cp = (str(tmp_path / n) for n in ("src", "dst", "cp"))
    one = spark.range(3)
    one.write.parquet(src)
    R.ingest_new(spark, one.schema, src, dst, cp)
    spark.range(10, 12).write.mode("append").parquet(src)
    R.ingest_new(spark, one.schema, src, dst, cp)
    assert sorted(r.id for r in spark.read.parquet(dst).collect()) == [0, 1, 2, 10, 11]


def requests_of(rnd, n):
    """Dense and sparse addresses, equal times, gaps of days, and one address with two thirds of the rows."""
    rows, t = [], 0.0
    for i in range(n):
        t += rnd.choice([0.0, 0.0, 0.5, 3.0, 40.0, 900.0, 90_000.0] if i % 400 < 60 else [0.0, 1.0, 2.5])
        rows.append((rnd.choice(["hot", "hot", "b", None, f"x{i % 50}"]), i, t))
    return rows


@pytest.mark.parametrize("chunk", [3, 17, 8192])
def test_rate_limit_by_chunks_equals_the_fold(spark, chunk):
    from tracklore.streaming import limits

    rows = requests_of(random.Random(chunk), 4000)
    machines, want = {}, set()
    for ip, i, t in rows:
        m = machines.setdefault(ip, M.RateLimit(5, 900.0))
        want |= {(ip, *r) for r in m.step((i, t))}
    df = spark.createDataFrame(rows, "ip string, n int, t double").withColumn("node", F.lit(1)).repartition(5)
    got = limits.rate_limit(df, "ip", ["t", "n"], "n", "t", chunk=chunk)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(rows)
    assert {a for _, _, a, _ in want} == {True, False}


def test_rate_limit_tables_stay_small_and_empty_tables_pass(spark):
    from tracklore.streaming import limits

    t = np.cumsum(np.random.default_rng(1).exponential(60.0, 5000))
    pos = np.arange(5000)
    one, two = (limits.chunk_table(t[a:a + 2500], pos[a:a + 2500], 900.0) for a in (0, 2500))
    both, whole = limits.composed(one, two, 900.0), limits.chunk_table(t, pos, 900.0)
    entries = [(t[0] - gap, -1) for gap in (np.inf, 900.0, 500.0, 10.0, 0.0)]
    assert len(one[0]) < 60 and len(both[0]) < 60
    assert [limits.left(both, e, 900.0) for e in entries] == [limits.left(whole, e, 900.0) for e in entries]
    empty = spark.createDataFrame([], "ip string, n int, t double")
    assert limits.rate_limit(empty, "ip", ["t", "n"], "n", "t").count() == 0


def test_runs_of_alike_frames_equal_single_frames():
    import random

    rnd = random.Random(5)
    for kind in (M.LetterStabilizer, M.SlidingCommit):
        one, many, got, want, at = kind(), kind(), [], [], 0
        for _ in range(400):
            n = rnd.choice([1, 2, 7, 14, 40, 90])
            if kind is M.SlidingCommit:
                token = rnd.choice([0, 0, 1, 2])
                want += [e for i in range(at, at + n) for e in one.step((i, token))]
                got += many.run((at, token), n, range(at, at + n))
            else:
                row = (rnd.choice(["A", "B", None, None]), rnd.choice([0.9, 0.9, 0.3]))
                want += [e for _ in range(n) for e in one.step(row)]
                got += many.run(row, n)
            at += n
        assert got + many.finish() == want + one.finish() and len(got) > 20


def test_rows_that_stand_for_frames_are_folded_like_the_frames(spark):
    from pyspark.sql import functions as F

    from tracklore.streaming.run import fold_batch

    rows = [("a", 1, 9, "X"), ("a", 2, 20, "Y"), ("a", 2, 20, "Y"), ("b", 1, 12, None), ("b", 0, 70, "Z")]
    rows = spark.createDataFrame(rows, "session string, t int, n int, letter string")
    frames = lambda r: F.transform(F.sequence(F.lit(0), r["n"]), lambda i: F.struct(
        i.alias("i"), r["letter"].alias("letter"), F.lit(0.9).alias("conf")))
    apart = rows.select("session", "t", F.explode(frames(F.struct(*rows.columns))).alias("f")).select("session", "t", "f.*")
    want = fold_batch(apart, "session", ["t", "i"], ["letter", "conf"], M.LetterStabilizer).collect()
    got = fold_batch(rows, "session", ["t"], ["letter", "conf"], M.LetterStabilizer, frames).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 4

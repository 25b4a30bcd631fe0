"""Time to live on streams next to the batch functions, and notifications."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracklore.sources import readers
from tracklore.streaming import expiring as E
from tracklore.streaming import run as R
from tracklore.streaming import stateless as S

T0 = datetime(2024, 1, 1)
CHECKS = "check_id long, token string, checked_at timestamp"
REVOCATIONS = "token string, revoked_at timestamp, expires_at timestamp"
ENTRIES = "key string, payload string, created_at timestamp, expires_at timestamp"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


@pytest.fixture
def rocks(spark):
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(conf)


def feed(spark, parts, schema, path):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, out, tmp_path):
    q = (out.writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()


def test_revocations_on_a_stream_equal_the_batch_and_are_purged(spark, tmp_path, rocks):
    rnd = random.Random(5)
    checks = [(i, rnd.choice("abcd"), at(rnd.randrange(300))) for i in range(120)]
    revs = [(t, at(s), at(s + rnd.choice([1, 20, 90]))) for t, s in [("a", 10), ("a", 60), ("b", 100), ("b", 101), ("c", 250)]]  # renewed and expired ones
    want = {r.check_id: r.is_revoked for r in S.revoked(spark.createDataFrame(checks, CHECKS), spark.createDataFrame(revs, REVOCATIONS)).collect()}
    assert 5 < sum(want.values()) < 115

    def parts(rows, when, end):
        cut = [[r for r in rows if k * 100 <= (r[when] - T0).total_seconds() < k * 100 + 100] for k in range(3)]
        for c in cut:
            rnd.shuffle(c)
        return [*cut, *end]

    far = [[(1000 + k, "z", at(10_000 * k))] for k in (1, 2)] + [[(2000, "a", at(15))]]  # the last one is hours too late
    c = feed(spark, parts(checks, 2, far), CHECKS, str(tmp_path / "checks"))
    r = feed(spark, parts(revs, 1, [[("z", at(9000 + 10_000 * k), at(9001 + 10_000 * k))] for k in (0, 1)] + [[("z", at(20_001), at(90_000))]]), REVOCATIONS, str(tmp_path / "revs"))
    got = drain(spark, E.revoked_stream(c, r), tmp_path)
    mine = [(x.check_id, x.is_revoked) for x in got if x.token != "z"]
    assert sorted(mine) == sorted(want.items())
    kept = spark.read.format("statestore").option("stateVarName", "machine").load(str(tmp_path / "cp"))
    assert {k.key.token for k in kept.select("key").collect()} == {"z"}


def test_cache_serves_the_newest_entry_and_forgets_expired_ones(spark, tmp_path, rocks):
    rows = [("a", "a1", at(0), at(50)), ("a", "a2", at(40), at(90)), ("b", "b1", at(5), at(500)), ("b", "b0", at(1), at(900)), ("a", "a3", at(130), at(140))]
    first = [r for r in rows if r[2] < at(100)]
    parts = [first[::-1], [("z", "z", at(120), at(121))], [rows[-1]], [("z", "z", at(1000), at(1001))], [("z", "z", at(5000), at(9000))], [("b", "late", at(3), at(9000))]]
    got = drain(spark, E.cache_live_stream(feed(spark, parts, ENTRIES, str(tmp_path / "in")), "key", "10 seconds"), tmp_path)
    log = {k: [(r.payload, r.event) for r in sorted(got, key=lambda r: (r.payload, r.event != "set")) if r.key == k] for k in "ab"}
    assert log == {"a": [("a1", "set"), ("a2", "set"), ("a2", "expired"), ("a3", "set"), ("a3", "expired")],
                   "b": [("b0", "set"), ("b1", "set"), ("b1", "expired")]}
    live = S.cache_live(spark.createDataFrame(first, ENTRIES), F.lit(at(60)), "key").collect()
    assert {(r.key, r.payload) for r in live} == {("a", "a2"), ("b", "b1")}


def test_failed_notifications_are_handed_over_again(spark, tmp_path):
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    spark.createDataFrame([("m1",)], "media string").write.parquet(src)
    rows = lambda: spark.readStream.schema("media string").parquet(src)
    sent = []

    def fails(batch):
        raise OSError("receiver is away")

    with pytest.raises(Exception, match="receiver is away"):
        R.notify_new(rows(), fails, cp)
    keep = lambda batch: sent.extend((r.media, r.batch_id) for r in batch.collect())
    R.notify_new(rows(), keep, cp)
    R.notify_new(rows(), keep, cp)
    assert sent == [("m1", 0)]
    spark.createDataFrame([("m2",), ("m3",)], "media string").coalesce(1).write.mode("append").parquet(src)
    R.notify_new(rows(), keep, cp)
    assert sorted(sent) == [("m1", 0), ("m2", 1), ("m3", 1)]


def test_audit_log_stream_reads_new_files(spark, tmp_path):
    (tmp_path / "log").mkdir()
    for k in range(2):
        (tmp_path / "log" / f"{k}.json").write_text('{"EventType":"Login","Status":"Failure","Timestamp":"2024-01-01T00:0%d:00Z"}\n' % k * (k + 1))
    events = readers.audit_log_stream(spark, str(tmp_path / "log")).select("EventType", "Timestamp")
    assert len(drain(spark, events, tmp_path)) == 3

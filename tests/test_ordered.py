"""Chunked windows equal plain ones, whatever the chunk."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklore.functions.text import natural_key
from tracklore.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    # key 'hot' holds most rows
    data = [("hot" if rnd.random() < 0.7 else f"k{i % 5}", i, rnd.choice([None, rnd.randint(-9, 9)])) for i in range(400)]
    return spark.createDataFrame(data, "k string, t int, v int").cache()


def test_running_matches_window(rows):
    out = ordered.running(rows, ["k"], ["t"], F.floor(F.col("t") / 7), {
        "s": ("sum", F.col("v")), "n": ("count", F.col("v")), "lo": ("min", F.col("v")),
        "hi": ("max", F.col("v")), "last": ("last", F.col("v"))})
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("k", "t", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("n"), F.min("v").over(w).alias("lo"),
                       F.max("v").over(w).alias("hi"), F.last("v", ignorenulls=True).over(w).alias("last"))
    assert sorted(map(str, out.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_previous_matches_lag(rows):
    out = ordered.previous(rows, ["k"], ["t"], F.floor(F.col("t") / 3), {"p": F.col("t")})
    w = Window.partitionBy("k").orderBy("t")
    want = rows.select("k", "t", F.lag("t").over(w).alias("p"))
    assert sorted(map(str, out.select("k", "t", "p").collect())) == sorted(map(str, want.collect()))


def test_positions_and_rank(rows):
    r = rows.where("v is not null")
    p = ordered.positions(r, [F.col("v"), F.col("t")]).collect()
    want = sorted((x.v, x.t) for x in r.collect())
    assert [(x.v, x.t) for x in sorted(p, key=lambda x: x.pos)] == want
    assert sorted(x.pos for x in p) == list(range(1, len(want) + 1))
    ranks = {x.t: x["rank"] for x in ordered.competition_rank(r, "v", parts=5).collect()}
    values = [v for v, _ in want]
    for v, t in want:
        assert ranks[t] == 1 + sum(o > v for o in values)


def test_exact_quantiles(rows):
    q = ordered.exact_quantiles(rows, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 1.0}, parts=4).collect()
    data = rows.where("v is not null").toPandas().groupby("k")["v"]
    for r in q:
        v = data.get_group(r.k)
        assert np.allclose([r.a, r.b, r.c], np.quantile(v, [0.1, 0.5, 1.0]))


def test_positions_use_many_ranges_for_a_common_prefix(spark):
    df = spark.range(200_000).select(F.format_string("a common prefix of names %06d", "id").alias("w"))
    p = ordered.positions(df, [F.col("w")])
    assert p.where("pos <> cast(substring(w, 26) as int) + 1").count() == 0 and p.count() == 200_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few rows share a task
    try:
        assert df.repartitionByRange("w").groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_natural_key_orders_long_numbers(spark):
    names = ["a2", "a10", "a0010", "a" + "9" * 25, "a1" + "0" * 25, "b1", "a2x3", "a2x20"]
    df = spark.createDataFrame([(n,) for n in names], "n string").withColumn("k", natural_key("n"))
    got = [r.n for r in df.orderBy("k", "n").collect()]
    assert got == ["a2", "a2x3", "a2x20", "a0010", "a10", "a" + "9" * 25, "a1" + "0" * 25, "b1"]

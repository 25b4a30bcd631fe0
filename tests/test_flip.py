"""Yaw, masked hands and mirrored frames: rows by hand, and draws that are made once a frame."""

import math

from pyspark.sql import functions as F

from tracklore.operators import poses as P
from tracklore.operators import quality as K


def frames(spark, clips=3, n=12):
    return spark.range(clips * n).select(
        F.floor(F.col("id") / n).alias("clip_id"), (F.col("id") % n).cast("int").alias("frame_idx"),
        F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.struct(
            (i + F.col("id") / 100).alias("x"), (i * 2.0).alias("y"), (1.0 - i).alias("z"), (i % 7 > 0).alias("valid"))).alias("kps"))


def test_yaw_mask_and_flip_by_hand(spark):
    given = {(r.clip_id, r.frame_idx): r.kps for r in frames(spark).collect()}
    f = frames(spark).withColumn("a", F.radians(K._draw(5, "yaw", -15.0, 15.0)))
    angle = {r.clip_id: r.a for r in f.collect()}
    got = K.flip_handedness(K.mask_hand_span(K.yaw(frames(spark), 5), 5, span=4)).collect()
    assert len(got) == 36
    masked = {}
    for r in got:
        turned = [(p.x * math.cos(angle[r.clip_id]) + p.z * math.sin(angle[r.clip_id]), p.y, p.z * math.cos(angle[r.clip_id]) - p.x * math.sin(angle[r.clip_id]), p.valid)
                  for p in given[r.clip_id, r.frame_idx]]
        gone = [i for i, j in enumerate(P.SWAP) if tuple(r.kps[i]) == (0.0, 0.0, 0.0, False) and j < 42]
        if len(gone) == 21:
            masked.setdefault(r.clip_id, []).append(r.frame_idx)
        for i, j in enumerate(P.SWAP):
            if len(gone) < 21 or i not in gone:
                x, y, z, valid = turned[j]
                assert all(abs(a - b) < 1e-9 for a, b in zip(r.kps[i][:3], (-x, y, z))) and r.kps[i].valid == valid
    assert len(masked) == 3 and all(sorted(m) == list(range(min(m), min(m) + 4)) for m in masked.values())


def test_points_are_computed_once_a_frame(spark):
    """Mirrored points are taken out of a bound array, not out of an expression that is computed again for each of them."""
    plan = K.flip_handedness(K.mask_hand_span(K.yaw(frames(spark), 5), 5))
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        text = plan._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    assert "[lambda" in text and ")[lambda" not in text

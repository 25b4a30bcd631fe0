"""Clip quality scores and seeded landmark augmentation."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklore.functions import vectors as V
from tracklore.functions.text import unit
from tracklore.operators import poses as P
from tracklore.operators import tracks

JERK_LIMIT = 50.0  # fixed value: the limit in force where the score is computed


def _clamp(v: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), v))


def sample_quality(frames: DataFrame, conf: Column, blur: Column) -> DataFrame:
    """Weighted detector, anatomy, steadiness, hand presence and sharpness score."""
    seg = tracks.stencil(frames, 1)
    prev = F.lag("kps").over(P.clip_window())
    step = F.zip_with("kps", prev, lambda a, b: P.length(P.sub(P.xyz(a), P.xyz(b))))
    seg = seg.withColumn("__step", F.aggregate(step, F.lit(0.0), lambda a, x: a + x) / F.size("kps"))
    seen = lambda s: F.avg(F.exists(P._hand(s), lambda p: p["valid"]).cast("double"))
    q = tracks.owned(seg).groupBy("clip_id").agg(
        F.avg(conf).alias("conf"), F.avg("__step").alias("step"), F.count(F.lit(1)).alias("n"),
        F.greatest(seen(0), seen(21)).alias("hands"), F.avg(blur).alias("blur"))
    steady = F.when(F.col("n") > 2, _clamp(1 - F.col("step") * 2, 0.0, 1.0)).otherwise(0.90)
    sharp = _clamp(F.col("blur") / 150.0, 0.10, 1.0)
    score = 0.35 * F.col("conf") + 0.25 + 0.20 * steady + 0.10 * F.col("hands") + 0.10 * sharp
    parts = F.create_map(*[x for k, v in (
        ("detector_conf", F.col("conf")), ("anatomy", F.lit(1.0)), ("temporal_stability", steady),
        ("hand_presence", F.col("hands")), ("sharpness", sharp)) for x in (F.lit(k), v)])
    return q.select("clip_id", _clamp(score, 0.10, 1.0).alias("quality"), parts.alias("breakdown"))


def _visible(p: Column) -> Column:
    return (F.abs(p["x"]) > 1e-4) | (F.abs(p["y"]) > 1e-4)


def _visible_sum(frames: DataFrame) -> DataFrame:
    seen = F.filter("kps", _visible)
    return frames.select("*", F.aggregate(seen, F.lit(0.0), lambda a, p: a + p["z"]).alias("__v"), F.size(seen).alias("__m"))


def video_quality(frames: DataFrame) -> DataFrame:
    """Mean visibility of set points as confidence; smoothness from the largest jerk."""
    w = P.clip_window()
    seg = tracks.stencil(_visible_sum(frames), 2)
    a, b = F.lag("kps").over(w), F.lag("kps", 2).over(w)
    acc = F.zip_with(F.zip_with("kps", a, lambda p, q: F.struct((p["x"] - 2 * q["x"]).alias("x"), (p["y"] - 2 * q["y"]).alias("y"))),
                     b, lambda p, q: F.hypot(p["x"] + q["x"], p["y"] + q["y"]))
    q = tracks.owned(seg.withColumn("__j", F.array_max(acc))).groupBy("clip_id").agg(
        F.sum("__v").alias("v"), F.sum("__m").alias("m"), F.max("__j").alias("jerk"), F.count(F.lit(1)).alias("n"))
    conf = F.when(F.col("m") > 0, F.col("v") / F.col("m")).otherwise(0.85)
    smooth = F.when(F.col("n") >= 3, 1 - F.least(F.lit(1.0), F.col("jerk") / JERK_LIMIT)).otherwise(1.0)
    return q.select("clip_id", _clamp(conf, 0.25, 1.0).alias("score"), conf.alias("detector_conf"), smooth.alias("temporal"))


def static_quality(frames: DataFrame) -> DataFrame:
    conf = F.when(F.col("__m") > 0, F.col("__v") / F.col("__m")).otherwise(0.85)
    return _visible_sum(frames).select("clip_id", "frame_idx", _clamp(conf, 0.25, 1.0).alias("score"))


def _draw(seed: int, what: str, lo: float, hi: float) -> Column:
    return lo + unit(F.col("clip_id"), F.lit(seed), F.lit(what)) * (hi - lo)


def augment(frames: DataFrame, seed: int) -> DataFrame:
    """Roll up to 7 degrees, scale 5 %, shift 0.03: one draw per clip."""
    f = frames.withColumn("__a", F.radians(_draw(seed, "roll", -7.0, 7.0))).withColumn("__k", _draw(seed, "scale", 0.95, 1.05))
    f = f.withColumn("__tx", _draw(seed, "tx", -0.03, 0.03)).withColumn("__ty", _draw(seed, "ty", -0.03, 0.03))
    c, s, k = F.cos("__a"), F.sin("__a"), F.col("__k")
    f = f.withColumn("__c", c).withColumn("__s", s)
    moved = F.transform("kps", lambda p: P.struct([
        (p["x"] * F.col("__c") - p["y"] * F.col("__s")) * k + F.col("__tx"),
        (p["x"] * F.col("__s") + p["y"] * F.col("__c")) * k + F.col("__ty"), p["z"] * k], p["valid"].alias("valid")))
    return f.withColumn("kps", moved).drop("__a", "__k", "__tx", "__ty", "__c", "__s")


def yaw(frames: DataFrame, seed: int, degrees: float = 15.0) -> DataFrame:
    """Rotation about the vertical axis, one angle per clip."""
    a = F.radians(_draw(seed, "yaw", -degrees, degrees))
    return frames.withColumn("kps", V.let(F.struct(F.cos(a).alias("c"), F.sin(a).alias("s")), lambda r: F.transform("kps", lambda p: P.struct([
        p["x"] * r["c"] + p["z"] * r["s"], p["y"], p["z"] * r["c"] - p["x"] * r["s"]], p["valid"].alias("valid")))))


def drop_points(frames: DataFrame, seed: int, joint: float = 0.05, frame: float = 0.02) -> DataFrame:
    """Zero joints and whole frames by seeded draws."""
    lost = unit(F.col("clip_id"), F.col("frame_idx"), F.lit(seed)) < frame
    return frames.withColumn("kps", F.transform("kps", lambda p, i: F.when(
        lost | (unit(F.col("clip_id"), F.col("frame_idx"), i, F.lit(seed)) < joint),
        P.struct([F.lit(0.0)] * 3, F.lit(False).alias("valid"))).otherwise(p)))


def mask_hand_span(frames: DataFrame, seed: int, span: int = 8) -> DataFrame:
    """Zero one hand over a seeded run of frames."""
    t = frames.groupBy("clip_id").agg((F.max("frame_idx") + 1).alias("T"))
    start = F.floor(_draw(seed, "start", 0.0, 1.0) * F.greatest(F.lit(1), F.col("T") - span))
    right = unit(F.col("clip_id"), F.lit(seed), F.lit("hand")) < 0.5
    drawn = F.struct(F.col("frame_idx").between(start, start + span - 1).alias("hit"), F.when(right, 21).otherwise(0).alias("first"))
    return frames.join(t, "clip_id").withColumn("kps", V.let(drawn, lambda d: F.transform("kps", lambda p, i: F.when(
        d["hit"] & (i >= d["first"]) & (i < d["first"] + 21), P.struct([F.lit(0.0)] * 3, F.lit(False).alias("valid"))).otherwise(p)))).drop("T")


def flip_handedness(frames: DataFrame) -> DataFrame:
    """Mirror every frame with the canonical swap table."""
    mirrored = lambda p: P.struct([-p["x"], p["y"], p["z"]], p["valid"].alias("valid"))
    return frames.withColumn("kps", V.let(F.col("kps"), lambda k: F.transform(
        F.array(*[F.lit(i) for i in P.SWAP]), lambda i: mirrored(F.get(k, i)))))

"""Stream guard as window expressions: hand identity, dominance, nods and occlusion per clip.

Each rule looks at a bounded past or composes as a prefix of small maps, so a clip needs no serial pass. Only the One
Euro filter is recursive: on tables it is a fold over the clip's frames inside Spark, on streams a small machine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklore.functions.vectors import let
from tracklore.operators import carried

# fixed values: limits of the guard
SWAP_MARGIN, DOMINANT, HISTORY, NODS = 0.15, 0.65, 30, 15
DT, LONGEST, EPS = 1 / 30.0, 0.5, 1e-5


def clip():
    """The frames of a clip in order."""
    return Window.partitionBy("clip_id").orderBy("frame_idx")


def apart(a: Column, b: Column) -> Column:
    """Distance of two arrays of three."""
    return F.sqrt(sum(((a[i] - b[i]) ** 2 for i in (1, 2)), (a[0] - b[0]) ** 2))


def length(a: Column) -> Column:
    return F.sqrt(sum((a[i] ** 2 for i in (1, 2)), a[0] ** 2))


def orientation(frames: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """``swapped``: are the hands of this frame exchanged against the identity followed so far?

    A frame either exchanges the hands, keeps whatever held, or is too close to call, which restores the given order.
    So the answer is the parity of exchanges since the last frame that was too close.
    """
    here, there = (F.col(left), F.col(right)), (F.lag(left).over(clip()), F.lag(right).over(clip()))
    straight = apart(here[0], there[0]) + apart(here[1], there[1])
    crossed = apart(here[0], there[1]) + apart(here[1], there[0])
    f = frames.withColumn("__gain", F.coalesce(straight - crossed, F.lit(0.0)))
    f = f.withColumn("__stretch", F.count_if(F.abs("__gain") <= SWAP_MARGIN).over(clip()))
    stretch = Window.partitionBy("clip_id", "__stretch").orderBy("frame_idx")
    return f.withColumn("swapped", F.count_if(F.col("__gain") > SWAP_MARGIN).over(stretch) % 2 == 1).drop("__gain", "__stretch")


def dominance(frames: DataFrame, left: str, right: str, share: float = DOMINANT) -> DataFrame:
    """``left_dominant``: the left hand's share of motion over the last frames, once there are ten."""
    recent = clip().rowsBetween(1 - HISTORY, 0)
    total = F.sum(left).over(recent)
    part = total / (total + F.sum(right).over(recent) + 1e-6)
    return frames.withColumn("left_dominant", (F.count(F.lit(1)).over(recent) >= 10) & (part > share))


def nodding(frames: DataFrame, speed: str, elevation: str, energy: str, name: str = "nodding") -> DataFrame:
    """Pitch turns one to four times, widely enough, while the hands have rested for eight frames or more."""
    busy = (F.col(elevation) > 0.05) | (F.col(energy) > 0.15)
    f = frames.withColumn("__busy", busy).withColumn("__rest", F.count_if("__busy").over(clip()))
    rest = Window.partitionBy("clip_id", "__rest").orderBy("frame_idx").rowsBetween(1 - NODS, 0)
    f = f.withColumn("__v", F.collect_list(F.when(~F.col("__busy"), F.col(speed))).over(rest))
    n = F.size("__v")
    add = lambda v, f: F.aggregate(v, F.lit(0.0), lambda a, x: a + f(x))
    turns = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0), lambda a, i: a + (
        F.signum(F.get("__v", i)) != F.signum(F.get("__v", i - 1))).cast("int"))
    spread = let(add("__v", lambda x: x) / n, lambda mean: F.sqrt(add("__v", lambda x: (x - mean) ** 2) / n))
    nod = F.when(n >= 8, turns.between(1, 4) & (spread > 0.05)).otherwise(False)
    return f.withColumn(name, ~F.col("__busy") & nod).drop("__busy", "__rest", "__v")


def held(frames: DataFrame, distance: str, value: str, near: float = 0.12, decay: float = 0.95) -> DataFrame:
    """``value`` of covered frames is the last clear one, decayed once a frame; ``occluded`` tells them."""
    hidden = F.col(distance) < near
    at = F.row_number().over(clip())
    f = frames.withColumn("occluded", hidden).withColumn("__at", at)
    clear = ~F.col("occluded") | (F.col("__at") == 1)
    last = F.last(F.when(clear, F.struct(F.col(value).alias("v"), F.col("__at").alias("at"))), True).over(clip())
    f = f.withColumn("__last", last)
    return f.withColumn("value", F.col("__last.v") * F.pow(F.lit(decay), F.col("__at") - F.col("__last.at"))).drop("__at", "__last")


def one_euro(frames: DataFrame, *channels: str, low: float = 1.0, beta: float = 10.0, rate: float = 30.0, span: int = carried.SPAN) -> DataFrame:
    """Low pass of each channel whose cutoff rises with its speed, at a fixed frame rate; exact to 1e-12."""
    gain = lambda cut: 1 / (1 + rate / (2 * math.pi * cut + 1e-6))
    g = 1 / (1 + rate / (2 * math.pi + 1e-6))

    def step(s: Column, r: Column, after: Column) -> Column:
        speed = F.zip_with(F.zip_with(r, s["x"], lambda v, x: g * (v - x) * rate), s["dx"], lambda new, old: new + (1 - g) * old)

        def follow(d: Column) -> Column:
            a = F.transform(d, lambda e: gain(low + beta * F.abs(e)))
            moved = F.transform(r, lambda v, i: F.get(a, i) * v + (1 - F.get(a, i)) * F.get(s["x"], i))
            return F.struct(moved.alias("x"), d.alias("dx"))

        return F.when(s.isNull(), F.struct(r.alias("x"), F.transform(r, lambda v: F.lit(0.0)).alias("dx"))).otherwise(let(speed, follow))

    close = lambda a, b, c: F.coalesce(F.forall(F.zip_with(a[c], b[c], lambda p, q: F.abs(p - q) <= 1e-12 * (1 + F.abs(q))), lambda ok: ok), F.lit(True))
    row = F.array(*[F.col(c).cast("double") for c in channels])
    out = carried.filtered(frames, ["clip_id"], "frame_idx", row, "struct<x: array<double>, dx: array<double>>", step,
                           lambda a, b: close(a, b, "x") & close(a, b, "dx"), span)
    return out.select("clip_id", F.col("frame_idx").cast("int").alias("frame_idx"), *(F.get("s.x", F.lit(i)).alias(c) for i, c in enumerate(channels)))


def guarded(steady: DataFrame) -> DataFrame:
    """All rules on steadied frames (clip_id, frame_idx, t, pitch, points: wrists and shoulders as twelve numbers)."""
    point = lambda k: F.slice("points", 3 * k + 1, 3)
    f = steady.select("clip_id", "frame_idx", "t", "pitch", *(point(k).alias(c) for k, c in enumerate(("left", "right", "ls", "rs"))))
    f = orientation(f)
    width = F.greatest(apart(F.col("ls"), F.col("rs")), F.lit(1e-4))
    framed = lambda a, b: F.transform(F.when(F.col("swapped"), F.col(b)).otherwise(F.col(a)), lambda v, i: (v - (F.get("ls", i) + F.get("rs", i)) / 2) / width)
    f = f.select("clip_id", "frame_idx", "t", "pitch", "swapped", framed("left", "right").alias("l"), framed("right", "left").alias("r"))
    gap = F.col("t") - F.lag("t").over(clip())
    gap = F.when((gap > 0) & (gap <= LONGEST), gap).otherwise(DT) + EPS

    def speed(c: str) -> Column:
        before = F.lag(c).over(clip())
        return F.when((length(F.col(c)) > 1e-4) & (length(before) > 1e-4), apart(F.col(c), before) / gap).otherwise(0.0)

    f = f.withColumn("vl", speed("l")).withColumn("vr", speed("r"))
    f = f.withColumn("turn", F.coalesce(F.radians(F.col("pitch") - F.lag("pitch").over(clip())) / DT, F.lit(0.0)))
    f = f.withColumn("top", F.greatest(F.col("l")[1], F.col("r")[1])).withColumn("energy", F.col("vl") + F.col("vr"))
    f = nodding(dominance(f, "vl", "vr"), "turn", "top", "energy", "backchannel")
    first = lambda a, b: F.when(F.col("left_dominant"), a).otherwise(b)
    return f.select(
        "clip_id", "frame_idx", "pitch", "swapped", "left_dominant", "backchannel", first(-F.col("l")[0], F.col("r")[0]).alias("wrist_x"),
        first(F.col("l")[1], F.col("r")[1]).alias("wrist_y"), first(F.col("vl"), F.col("vr")).alias("wrist_speed"))

"""Pose functions on array frames: (clip_id, frame_idx, kps array<struct<x,y,z,...>>).

Everything about one frame is an expression over its keypoint array, so only
functions that look at other frames need a window (and only per clip).
Keypoints: 0-20 left hand, 21-41 right hand, 42/43 shoulders, 44/45 hips,
46/47 elbows, 48 nose, 52/53 eyes, 54/55 mouth corners, 57/58 eyebrows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklore.functions.vectors import let
from tracklore.operators import ordered, tracks

# fixed values: mirror partners of the canonical layout
PAIRS = {42: 43, 44: 45, 46: 47, 52: 53, 54: 55, 57: 58}
SWAP = list(range(60))
for _i in range(21):
    SWAP[_i], SWAP[_i + 21] = _i + 21, _i
for _l, _r in PAIRS.items():
    SWAP[_l], SWAP[_r] = _r, _l
TIPS = (4, 8, 12, 16, 20)
ANCHORS = (48, 0, 8, 21, 29, 42, 43)  # nose, wrists, index tips, shoulders

Vec = list[Column]


def pt(i: int | Column, arr: str = "kps") -> Vec:
    p = F.get(arr, i if isinstance(i, Column) else F.lit(i))
    return [p["x"], p["y"], p["z"]]


def sub(a: Vec, b: Vec) -> Vec:
    return [p - q for p, q in zip(a, b)]


def mid(a: Vec, b: Vec) -> Vec:
    return [(p + q) * 0.5 for p, q in zip(a, b)]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vec, b: Vec) -> Vec:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def xyz(p: Column) -> Vec:
    return [p["x"], p["y"], p["z"]]


def struct(v: Vec, *more: Column) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip(v, "xyz")], *more)


def mean_of(arr: Column, f) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, p: a + f(p)) / F.size(arr)


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def clip_window():
    return Window.partitionBy("clip_id", "__seg").orderBy("frame_idx")


# -- single hands ---------------------------------------------------------------


def hand_wrist_normalize(hands: DataFrame) -> DataFrame:
    """Wrist at the origin, farthest joint at distance one."""
    far = F.array_max(F.transform("kps", lambda p: length(sub(xyz(p), pt(0)))))
    scaled = let(F.greatest(far, F.lit(1e-5)), lambda m: F.transform(
        "kps", lambda p: struct([c / m for c in sub(xyz(p), pt(0))])))
    return hands.withColumn("kps", scaled)


def hand_frame_align(hands: DataFrame) -> DataFrame:
    """Wrist origin, unit middle-knuckle distance, axes side / up / palm normal."""
    def rel(i):
        return sub(pt(i), pt(0))

    s0 = length(rel(9))
    h = hands.withColumn("__s", F.when(s0 < 1e-5, 1.0).otherwise(s0))
    q = lambda i: [c / F.col("__s") for c in rel(i)]
    h = h.withColumn("__up", struct([c / length(q(9)) for c in q(9)]))
    up = xyz(F.col("__up"))
    h = h.withColumn("__n1", struct(cross(up, q(5)))).withColumn("__n2", struct(cross(up, q(17))))
    n1, n2 = xyz(F.col("__n1")), xyz(F.col("__n2"))
    flat = length(n1) < 1e-5
    n = [F.when(flat, b).otherwise(a) for a, b in zip(n1, n2)]
    h = h.withColumn("__n", struct(n))
    h = h.withColumn("__n", struct([c / length(xyz(F.col("__n"))) for c in xyz(F.col("__n"))]))
    normal = xyz(F.col("__n"))
    h = h.withColumn("__side", struct(cross(normal, up)))
    side = xyz(F.col("__side"))

    def turned(p):
        v = [c / F.col("__s") for c in sub(xyz(p), pt(0))]
        return struct([dot(v, side), dot(v, up), dot(v, normal)])

    return h.withColumn("kps", F.transform("kps", turned)).withColumnRenamed("__s", "scale").drop(
        "__up", "__n1", "__n2", "__n", "__side")


# -- validity and cleaning ------------------------------------------------------


def validity(frames: DataFrame) -> DataFrame:
    """A point is valid when x or y is away from zero."""
    return frames.withColumn("kps", F.transform("kps", lambda p: struct(
        xyz(p), ((F.abs(p["x"]) > 1e-4) | (F.abs(p["y"]) > 1e-4)).alias("valid"))))


def _hand(start: int) -> Column:
    return F.slice("kps", start + 1, 21)


def hand_flags(frames: DataFrame) -> DataFrame:
    """Per frame and hand: out of bounds, exploded or collapsed while active."""
    out = frames
    for name, start in (("left", 0), ("right", 21)):
        h, w = _hand(start), pt(start)
        reach = lambda p: F.greatest(F.abs(p["x"]), F.abs(p["y"]), F.abs(p["z"]))
        active = F.array_max(F.transform(h, reach)) > 1e-4
        oob = F.exists(h, lambda p: (F.abs(p["x"]) > 2.2) | (F.abs(p["y"]) > 2.5))
        far = F.array_max(F.transform(h, lambda p: dot(sub(xyz(p), w), sub(xyz(p), w)))) > 0.3025
        sums = [mean_of(h, lambda p, n=n: p[n]) for n in "xyz"]
        square = mean_of(h, lambda p: dot(xyz(p), xyz(p)))
        collapsed = square - dot(sums, sums) < 0.000225
        out = out.withColumn(f"{name}_invalid", active & (oob | far | collapsed))
    return out


def clean_hands(frames: DataFrame, max_gap: int = 5) -> DataFrame:
    """Invalid runs of up to ``max_gap`` frames between valid ones are interpolated,
    longer or open ones are zeroed and marked invalid."""
    seg = hand_flags(tracks.stencil(frames, max_gap + 1))
    w = clip_window()
    for name, start in (("left", 0), ("right", 21)):
        bad = F.col(f"{name}_invalid")
        good = F.when(~bad, F.struct("frame_idx", _hand(start).alias("h")))
        seg = seg.withColumn("__a", F.last(good, ignorenulls=True).over(w.rowsBetween(-max_gap, -1)))
        seg = seg.withColumn("__b", F.first(good, ignorenulls=True).over(w.rowsBetween(1, max_gap)))
        gap = F.col("__b.frame_idx") - F.col("__a.frame_idx") - 1
        t = (F.col("frame_idx") - F.col("__a.frame_idx")) / (gap + 1)
        between = F.zip_with("__a.h", "__b.h", lambda a, b: struct(
            [(1 - t) * p + t * q for p, q in zip(xyz(a), xyz(b))], F.lit(True).alias("valid")))
        zero = F.array_repeat(struct([F.lit(0.0)] * 3, F.lit(False).alias("valid")), 21)
        new = F.when(~bad, _hand(start)).when(gap <= max_gap, between).otherwise(zero)
        parts = [new, F.slice("kps", 22, 39)] if start == 0 else [
            F.slice("kps", 1, 21), new, F.slice("kps", 43, 18)]
        seg = seg.withColumn("kps", F.concat(*parts)).drop("__a", "__b")
    return tracks.owned(seg)


def sanitize_visibility(frames: DataFrame) -> DataFrame:
    """If a clip's third channel leaves [0, 1] it is depth, not visibility: put 1
    where x and y are set.  Adds mean confidence of body, left and right hand."""
    r = frames.groupBy("clip_id").agg(
        F.max(F.array_max(F.transform("kps", lambda p: p["z"]))).alias("hi"),
        F.min(F.array_min(F.transform("kps", lambda p: p["z"]))).alias("lo"))
    depth = (F.col("hi") > 1.01) | (F.col("lo") < -0.01)
    vis = lambda p: F.when(depth, ((p["x"] != 0) & (p["y"] != 0)).cast("double")).otherwise(p["z"])
    j = frames.join(r, "clip_id").withColumn("kps", F.transform("kps", lambda p: F.struct(
        p["x"].alias("x"), p["y"].alias("y"), vis(p).alias("z"))))
    part = lambda a, n: F.aggregate(F.slice("kps", a, n), F.lit(0.0), lambda s, p: s + p["z"]) / n
    return j.drop("hi", "lo").select(
        "*", part(1, 21).alias("left_conf"), part(22, 21).alias("right_conf"), part(43, 18).alias("body_conf"))


def canonical_handedness(frames: DataFrame) -> DataFrame:
    """Mirror clips signed by the left hand alone, by presence or path length."""
    w = clip_window()
    seg = tracks.stencil(frames, 1)
    for name, k in (("lh", 0), ("rh", 21)):
        p, q = pt(k), F.lag(F.get("kps", F.lit(k))).over(w)
        step = F.sqrt((p[0] - q["x"]) * (p[0] - q["x"]) + (p[1] - q["y"]) * (p[1] - q["y"]))
        seg = seg.withColumn(f"__{name}", F.coalesce(step, F.lit(0.0)))
    flags = tracks.owned(seg).groupBy("clip_id").agg(
        F.avg(F.exists(_hand(0), lambda p: p["valid"]).cast("double")).alias("lv"),
        F.avg(F.exists(_hand(21), lambda p: p["valid"]).cast("double")).alias("rv"),
        F.sum("__lh").alias("le"), F.sum("__rh").alias("re"))
    left = ((F.col("lv") > 0.40) & (F.col("rv") < 0.15)) | (
        (F.col("lv") > 0.35) & (F.col("le") > 2.5 * F.greatest(F.lit(1e-4), F.col("re"))) & (F.col("le") > 0.15))
    j = frames.join(flags.select("clip_id", left.alias("mirrored")), "clip_id")
    swapped = F.transform(F.array(*[F.lit(i) for i in SWAP]), lambda i: F.get("kps", i))
    mirrored = F.transform(swapped, lambda p: struct([-p["x"], p["y"], p["z"]], p["valid"].alias("valid")))
    return j.withColumn("kps", F.when(F.col("mirrored"), mirrored).otherwise(F.col("kps")))


# -- normalization --------------------------------------------------------------


def _shift_scale(anchor: Vec, inv: Column) -> Column:
    return F.transform("kps", lambda p: struct(
        [c * inv for c in sub(xyz(p), anchor)], p["valid"].alias("valid")))


def _anchors(frames: DataFrame, present: Column) -> DataFrame:
    """Smoothed shoulder midpoint per frame, missing frames interpolated first."""
    m = mid(pt(42), pt(43))
    points = frames.select(
        "clip_id", F.lit(0).alias("kp"), "frame_idx", present.alias("valid"),
        *[c.alias(n) for c, n in zip(m, "xyz")])
    filled = tracks.impute_all(points)
    return tracks.ema(filled.drop("visibility", "valid")).select(
        "clip_id", "frame_idx", F.struct("x", "y", "z").alias("anchor"))


def reference_normalize(frames: DataFrame) -> DataFrame:
    """Centre on the smoothed sternum, scale by the torso; hands alone are centred on
    their mean and scaled by their radius; frames without either stay."""
    v = lambda i: F.get("kps", F.lit(i))["valid"]
    both = v(42) & v(43)
    hips = both & v(44) & v(45)
    width = length(sub(pt(42), pt(43)))
    height = length(sub(mid(pt(42), pt(43)), mid(pt(44), pt(45))))
    seen = F.filter(F.slice("kps", 1, 42), lambda p: p["valid"])
    sums = lambda n: F.aggregate(seen, F.lit(0.0), lambda a, p: a + p[n])
    per = frames.groupBy("clip_id").agg(
        F.count_if(both).alias("n_sh"),
        F.median(F.when(both, width)).alias("width"),
        F.median(F.when(hips, F.sqrt(width * width + height * height))).alias("diag"),
        *[F.avg(F.when(both, c)).alias(f"m{n}") for c, n in zip(mid(pt(42), pt(43)), "xyz")],
        *[(F.sum(sums(n)) / F.sum(F.size(seen))).alias(f"h{n}") for n in "xyz"],
        F.count(F.lit(1)).alias("n"))
    hand_mean = [F.col(f"h{n}") for n in "xyz"]
    # only clips without shoulders need the hand radius
    lone = per.where("n_sh = 0").select("clip_id", "hx", "hy", "hz")
    radius = frames.join(lone, "clip_id").groupBy("clip_id").agg(
        F.max(F.array_max(F.transform(seen, lambda p: length(sub(xyz(p), hand_mean))))).alias("radius"))
    per = per.join(radius, "clip_id", "left")
    torso = F.greatest(F.lit(1e-3), F.coalesce(F.col("diag") * 0.65, F.col("width")))
    scale = F.when(F.col("n_sh") > 0, torso).when(
        F.col("hx").isNotNull(), F.greatest(F.lit(1e-3), F.col("radius"))).otherwise(1.0)
    # narrow tables meet first, the wide frames move once
    j = frames.join(_anchors(frames, both).join(per, "clip_id"), ["clip_id", "frame_idx"])
    single = (F.col("n") == 1) | (F.col("n_sh") == 1)
    anchor = [
        F.when(F.col("n_sh") > 0, F.when(single, F.col(f"m{n}")).otherwise(F.col(f"anchor.{n}")))
        .otherwise(F.coalesce(F.col(f"h{n}"), F.lit(0.0))) for n in "xyz"]
    j = j.withColumn("scale", scale).withColumn("__at", struct(anchor))
    return j.select("clip_id", "frame_idx", _shift_scale(xyz(F.col("__at")), 1 / F.col("scale")).alias("kps"), "scale")


def unified_normalize(frames: DataFrame) -> DataFrame:
    """Shoulder-only variant; coordinates beyond 5 are first divided by their maximum."""
    biggest = F.array_max(F.transform("kps", lambda p: F.greatest(F.abs(p["x"]), F.abs(p["y"]))))
    top = frames.groupBy("clip_id").agg(F.max(biggest).alias("top"))
    pre = F.when(F.col("top") > 5.0, F.col("top")).otherwise(F.lit(1.0))
    pre_scaled = frames.join(top, "clip_id").withColumn("kps", F.transform("kps", lambda p: struct(
        [c / pre for c in xyz(p)], p["valid"].alias("valid")))).drop("top")
    flat = lambda i: F.hypot(pt(i)[0], pt(i)[1]) > 0.01
    present = flat(42) & flat(43)
    per = pre_scaled.groupBy("clip_id").agg(
        F.median(F.when(present, length(sub(pt(42), pt(43))))).alias("width"))
    j = pre_scaled.join(_anchors(pre_scaled, present).join(per, "clip_id"), ["clip_id", "frame_idx"])
    hand = [mean_of(_hand(0), lambda p, n=n: p[n]) for n in "xyz"]
    has = F.col("width").isNotNull()
    at = [F.when(has, F.col(f"anchor.{n}")).otherwise(h) for n, h in zip("xyz", hand)]
    scale = F.when(has, F.greatest(F.lit(1e-3), F.col("width"))).otherwise(1.0)
    j = j.withColumn("scale", scale).withColumn("__at", struct(at))
    return j.select("clip_id", "frame_idx", _shift_scale(xyz(F.col("__at")), 1 / F.col("scale")).alias("kps"), "scale")


def se3_normalize(frames: DataFrame, shoulder: float = 1.0, span: float = 0.5) -> DataFrame:
    """Per-frame centre and clip-mean scale in the image plane, third channel kept."""
    flat = lambda a, b: F.hypot(a[0] - b[0], a[1] - b[1])
    zero = [F.lit(0.0)] * 3
    has = (flat(pt(42), zero) > 1e-4) & (flat(pt(43), zero) > 1e-4)
    d = flat(pt(42), pt(43))
    m = mid(pt(42), pt(43))
    per = frames.groupBy("clip_id").agg(
        F.max(has).alias("any_sh"),
        F.coalesce(F.avg(F.when(d > 1e-4, d)), F.lit(1.0)).alias("dist"),
        *[F.avg(F.when(has, m[i])).alias(f"c{i}") for i in (0, 1)],
        *[F.avg(mean_of(_hand(s), lambda p: p["z"])).alias(n) for n, s in (("lvis", 0), ("rvis", 21))],
        *[F.avg(pt(k)[i]).alias(f"w{k}_{i}") for k in (0, 21) for i in (0, 1)],
        *[F.coalesce(F.avg(F.when(flat(pt(t), pt(k)) > 1e-4, flat(pt(t), pt(k)))), F.lit(0.5)).alias(f"span{k}")
          for k, t in ((0, 9), (21, 30))])
    right = F.col("rvis") > F.col("lvis")
    j = frames.join(per, "clip_id")
    centre = []
    for i in (0, 1):
        sh = F.when(has, m[i]).otherwise(F.col(f"c{i}"))
        wrist = lambda k: F.when((pt(k)[0] == 0) & (pt(k)[1] == 0), F.col(f"w{k}_{i}")).otherwise(pt(k)[i])  # noqa: E731,B023
        centre.append(F.when(F.col("any_sh"), sh).otherwise(F.when(right, wrist(21)).otherwise(wrist(0))))
    hand_span = F.when(right, F.col("span21")).otherwise(F.col("span0"))
    scale = F.when(F.col("any_sh"), shoulder / F.greatest(F.col("dist"), F.lit(1e-4))).otherwise(
        span / F.greatest(hand_span, F.lit(1e-4)))
    j = j.withColumn("__cx", centre[0]).withColumn("__cy", centre[1]).withColumn("__k", scale)
    moved = F.transform("kps", lambda p: struct(
        [(p["x"] - F.col("__cx")) * F.col("__k"), (p["y"] - F.col("__cy")) * F.col("__k"), p["z"]]))
    return j.select("clip_id", "frame_idx", moved.alias("kps"), F.col("__k").alias("scale"))


def part_normalize(frames: DataFrame) -> DataFrame:
    """Each body part around its own anchor and scale, and three cross-part vectors."""
    least = lambda c: F.greatest(c, F.lit(1e-5))
    parts = {
        "left": (pt(0), least(length(sub(pt(9), pt(0))))), "right": (pt(21), least(length(sub(pt(30), pt(21))))),
        "torso": (mid(pt(42), pt(43)), least(length(sub(pt(42), pt(43))))),
        "face": (pt(48), least(length(sub(pt(48), pt(52)))))}
    f = frames
    for n, (a, s) in parts.items():
        f = f.withColumn(f"__{n}", struct(a, s.alias("s")))

    def part(i):
        return (F.when(i < 21, F.col("__left")).when(i < 42, F.col("__right"))
                .when(i < 48, F.col("__torso")).otherwise(F.col("__face")))

    moved = F.transform("kps", lambda p, i: let(part(i), lambda a: struct(
        [c / a["s"] for c in sub(xyz(p), xyz(a))])))
    s = F.col("__torso.s")
    vec = lambda a, b: struct([c / s for c in sub(pt(a), pt(b))])
    return f.select(
        "clip_id", "frame_idx", moved.alias("kps"), vec(21, 48).alias("right_face"),
        vec(0, 48).alias("left_face"), vec(21, 0).alias("hands"),
        *[F.col(f"__{n}.s").alias(f"{n}_scale") for n in parts])


def shoulder_normalize(frames: DataFrame) -> DataFrame:
    """Centre at the sternum and scale by the shoulder width of the same frame."""
    at = mid(pt(42), pt(43))
    inv = 1 / F.greatest(length(sub(pt(42), pt(43))), F.lit(1e-4))
    f = frames.withColumn("__at", struct(at, inv.alias("inv")))
    return f.withColumn("kps", _shift_scale(xyz(F.col("__at")), F.col("__at.inv"))).drop("__at")


def pitch_fix(frames: DataFrame) -> DataFrame:
    """Rotate each clip in the y-z plane until its mean nose-sternum line is upright."""
    s = mid(pt(42), pt(43))
    per = frames.groupBy("clip_id").agg(
        F.avg(pt(48)[1] - s[1]).alias("dy"), F.avg(pt(48)[2] - s[2]).alias("dz"))
    per = per.select("clip_id", F.atan2(F.col("dz"), F.col("dy") + 1e-6).alias("angle"))
    j = frames.join(per, "clip_id").withColumn("__c", F.cos("angle")).withColumn("__s", F.sin("angle"))
    turned = F.transform("kps", lambda p: struct([
        p["x"], F.col("__c") * p["y"] + F.col("__s") * p["z"], F.col("__c") * p["z"] - F.col("__s") * p["y"]]))
    return j.select("clip_id", "frame_idx", turned.alias("kps"), F.degrees("angle").alias("pitch_degrees"))


def torso_cylinder(frames: DataFrame, kp: int) -> DataFrame:
    """Radius, wrapped angle and height of a point around the shoulder line."""
    l, r = pt(42), pt(43)
    torso = F.atan2(r[2] - l[2], r[0] - l[0] + 1e-6)
    rel = sub(pt(kp), mid(l, r))
    raw = F.atan2(rel[2], rel[0] + 1e-6) - torso + math.pi
    return frames.select(
        "clip_id", "frame_idx", F.sqrt(rel[0] * rel[0] + rel[2] * rel[2] + 1e-6).alias("r"),
        (F.pmod(raw, F.lit(2 * math.pi)) - math.pi).alias("theta"), rel[1].alias("y_rel"))


# -- features -------------------------------------------------------------------


def phonology(frames: DataFrame) -> DataFrame:
    """19 features: palm normals, wrist synchrony, face proximity, finger curls."""
    w = clip_window()
    seg = tracks.stencil(frames, 1)
    seg = seg.withColumn("__l0", F.lag(F.get("kps", F.lit(0))).over(w))
    seg = seg.withColumn("__r0", F.lag(F.get("kps", F.lit(21))).over(w))
    feats: list[Column] = []
    for k in (0, 21):
        n = cross(sub(pt(k + 5), pt(k)), sub(pt(k + 17), pt(k)))
        size = F.greatest(length(n), F.lit(1e-5))
        feats += [c / size for c in n]
    vel = [[F.coalesce(a - b, F.lit(0.0)) for a, b in zip(pt(k), xyz(F.col(p)))]
           for k, p in ((0, "__l0"), (21, "__r0"))]
    size = F.greatest(F.sqrt(dot(vel[0], vel[0]) * dot(vel[1], vel[1])), F.lit(1e-5))
    feats.append(dot(*vel) / size)
    face = [mean_of(F.slice("kps", 49, 12), lambda p, n=n: p[n]) for n in "xyz"]
    for k in (0, 21):
        d = sub(pt(k), face)
        feats.append(F.exp(-dot(d, d) / (2 * 0.35**2)))
    for k in (0, 21):
        palm = F.greatest(length(sub(pt(k + 9), pt(k))), F.lit(1e-4))
        for tip in TIPS:
            reach = length(sub(pt(k + tip), pt(k))) / (1.85 * palm)
            feats.append(F.greatest(F.lit(0.0), F.least(F.lit(1.0), reach)))
    return tracks.owned(seg).select(
        "clip_id", "frame_idx", F.array(*[tracks.finite(f) for f in feats]).alias("phonology"))


def cranial_imu(frames: DataFrame) -> DataFrame:
    """Head yaw, pitch and roll velocity from nose and eyes, clipped to 15."""
    nose, le, re = pt(48), pt(52), pt(53)
    dx = re[0] - le[0] + 1e-6
    seg = tracks.stencil(frames, 3).select(
        "clip_id", "frame_idx", "__seg", "__own", F.atan2(re[2] - le[2], dx).alias("yaw"),
        F.atan2(nose[1] - 0.5 * (le[1] + re[1]), dx).alias("pitch"), F.atan2(re[1] - le[1], dx).alias("roll"))
    w = clip_window()
    out = []
    for n in ("yaw", "pitch", "roll"):
        lag, lead = F.lag(n).over(w), F.lead(n).over(w)
        v = F.coalesce(
            (lead - lag) * 15.0, (F.lead(n, 2).over(w) - F.col(n)) * 15.0,
            (F.col(n) - F.lag(n, 2).over(w)) * 15.0, (lead - F.col(n)) * 30.0,
            (F.col(n) - lag) * 30.0, F.lit(0.0))
        out.append(F.greatest(F.lit(-15.0), F.least(F.lit(15.0), v)).alias(f"{n}_rate"))
    return tracks.owned(seg.select("*", *out)).drop("yaw", "pitch", "roll")


def with_motion(frames: DataFrame) -> DataFrame:
    """Frame-to-frame velocity, acceleration and jerk arrays, zero at the start."""
    w = clip_window()
    seg = tracks.stencil(frames, 3)
    source = "kps"
    for name in ("vel", "acc", "jerk"):
        prev = F.lag(source).over(w)
        diff = F.zip_with(source, prev, lambda a, b: struct(sub(xyz(a), xyz(b))))
        none = F.transform(source, lambda p: struct([F.lit(0.0)] * 3))
        seg = seg.withColumn(name, F.coalesce(diff, none))
        source = name
    return tracks.owned(seg)


def _finger_mean(arr: str, k: int, relative: bool = True) -> Column:
    base = pt(k, arr) if relative else [F.lit(0.0)] * 3
    return mean_of(F.slice(arr, k + 2, 20), lambda p: length(sub(xyz(p), base)))


def activity_cues(moving: DataFrame) -> DataFrame:
    """Hand height, nose distance and energy, and the likeliest of four states."""
    st, nose = mid(pt(43), pt(42)), pt(48)
    c = moving.select(
        "clip_id", "frame_idx", (pt(21)[1] - st[1]).alias("r_elev"), (pt(0)[1] - st[1]).alias("l_elev"),
        length(sub(pt(21), nose)).alias("r_nose"), length(sub(pt(0), nose)).alias("l_nose"),
        length(pt(21, "vel")).alias("r_energy"), length(pt(0, "vel")).alias("l_energy"))
    e = F.greatest("r_elev", "l_elev")
    k = F.col("r_energy") + F.col("l_energy")
    d = F.least("r_nose", "l_nose")
    priors = F.array(
        4 * sigmoid(-10 * e) * sigmoid(10 * (0.15 - k)), 4 * sigmoid(15 * (0.18 - d)) * sigmoid(10 * (0.25 - k)),
        4 * sigmoid(10 * (e - 0.05)) * sigmoid(10 * (k - 0.08)), 4 * sigmoid(10 * (e - 0.05)) * sigmoid(10 * (0.06 - k)))
    names = F.array(*[F.lit(n) for n in ("rest", "fidget", "signing", "hold")])
    c = c.withColumn("priors", priors)
    return c.withColumn("state", F.get(names, F.array_position("priors", F.array_max("priors")).cast("int") - 1))


def transition_signature(moving: DataFrame) -> DataFrame:
    """Signals of a transition stroke and their heuristic probability."""
    rv, lv = length(pt(21, "vel")), length(pt(0, "vel"))
    m = moving.select(
        "clip_id", "frame_idx", F.greatest(rv, lv).alias("wrist_speed"),
        F.greatest(_finger_mean("vel", 21), _finger_mean("vel", 0)).alias("finger_speed"),
        F.greatest(length(pt(21, "jerk")), length(pt(0, "jerk"))).alias("wrist_jerk"),
        length(cross(*[[F.when(rv >= lv, a).otherwise(b) for a, b in zip(pt(21, n), pt(0, n))]
                       for n in ("vel", "acc")])).alias("__c"))
    s = F.col("wrist_speed")
    m = m.withColumn("ballistic_ratio", s / (s + F.col("finger_speed") + 1e-4))
    m = m.withColumn("curvature", F.least(F.lit(10.0), F.col("__c") / (F.pow(s, 3) + 1e-3)))
    m = m.withColumn("hold", sigmoid(20 * (0.06 - s))).drop("__c")
    return m.withColumn("transition", F.tanh(s / 0.15) * F.col("ballistic_ratio") * (1 - F.col("hold")))


def spelling_signature(moving: DataFrame) -> DataFrame:
    """Fingerspelling signals of the hand nearer to its shelf beside the shoulder."""
    rows = {}
    for side, k, sh, x in (("r", 21, 43, 1.0), ("l", 0, 42, -1.0)):
        raw = pt(sh)
        default = [F.lit(0.20 * x), F.lit(0.0), F.lit(0.0)]
        there = length(raw) > 1e-3
        anchor = [F.when(there, a).otherwise(b) for a, b in zip(raw, default)]
        rel = sub(pt(k), anchor)
        off = [(rel[0] - 0.08 * x) / 0.08, (rel[1] - 0.05) / 0.10, (rel[2] + 0.22) / 0.09]
        speed, finger = length(pt(k, "vel")), _finger_mean("vel", k)
        rows[side] = F.struct(
            F.exp(-0.5 * dot(off, off)).alias("proximity"), F.exp(-15.0 * speed * speed).alias("stationarity"),
            (finger / (speed + finger + 1e-4)).alias("finger_ratio"),
            F.tanh(10.0 * _finger_mean("acc", k, relative=False)).alias("energy"),
            sigmoid(15.0 * (pt(k)[1] + 0.15)).alias("elevation"), F.tanh(finger / 0.10).alias("flexion"))
    m = moving.select("clip_id", "frame_idx", rows["r"].alias("r"), rows["l"].alias("l"))
    best = F.when(F.col("r.proximity") >= F.col("l.proximity"), F.col("r")).otherwise(F.col("l"))
    return m.select("clip_id", "frame_idx", best.alias("b")).select("clip_id", "frame_idx", "b.*")


def active_keypoints(moving: DataFrame, keep: float = 0.5) -> DataFrame:
    """Keypoints with the most motion energy per frame, structural anchors first."""
    k = max(8, round(60 * keep))
    energy = F.zip_with("vel", "acc", lambda v, a: dot(xyz(v), xyz(v)) + 0.1 * dot(xyz(a), xyz(a)))
    m = moving.select("clip_id", "frame_idx", energy.alias("e"))
    top = m.groupBy("clip_id").agg(F.greatest(F.max(F.array_max("e")), F.lit(1e-5)).alias("top"))
    boosted = F.transform("e", lambda e, i: F.struct(
        (-F.round(0.6 * F.least(F.lit(1.0), e / F.col("top")), 9) - F.when(i.isin(*ANCHORS), 10.0).otherwise(0.0)).alias("s"),
        i.alias("kp")))
    chosen = F.transform(F.slice(F.array_sort(boosted), 1, k), lambda s: s["kp"])
    return m.join(top, "clip_id").select("clip_id", "frame_idx", F.array_sort(chosen).alias("kept"))

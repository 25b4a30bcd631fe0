"""Track functions on long frames: (clip_id, kp, frame_idx, values).

A track is one keypoint of one clip.  Functions that only look a few frames away
run on :func:`stencil` segments, so a clip of any length is split over tasks and
one exchange serves every window of a chain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklore.operators import carried, ordered

SPAN = 2048  # frames per segment
FPS = 30.0
V_CLIP, A_CLIP = 12.0, 45.0
EMA_REACH = 400  # 0.9 ** 400 is below double precision


def stencil(df: DataFrame, halo: int, span: int = SPAN) -> DataFrame:
    """Cut tracks into segments; each also holds ``halo`` frames of its neighbours.

    Adds ``__seg`` (a window key) and ``__own`` (false on borrowed frames, which
    :func:`owned` drops).  Only frames next to a cut are repeated.
    """
    f = F.col("frame_idx")
    here, at = F.floor(f / span), f % span
    segs = F.array_compact(F.array(
        F.when((at < halo) & (here > 0), here - 1), here, F.when(at >= span - halo, here + 1)))
    return df.withColumn("__seg", F.explode_outer(segs)).withColumn("__own", F.col("__seg") == here)


def owned(df: DataFrame) -> DataFrame:
    return df.where("__own").drop("__seg", "__own")


def seg_window(keys: tuple[str, ...] = ("clip_id", "kp")):
    return Window.partitionBy(*keys, "__seg").orderBy("frame_idx")


def _cols(df: DataFrame) -> list[str]:
    return [c for c in ("x", "y", "z") if c in df.columns]


def _clip(v: Column, limit: float) -> Column:
    return F.least(F.greatest(v, F.lit(-limit)), F.lit(limit))


def finite(v: Column) -> Column:
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, 0.0).otherwise(v)


# -- gaps -----------------------------------------------------------------------


def interpolate_gaps(frames: DataFrame, max_gap: int = 5, last_hand_kp: int = 41) -> DataFrame:
    """Fill internal gaps of up to ``max_gap`` frames of hand points, linearly."""
    cols, w = _cols(frames), seg_window()
    seg = stencil(frames, max_gap + 1)
    known = F.when(F.col("valid"), F.struct("frame_idx", *cols))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(-max_gap, -1))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(1, max_gap))
    seg = seg.withColumn("__a", before).withColumn("__b", after)
    gap = F.col("__b.frame_idx") - F.col("__a.frame_idx") - 1
    fill = ~F.col("valid") & (gap <= max_gap) & (F.col("kp") <= last_hand_kp)
    t = (F.col("frame_idx") - F.col("__a.frame_idx")) / (gap + 1)
    for c in cols:
        seg = seg.withColumn(c, F.when(
            fill, (1 - t) * F.col(f"__a.{c}") + t * F.col(f"__b.{c}")).otherwise(F.col(c)))
    return owned(seg).drop("__a", "__b")


def nearest_valid(frames: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Attach ``__a`` and ``__b``: the valid rows at or before and at or after each row."""
    known = F.when(F.col("valid"), value)
    chunk = F.floor(F.col("frame_idx") / SPAN)
    fwd = ordered.running(frames, keys, ["frame_idx"], chunk, {"__a": ("last", known)})
    fwd = fwd.withColumn("__rev", -F.col("frame_idx"))
    return ordered.running(fwd, keys, ["__rev"], -chunk, {"__b": ("last", known)}).drop("__rev")


def impute_all(frames: DataFrame) -> DataFrame:
    """Fill every missing frame of a track seen at least once; ends are extended."""
    cols = _cols(frames)
    near = nearest_valid(frames, ["clip_id", "kp"], F.struct("frame_idx", *cols))
    span = F.col("__b.frame_idx") - F.col("__a.frame_idx")
    t = F.when(span > 0, (F.col("frame_idx") - F.col("__a.frame_idx")) / span).otherwise(0.0)
    for c in cols:
        near = near.withColumn(c, F.when(F.col("valid"), F.col(c)).otherwise(F.coalesce(
            (1 - t) * F.col(f"__a.{c}") + t * F.col(f"__b.{c}"),
            F.col(f"__a.{c}"), F.col(f"__b.{c}"), F.col(c))))
    seen = F.col("__a").isNotNull() | F.col("__b").isNotNull()
    vis = F.when(F.col("valid"), 1.0).when(seen, 0.05).otherwise(0.0)
    return near.withColumn("visibility", vis).drop("__a", "__b")


# -- smoothing ------------------------------------------------------------------


def _binomial(c: str, w) -> Column:
    p, n = F.lag(c).over(w), F.lead(c).over(w)
    return F.coalesce(0.25 * p + 0.5 * F.col(c) + 0.25 * n, F.col(c))


def binomial_smooth(frames: DataFrame) -> DataFrame:
    """Quarter, half, quarter; the first and last frame stay."""
    w, cols = seg_window(), _cols(frames)
    keep = [c for c in frames.columns if c not in cols]
    seg = stencil(frames, 1)
    return owned(seg.select(*keep, "__seg", "__own", *[_binomial(c, w).alias(c) for c in cols]))


def gaussian_smooth(frames: DataFrame, window: int = 5) -> DataFrame:
    """Normalized Gaussian kernel with edge frames repeated; short tracks unchanged."""
    half, sigma = window // 2, (window - 1) / 4.0
    kernel = [math.exp(-(i - half) ** 2 / (2 * sigma**2)) for i in range(window)]
    kernel = [k / sum(kernel) for k in kernel]
    w = seg_window()
    seg = stencil(frames, window)
    enough = F.count(F.lit(1)).over(w.rowsBetween(-(window - 1), window - 1)) >= window

    def at(c: str, off: int) -> Column:
        step = F.lag if off < 0 else F.lead
        tries = [step(c, k).over(w) for k in range(abs(off), 0, -1)]
        return F.coalesce(*tries, F.col(c))

    keep = [c for c in frames.columns if c not in _cols(frames)]
    out = []
    for c in _cols(frames):
        v = sum((at(c, i - half) * kernel[i] for i in range(1, window)), at(c, -half) * kernel[0])
        out.append(F.when(enough, v).otherwise(F.col(c)).alias(c))
    return owned(seg.select(*keep, "__seg", "__own", *out))


def ema(frames: DataFrame, alpha: float = 0.9) -> DataFrame:
    """a := alpha * a + (1 - alpha) * x along each track, started at its first value.

    The recursion is a weighted running sum; EMA_REACH borrowed frames make every
    segment exact to double precision without the frames before it.
    """
    w, cols = seg_window(), _cols(frames)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seg = stencil(frames, EMA_REACH).withColumn(
        "__l", F.col("frame_idx") - F.col("__seg") * SPAN).withColumn("__first", F.lag("frame_idx").over(w).isNull())
    weight = F.when(F.col("__first"), 1.0).otherwise(1 - alpha)
    grown = F.pow(F.lit(alpha), -F.col("__l"))
    keep = [c for c in frames.columns if c not in cols]
    return owned(seg.select(*keep, "__seg", "__own", *[
        (F.sum(F.col(c) * weight * grown).over(upto) / grown).alias(c) for c in cols]))


def jump_clamp(frames: DataFrame, threshold: float = 0.25, span: int = carried.SPAN) -> DataFrame:
    """Replace a step over ``threshold`` by the mean of the clamped previous frame
    and the next one; the last frame repeats the previous.  Tracks of one or two frames stay."""
    cols = _cols(frames)
    dist = lambda a, b: F.sqrt(sum(
        ((a[c] - b[c]) * (a[c] - b[c]) for c in cols[1:]), (a[cols[0]] - b[cols[0]]) * (a[cols[0]] - b[cols[0]])))

    def step(s, r, after):
        moved = F.struct(*[F.coalesce(0.5 * (s[c] + after[c]), s[c]).alias(c) for c in cols])
        return F.when(s.isNotNull() & (dist(r, s) > threshold), moved).otherwise(r)

    state = "struct<" + ", ".join(f"{c}: double" for c in cols) + ">"
    row = F.struct(*[F.col(c).cast("double").alias(c) for c in cols])
    out = carried.filtered(frames, ["clip_id", "kp"], "frame_idx", row, state, step, span=span)
    short = frames.join(out.select("clip_id", "kp", "frame_idx", "s", "n"), ["clip_id", "kp", "frame_idx"])
    return short.select("clip_id", "kp", "frame_idx", *[F.when(F.col("n") > 2, F.col("s")[c]).otherwise(F.col(c)).alias(c) for c in cols])


def rolling_mean(frames: DataFrame, size: int = 50) -> DataFrame:
    w = seg_window().rowsBetween(-(size - 1), 0)
    seg = stencil(frames, size)
    for c in _cols(frames):
        seg = seg.withColumn(c, F.avg(c).over(w))
    return owned(seg)


# -- derivatives ----------------------------------------------------------------


def kinematics(frames: DataFrame, smooth: bool = True, fps: float = FPS) -> DataFrame:
    """Velocity and acceleration by five-point quadratic stencils, clipped.

    Near the ends the central or one-sided difference takes over, which also
    covers tracks under five frames.  Inactive points get zeros.
    """
    dt, w, cols = 1.0 / max(fps, 1.0), seg_window(), _cols(frames)
    seg = stencil(frames, 3)
    for c in cols:
        seg = seg.withColumn(f"__{c}", _binomial(c, w) if smooth else F.col(c))
    inactive = sum((F.abs(f"__{c}") for c in cols[1:]), F.abs(f"__{cols[0]}")) < 1e-5
    out = []
    for c in cols:
        p = f"__{c}"
        l2, l1 = F.lag(p, 2).over(w), F.lag(p).over(w)
        n1, n2 = F.lead(p).over(w), F.lead(p, 2).over(w)
        here = F.col(p)
        v = F.coalesce(
            (-2.0 * l2 - l1 + n1 + 2.0 * n2) / (10.0 * dt), (n1 - l1) / (2.0 * dt),
            (n1 - here) / dt, (here - l1) / dt, F.lit(0.0))
        a = F.coalesce(
            (2.0 * l2 - l1 - 2.0 * here - n1 + 2.0 * n2) / (7.0 * dt**2),
            (n1 - 2.0 * here + l1) / dt**2, (n2 - 2.0 * n1 + here) / dt**2,
            (here - 2.0 * l1 + l2) / dt**2, F.lit(0.0))
        out += [F.when(inactive, 0.0).otherwise(finite(_clip(v, V_CLIP))).alias(f"v{c}"),
                F.when(inactive, 0.0).otherwise(finite(_clip(a, A_CLIP))).alias(f"a{c}")]
    return owned(seg.select("*", *out)).drop(*[f"__{c}" for c in cols])


def simple_kinematics(frames: DataFrame) -> DataFrame:
    """First differences; the first row repeats the second."""
    w = seg_window()
    out = []
    for c in _cols(frames):
        l1, l2, n1 = F.lag(c).over(w), F.lag(c, 2).over(w), F.lead(c).over(w)
        out += [F.coalesce(F.col(c) - l1, n1 - F.col(c), F.lit(0.0)).alias(f"v{c}"),
                F.coalesce(F.col(c) - 2 * l1 + l2, F.lit(0.0)).alias(f"a{c}")]
    return owned(stencil(frames, 2).select("*", *out))


def variable_dt_kinematics(frames: DataFrame, time: str) -> DataFrame:
    """Differences over elapsed time; equal time stamps count as one step."""
    w = seg_window()
    seg = stencil(frames, 3)
    gap = F.col(time) - F.lag(time).over(w)
    seg = seg.withColumn("__dt", F.when(gap == 0, 1.0).otherwise(gap))
    cols = _cols(frames)
    for c in cols:
        back = (F.col(c) - F.lag(c).over(w)) / F.col("__dt")
        seg = seg.withColumn(f"__v{c}", back)
    for c in cols:
        seg = seg.withColumn(f"v{c}", F.coalesce(f"__v{c}", F.lead(f"__v{c}").over(w), F.lit(0.0)))
    for c in cols:
        # the second row's difference of velocities is zero, and so is the first's
        acc = (F.col(f"v{c}") - F.lag(f"v{c}").over(w)) / F.col("__dt")
        seg = seg.withColumn(f"a{c}", F.coalesce(acc, F.lit(0.0)))
    return owned(seg).drop("__dt", *[f"__v{c}" for c in cols])


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def frenet(frames: DataFrame, dt: float = 1.0 / FPS, eps: float = 1e-3) -> DataFrame:
    """Speed, jerk, curvature and torsion of a 3D track from finite differences."""
    w = seg_window()
    seg = stencil(frames, 6)

    def edges(name: str, mid: str) -> Column:
        return F.coalesce(F.col(mid), F.lead(mid).over(w), F.lag(mid).over(w), F.lit(0.0)).alias(name)

    def central(name: str, of: str) -> Column:
        return ((F.lead(of).over(w) - F.lag(of).over(w)) / (2 * dt)).alias(name)

    axes = ("x", "y", "z")
    seg = seg.select("*", *[((F.col(c) - F.lag(c).over(w)) / dt).alias(f"__v{c}") for c in axes])
    seg = seg.select("*", *[
        F.coalesce(F.col(f"__v{c}"), F.lead(f"__v{c}").over(w), F.lit(0.0)).alias(f"v{c}") for c in axes])
    seg = seg.select("*", *[central(f"__a{c}", f"v{c}") for c in axes])
    seg = seg.select("*", *[edges(f"a{c}", f"__a{c}") for c in axes])
    seg = seg.select("*", *[central(f"__j{c}", f"a{c}") for c in axes])
    seg = seg.select("*", *[edges(f"j{c}", f"__j{c}") for c in axes])
    v, a, j = ([F.col(f"{k}{c}") for c in axes] for k in "vaj")
    seg = seg.select("*", *[x.alias(f"__c{i}") for i, x in enumerate(_cross(v, a))])
    cr = [F.col(f"__c{i}") for i in range(3)]
    cr2, speed = _dot(cr, cr), F.sqrt(_dot(v, v))
    return owned(seg.select(
        "clip_id", "kp", "frame_idx", "__seg", "__own", speed.alias("speed"),
        F.sqrt(_dot(a, a)).alias("acceleration"), F.sqrt(_dot(j, j)).alias("jerk"),
        (F.sqrt(cr2) / (F.pow(speed, 3) + eps)).alias("curvature"),
        (_dot(cr, j) / (cr2 + eps**2)).alias("torsion")))


# -- resampling -----------------------------------------------------------------


def with_length(frames: DataFrame) -> DataFrame:
    n = frames.groupBy("clip_id").agg((F.max("frame_idx") + 1).alias("T"))
    return frames.join(n, "clip_id")


def resample(sized: DataFrame, n: Column) -> DataFrame:
    """Linear resampling of every track from T to ``n`` frames, without a join.

    Each frame emits the new frames that fall between it and the next one.
    """
    cols = _cols(sized)
    w = Window.partitionBy("clip_id", "kp", "__seg").orderBy("frame_idx")
    seg = stencil(sized.withColumn("__n", n), 1)
    nxt = [F.coalesce(F.lead(c).over(w), F.col(c)).alias(f"__n{c}") for c in cols]
    seg = owned(seg.select("*", *nxt))
    f, t, m = F.col("frame_idx"), F.col("T"), F.col("__n")
    ratio = F.when(t > 1, (m - 1) / (t - 1)).otherwise(F.lit(0.0))
    lo = F.greatest(F.lit(0), F.floor(f * ratio).cast("int") - 1)
    hi = F.least(m - 1, F.ceil((f + 1) * ratio).cast("int") + 1)
    cand = F.when(t == 1, F.sequence(F.lit(0), (m - 1).cast("int"))).otherwise(
        F.sequence(lo, F.greatest(lo, hi.cast("int"))))
    pos = F.when(m > 1, F.col("i") * (t - 1) / (m - 1)).otherwise(F.lit(0.0))
    out = seg.withColumn("i", F.explode_outer(cand)).withColumn("__p", pos)
    out = out.where((F.floor("__p") == f) & (F.col("i") < m))
    frac = F.col("__p") - f
    return out.select(
        "clip_id", "kp", F.col("i").alias("frame_idx"), F.col("__p").alias("source_frame"),
        *[((1 - frac) * F.col(c) + frac * F.col(f"__n{c}")).alias(c) for c in cols])


def ensure_min_frames(frames: DataFrame, least: int = 40) -> DataFrame:
    sized = with_length(frames)
    return resample(sized, F.greatest(F.col("T"), F.lit(least)).cast("int"))


def time_warp(frames: DataFrame, factor: Column | float) -> DataFrame:
    """Resample to round(T * factor) frames, at least 4; shorter clips stay."""
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    sized = with_length(frames)
    n = F.when(F.col("T") < 4, F.col("T")).otherwise(
        F.greatest(F.lit(4), F.bround(F.col("T") * factor, 0))).cast("int")
    return resample(sized, n)


def uniform_subsample(frames: DataFrame, n: int = 64) -> DataFrame:
    """Keep n evenly spaced frames of longer clips."""
    sized, f, t = with_length(frames), F.col("frame_idx"), F.col("T")
    i = F.ceil(f * (n - 1) / (t - 1))
    hit = (F.floor(i * (t - 1) / (n - 1)) == f) & (i < n)
    return sized.where((t <= n) | hit).drop("T")


def stride_subsample(frames: DataFrame, limit: int) -> DataFrame:
    """Every ceil(T / limit)-th frame."""
    sized = with_length(frames)
    step = F.ceil(F.col("T") / limit)
    return sized.where(F.col("frame_idx") % step == 0).withColumn(
        "frame_idx", (F.col("frame_idx") / step).cast("int")).drop("T")


def motion_aware_sample(frames: DataFrame, limit: int) -> DataFrame:
    """70 % evenly spaced frames, the rest those with the most motion."""
    uniform = int(limit * 0.70)
    rest = limit - uniform
    w = seg_window()
    seg = stencil(frames, 2)
    parts = [F.coalesce(F.abs(F.lead(c).over(w) - F.col(c)), F.abs(F.col(c) - F.lag(c).over(w)), F.lit(0.0))
             for c in _cols(frames)]
    moved = owned(seg.select("*", sum(parts[1:], parts[0]).alias("__e")))
    energy = moved.groupBy("clip_id", "frame_idx").agg(F.round(F.sum("__e"), 9).alias("energy"))
    sized, f, t = with_length(energy), F.col("frame_idx"), F.col("T")
    i = F.ceil(f * (uniform - 1) / (t - 1))
    grid = (t <= limit) | ((F.floor(i * (t - 1) / (uniform - 1)) == f) & (i < uniform))
    marked = sized.withColumn("on_grid", grid)
    order = Window.partitionBy("clip_id").orderBy(F.desc("energy"), "frame_idx")
    extra = (
        marked.where(~F.col("on_grid")).withColumn("__rn", F.row_number().over(order))
        .where(F.col("__rn") <= rest)
    )
    return marked.where("on_grid").select("clip_id", "frame_idx", "on_grid").unionByName(
        extra.select("clip_id", "frame_idx", "on_grid"))


# -- runs -----------------------------------------------------------------------


def spans(frames: DataFrame, active: Column, least: int = 4) -> DataFrame:
    """Runs of active frames, end exclusive, at least ``least`` frames long."""
    src = frames.withColumn("__on", active)
    runs = ordered.running(
        src, ["clip_id"], ["frame_idx"], F.floor(F.col("frame_idx") / SPAN),
        {"__off": ("last", F.when(~F.col("__on"), F.col("frame_idx")))})
    return (
        runs.where("__on").groupBy("clip_id", "__off")
        .agg(F.min("frame_idx").alias("start"), (F.max("frame_idx") + 1).alias("end"))
        .where(F.col("end") - F.col("start") >= least)
        .select("clip_id", "start", "end")
    )


def bio_segments(frames: DataFrame, least: int = 3, begin: float = 0.4, leave: float = 0.6) -> DataFrame:
    """Sign segments from (outside, begin, inside) probabilities and frame tokens.

    Begin and leave never hold together, so being inside a sign is a latch: the
    newest of the two marks decides.
    """
    o, b, i = F.col("p_o"), F.col("p_b"), F.col("p_i")
    is_b = ((b > o) & (b >= i)) | (b >= begin)
    is_o = (o >= b) & (o >= i) & (o > leave)
    mark = F.when(is_b, F.col("frame_idx")).when(is_o, -1 - F.col("frame_idx"))
    chunk = F.floor(F.col("frame_idx") / SPAN)
    order = ["frame_idx"]
    latched = ordered.running(frames, ["clip_id"], order, chunk, {"__m": ("last", mark)})
    # a segment is told apart by the newest leave mark, or by none
    off = F.when(F.col("__m") < 0, F.col("frame_idx"))
    runs = ordered.running(latched, ["clip_id"], order, chunk, {"__id": ("last", off)})
    inside = runs.where(F.col("__m") >= 0)
    per_token = inside.groupBy("clip_id", "__id", "token").agg(
        F.count(F.lit(1)).alias("n"), F.sum("conf").alias("c"),
        F.min("frame_idx").alias("s"), F.max("frame_idx").alias("e"))
    seg = per_token.groupBy("clip_id", "__id").agg(
        F.min("s").alias("start"), F.max("e").alias("end"),
        (F.sum("c") / F.sum("n")).alias("confidence"),
        F.max_by("token", F.when(F.col("token") != 0, F.struct("n", -F.col("token")))).alias("token"))
    length = F.col("end") - F.col("start") + 1
    return seg.where((length >= least) & F.col("token").isNotNull()).select(
        "clip_id", "start", "end", length.alias("duration"), "token", "confidence")


def frame_index_audit(clips: DataFrame) -> DataFrame:
    """Checks on clips(clip_id, frame_indices, n_frames): order, repeats, padding."""
    f = F.col("frame_indices")
    steps = F.zip_with(F.slice(f, 1, F.size(f) - 1), F.slice(f, 2, F.size(f)), lambda a, b: b - a)
    return clips.select(
        "clip_id", (F.size(f) == F.col("n_frames")).alias("length_match"),
        F.forall(steps, lambda s: s > 0).alias("increasing"),
        (F.size(F.array_distinct(f)) == F.size(f)).alias("is_unique"),
        F.exists(F.slice(f, 2, F.size(f)), lambda x: x == 0).alias("zero_padded"))

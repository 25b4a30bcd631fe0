"""Track queries: each vector is a 64-frame track of one joint, or a 21-frame 3D one."""

from pyspark.sql import functions as F

from tracklore.functions import vectors as V
from tracklore.operators import tracks as T
from tracklore.operators import uncertainty as U
from tracklore.plans import inputs as I
from tracklore.plans.registry import QuerySet
from tracklore.session import table

Q = QuerySet()
FR = f"WITH {I.FRAMES}"
FV = f"{FR}, fv AS (SELECT *, abs(x) > 0.05 AS valid FROM frames)"
TR = f"WITH {I.TRIPLES}"
W = "OVER (PARTITION BY clip_id ORDER BY frame_idx)"


def fv(s, d):
    return I.frames(s, d).withColumn("valid", F.abs("x") > 0.05)


def r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


NEAR = """near AS (SELECT *, last_value(CASE WHEN valid THEN frame_idx END IGNORE NULLS) OVER
    (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
  first_value(CASE WHEN valid THEN frame_idx END IGNORE NULLS) OVER
    (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM fv),
nv AS (SELECT near.*, fa.x AS xa, fb.x AS xb FROM near
  LEFT JOIN frames fa ON fa.clip_id = near.clip_id AND fa.frame_idx = near.a
  LEFT JOIN frames fb ON fb.clip_id = near.clip_id AND fb.frame_idx = near.b)"""


@Q.add("w1_interpolate_gaps", f"""{FV}, {NEAR}
SELECT clip_id, frame_idx, round(CASE WHEN NOT valid AND b - a - 1 <= 5
  THEN xa + (xb - xa) * (frame_idx - a) / (b - a) ELSE x END, 6) AS x FROM nv""")
def _(s, d):
    return r6(T.interpolate_gaps(fv(s, d)), "x").select("clip_id", "frame_idx", "x")


@Q.add("w2_impute_all", f"""{FV}, {NEAR}
SELECT clip_id, frame_idx, round(CASE WHEN valid THEN x WHEN a IS NULL THEN COALESCE(xb, x) WHEN b IS NULL THEN xa
  ELSE xa + (xb - xa) * (frame_idx - a) / (b - a) END, 6) AS x,
  CASE WHEN valid THEN 1.0 WHEN a IS NULL AND b IS NULL THEN 0.0 ELSE 0.05 END::DOUBLE AS visibility FROM nv""")
def _(s, d):
    return r6(T.impute_all(fv(s, d)), "x").select("clip_id", "frame_idx", "x", "visibility")


@Q.add("w4_binomial_smooth", f"""{FR} SELECT clip_id, frame_idx,
round(COALESCE(0.25 * lag(x) {W} + 0.5 * x + 0.25 * lead(x) {W}, x), 6) AS x FROM frames""")
def _(s, d):
    return r6(T.binomial_smooth(I.frames(s, d)), "x").select("clip_id", "frame_idx", "x")


def _kin_sql(smooth):
    src = (f"COALESCE(0.25 * lag(x) {W} + 0.5 * x + 0.25 * lead(x) {W}, x)" if smooth else "x")
    return f"""{FR}, p AS (SELECT clip_id, frame_idx, x, {src} AS p FROM frames),
n AS (SELECT *, lag(p, 2) {W} AS l2, lag(p) {W} AS l1, lead(p) {W} AS n1, lead(p, 2) {W} AS n2 FROM p),
k AS (SELECT clip_id, frame_idx, x, p,
  COALESCE((-2 * l2 - l1 + n1 + 2 * n2) * 3.0, (n1 - l1) * 15.0, (n1 - p) * 30.0, (p - l1) * 30.0, 0) AS v,
  COALESCE((2 * l2 - l1 - 2 * p - n1 + 2 * n2) * 900.0 / 7.0, (n1 - 2 * p + l1) * 900.0,
           (n2 - 2 * n1 + p) * 900.0, (p - 2 * l1 + l2) * 900.0, 0) AS a FROM n)
SELECT clip_id, frame_idx, round(x, 6) AS x,
  round(CASE WHEN abs(p) < 1e-5 THEN 0 ELSE GREATEST(-12, LEAST(12, v)) END, 6) AS vx,
  round(CASE WHEN abs(p) < 1e-5 THEN 0 ELSE GREATEST(-45, LEAST(45, a)) END, 6) AS ax FROM k"""


@Q.add("w5_kinematics_9d", _kin_sql(True))
def _(s, d):
    return r6(T.kinematics(I.frames(s, d)), "x", "vx", "ax").drop("kp")


@Q.add("w5_kinematics_unsmoothed", _kin_sql(False))
def _(s, d):
    return r6(T.kinematics(I.frames(s, d), smooth=False), "x", "vx", "ax").drop("kp")


@Q.add("w6_simple_kinematics", f"""{FR} SELECT clip_id, frame_idx,
round(COALESCE(x - lag(x) {W}, lead(x) {W} - x, 0), 6) AS vx,
round(COALESCE(x - 2 * lag(x) {W} + lag(x, 2) {W}, 0), 6) AS ax FROM frames""")
def _(s, d):
    return r6(T.simple_kinematics(I.frames(s, d)), "vx", "ax").drop("kp", "x")


@Q.add("w7_variable_dt_kinematics", f"""{FR},
g AS (SELECT *, (frame_idx * 3) // 2 % 64 AS ft FROM frames),
t AS (SELECT *, ft - lag(ft) {W} AS g0 FROM (SELECT clip_id, frame_idx, x, (frame_idx * 3) // 4 AS ft FROM frames)),
u AS (SELECT *, CASE WHEN g0 = 0 THEN 1 ELSE g0 END AS dt FROM t),
v AS (SELECT *, (x - lag(x) {W}) / dt AS v0 FROM u),
c AS (SELECT *, COALESCE(v0, lead(v0) {W}, 0) AS vx FROM v)
SELECT clip_id, frame_idx, round(vx, 6) AS vx, round(COALESCE((vx - lag(vx) {W}) / dt, 0), 6) AS ax FROM c""")
def _(s, d):
    f = I.frames(s, d).withColumn("ft", F.floor(F.col("frame_idx") * 3 / 4).cast("int"))
    return r6(T.variable_dt_kinematics(f, "ft"), "vx", "ax").select("clip_id", "frame_idx", "vx", "ax")


@Q.add("w8_ema_anchor", f"""{FR.replace('WITH', 'WITH RECURSIVE', 1)},
e(clip_id, frame_idx, a) AS (SELECT clip_id, frame_idx, x FROM frames WHERE frame_idx = 0 UNION ALL
  SELECT e.clip_id, f.frame_idx, 0.9::DOUBLE * e.a + 0.1::DOUBLE * f.x FROM e
  JOIN frames f ON f.clip_id = e.clip_id AND f.frame_idx = e.frame_idx + 1)
SELECT clip_id, frame_idx, round(a, 6) AS x FROM e""")
def _(s, d):
    return r6(T.ema(I.frames(s, d)), "x").select("clip_id", "frame_idx", "x")


def _resample_sql(n):
    return f"""{FR}, sz AS (SELECT clip_id, max(frame_idx) + 1 AS t FROM frames GROUP BY clip_id),
g AS (SELECT clip_id, t, n, unnest(generate_series(0, n - 1)) AS i FROM (SELECT *, {n} AS n FROM sz)),
p AS (SELECT *, i * (t - 1) / CAST(n - 1 AS DOUBLE) AS pos FROM g)
SELECT p.clip_id, CAST(i AS INTEGER) AS frame_idx, round(pos, 6) AS source_frame,
       round(a.x + (pos - floor(pos)) * (COALESCE(b.x, a.x) - a.x), 6) AS x
FROM p JOIN frames a ON a.clip_id = p.clip_id AND a.frame_idx = floor(pos)
LEFT JOIN frames b ON b.clip_id = p.clip_id AND b.frame_idx = floor(pos) + 1"""


@Q.add("w18_ensure_min_frames", _resample_sql("GREATEST(t, 100)"))
def _(s, d):
    return r6(T.ensure_min_frames(I.frames(s, d), 100), "x", "source_frame").drop("kp")


@Q.add("w19_time_warp", _resample_sql("CAST(GREATEST(4, round_even(t * 0.8::DOUBLE, 0)) AS INTEGER)"))
def _(s, d):
    return r6(T.time_warp(I.frames(s, d), 0.8), "x", "source_frame").drop("kp")


@Q.add("w20_motion_aware_sample", f"""{FR},
e AS (SELECT clip_id, frame_idx, round(COALESCE(abs(lead(x) {W} - x), abs(x - lag(x) {W}), 0), 9) AS energy FROM frames),
u AS (SELECT DISTINCT CAST(floor(i * 63.0::DOUBLE / 13) AS INTEGER) AS f FROM generate_series(0, 13) g(i)),
r AS (SELECT clip_id, frame_idx, row_number() OVER (PARTITION BY clip_id ORDER BY energy DESC, frame_idx) AS rn
      FROM e WHERE frame_idx NOT IN (SELECT f FROM u))
SELECT clip_id, frame_idx, true AS on_grid FROM e WHERE frame_idx IN (SELECT f FROM u)
UNION ALL SELECT clip_id, frame_idx, false FROM r WHERE rn <= 6""")
def _(s, d):
    return T.motion_aware_sample(I.frames(s, d), 20)


@Q.add("w21_uniform_subsample", f"""{FR} SELECT clip_id, frame_idx, round(x, 6) AS x FROM frames WHERE frame_idx IN
(SELECT CAST(floor(i * 63.0::DOUBLE / 23) AS INTEGER) FROM generate_series(0, 23) g(i))""")
def _(s, d):
    return r6(T.uniform_subsample(I.frames(s, d), 24), "x").drop("kp")


@Q.add("w21_stride_subsample", f"""{FR} SELECT clip_id, CAST(frame_idx // 4 AS INTEGER) AS frame_idx, round(x, 6) AS x
FROM frames WHERE frame_idx % 4 = 0""")
def _(s, d):
    return r6(T.stride_subsample(I.frames(s, d), 20), "x").drop("kp")


@Q.add("w22_jump_clamp", f"""{FR.replace('WITH', 'WITH RECURSIVE', 1)},
j(clip_id, frame_idx, c) AS (SELECT clip_id, frame_idx, x FROM frames WHERE frame_idx = 0 UNION ALL
  SELECT j.clip_id, f.frame_idx, CASE WHEN abs(f.x - j.c) > 0.25 THEN COALESCE(0.5 * (j.c + n.x), j.c) ELSE f.x END
  FROM j JOIN frames f ON f.clip_id = j.clip_id AND f.frame_idx = j.frame_idx + 1
  LEFT JOIN frames n ON n.clip_id = j.clip_id AND n.frame_idx = j.frame_idx + 2)
SELECT clip_id, frame_idx, round(c, 6) AS x FROM j""")
def _(s, d):
    return r6(T.jump_clamp(I.frames(s, d)), "x").drop("kp")


def _gauss():
    k = ["exp(-2.0::DOUBLE)", "exp(-0.5::DOUBLE)", "1.0", "exp(-0.5::DOUBLE)", "exp(-2.0::DOUBLE)"]
    at = [f"COALESCE(lag(x, 2) {W}, lag(x) {W}, x)", f"COALESCE(lag(x) {W}, x)", "x",
          f"COALESCE(lead(x) {W}, x)", f"COALESCE(lead(x, 2) {W}, lead(x) {W}, x)"]
    top = " + ".join(f"{a} * {b}" for a, b in zip(k, at))
    return f"{FR} SELECT clip_id, frame_idx, round(({top}) / ({' + '.join(k)}), 6) AS x FROM frames"


@Q.add("w23_gaussian_smooth", _gauss())
def _(s, d):
    return r6(T.gaussian_smooth(I.frames(s, d)), "x").drop("kp")


def _frenet_sql():
    ax = "xyz"
    v0 = ", ".join(f"({c} - lag({c}) {W}) * 30 AS w{c}" for c in ax)
    v = ", ".join(f"COALESCE(w{c}, lead(w{c}) {W}, 0) AS v{c}" for c in ax)
    a0 = ", ".join(f"(lead(v{c}) {W} - lag(v{c}) {W}) * 15 AS q{c}" for c in ax)
    a = ", ".join(f"COALESCE(q{c}, lead(q{c}) {W}, lag(q{c}) {W}, 0) AS a{c}" for c in ax)
    j0 = ", ".join(f"(lead(a{c}) {W} - lag(a{c}) {W}) * 15 AS k{c}" for c in ax)
    j = ", ".join(f"COALESCE(k{c}, lead(k{c}) {W}, lag(k{c}) {W}, 0) AS j{c}" for c in ax)
    return f"""{TR}, s1 AS (SELECT *, {v0} FROM triples), s2 AS (SELECT *, {v} FROM s1), s3 AS (SELECT *, {a0} FROM s2),
s4 AS (SELECT *, {a} FROM s3), s5 AS (SELECT *, {j0} FROM s4), s6 AS (SELECT *, {j} FROM s5),
c AS (SELECT *, vy * az - vz * ay AS c0, vz * ax - vx * az AS c1, vx * ay - vy * ax AS c2,
        sqrt(vx * vx + vy * vy + vz * vz) AS sp FROM s6),
f AS (SELECT *, c0 * c0 + c1 * c1 + c2 * c2 AS cc FROM c)
SELECT clip_id, frame_idx, round(sp, 5) AS speed, round(sqrt(ax * ax + ay * ay + az * az), 5) AS acceleration,
  round(sqrt(jx * jx + jy * jy + jz * jz), 4) AS jerk, round(sqrt(cc) / (sp * sp * sp + 1e-3), 5) AS curvature,
  round((c0 * jx + c1 * jy + c2 * jz) / (cc + 1e-6), 5) AS torsion FROM f"""


@Q.add("w24_jerk_curvature_torsion", _frenet_sql())
def _(s, d):
    f = T.frenet(I.triples(s, d)).drop("kp")
    for c, n in (("speed", 5), ("acceleration", 5), ("jerk", 4), ("curvature", 5), ("torsion", 5)):
        f = f.withColumn(c, F.round(c, n))
    return f


@Q.add("w28_extract_spans", f"""{FR}, a AS (SELECT *, x >= -0.05 AS act FROM frames),
g AS (SELECT *, frame_idx - row_number() {W} AS isl FROM a WHERE act)
SELECT clip_id, min(frame_idx) AS start, max(frame_idx) + 1 AS "end" FROM g
GROUP BY clip_id, isl HAVING count(*) >= 4""")
def _(s, d):
    return T.spans(I.frames(s, d), F.col("x") >= -0.05)


def _bio(s, d):
    v = F.col("embedding").cast("array<double>")
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("clip_id"), F.explode_outer(F.transform(
        F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(
            i.alias("frame_idx"), *[(F.element_at(v, i * 4 + k) * 12).alias(n)
                                    for k, n in ((1, "o"), (2, "b"), (3, "i"), (4, "tok"))]))).alias("s"))
    p = F.col("p")
    return e.select("clip_id", "s.*").withColumn("p", V.softmax(F.array("o", "b", "i"))).select(
        "clip_id", "frame_idx", p[0].alias("p_o"), p[1].alias("p_b"), p[2].alias("p_i"),
        F.pmod(F.floor(F.col("tok") * 2), F.lit(4)).cast("int").alias("token"),
        (1 / (1 + F.exp(-F.col("tok")))).alias("conf"))


@Q.add("w29_bio_segments", """WITH r AS (SELECT vec_id AS clip_id, f AS frame_idx, exp(embedding[4*f+1]::DOUBLE*12) AS eo,
  exp(embedding[4*f+2]::DOUBLE*12) AS eb, exp(embedding[4*f+3]::DOUBLE*12) AS ei, embedding[4*f+4]::DOUBLE*12 AS tok
  FROM (SELECT *, unnest(generate_series(0, 15)) AS f FROM embeddings)),
p AS (SELECT clip_id, frame_idx, eo/(eo+eb+ei) AS po, eb/(eo+eb+ei) AS pb, ei/(eo+eb+ei) AS pi,
  ((CAST(floor(tok*2) AS INTEGER) % 4) + 4) % 4 AS token, 1/(1+exp(-tok)) AS conf FROM r),
m AS (SELECT *, CASE WHEN (pb > po AND pb >= pi) OR pb >= 0.4 THEN 1 WHEN po >= pb AND po >= pi AND po > 0.6 THEN 0 END AS mk FROM p),
l AS (SELECT *, last_value(mk IGNORE NULLS) OVER w AS st,
  last_value(CASE WHEN mk = 0 THEN frame_idx END IGNORE NULLS) OVER w AS grp FROM m
  WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)),
t AS (SELECT clip_id, grp, token, count(*) AS n, sum(conf) AS c, min(frame_idx) AS s, max(frame_idx) AS e
  FROM l WHERE st = 1 GROUP BY clip_id, grp, token)
SELECT clip_id, CAST(min(s) AS INTEGER) AS start, CAST(max(e) AS INTEGER) AS "end", CAST(max(e) - min(s) + 1 AS INTEGER) AS duration,
  CAST(arg_max(token, (n, -token)) FILTER (WHERE token <> 0) AS INTEGER) AS token, round(sum(c) / sum(n), 6) AS confidence
FROM t GROUP BY clip_id, grp HAVING max(e) - min(s) + 1 >= 3 AND count(*) FILTER (WHERE token <> 0) > 0""")
def _(s, d):
    return r6(T.bio_segments(_bio(s, d)), "confidence")


@Q.add("w30_ctc_collapse", f"""WITH {I.EV},
tk AS (SELECT user_id AS seq_id, row_number() OVER w AS t, k % 3 AS token, lag(k % 3) OVER w AS prev FROM act
       WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)),
dd AS (SELECT user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS seq_id, k % 3 AS token, ts, event_id FROM act),
w AS (SELECT *, lag(token) OVER (PARTITION BY seq_id ORDER BY ts, event_id) AS prev FROM dd)
SELECT seq_id, list(token ORDER BY ts, event_id) AS tokens FROM w
WHERE token <> 0 AND (prev IS NULL OR prev <> token) GROUP BY seq_id""")
def _(s, d):
    ev = I.events(s, d).select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("seq_id"),
        F.struct("ts", "event_id").alias("t"), (F.col("k") % 3).alias("token"))
    return U.collapse(ev)


@Q.add("w31_rolling_mean", f"""{FR} SELECT clip_id, frame_idx, round(avg(x) OVER
(PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS x FROM frames""")
def _(s, d):
    return r6(T.rolling_mean(I.frames(s, d)), "x").drop("kp")


@Q.add("w32_frame_index_audit", """WITH c AS (SELECT conv_id AS clip_id, list(turn % 5 ORDER BY turn) AS f, max(turn) + 1 AS n
FROM conversations GROUP BY conv_id)
SELECT clip_id, len(f) = n AS length_match,
  len(list_filter(generate_series(2, len(f)), lambda i: f[i] <= f[i - 1])) = 0 AS increasing,
  len(list_distinct(f)) = len(f) AS is_unique, list_contains(f[2:], 0) AS zero_padded FROM c""")
def _(s, d):
    c = table(s, d, "conversations").groupBy(F.col("conv_id").alias("clip_id")).agg(
        F.transform(F.array_sort(F.collect_list("turn")), lambda t: t % 5).alias("frame_indices"),
        (F.max("turn") + 1).alias("n_frames"))
    return T.frame_index_audit(c)

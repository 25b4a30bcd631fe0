"""Pose queries: each vector is one frame of a 21-joint hand or of a 60-point body."""

from pyspark.sql import functions as F

from tracklore.operators import poses as P
from tracklore.plans import inputs as I
from tracklore.plans.registry import QuerySet

Q = QuerySet()
HL = f"""WITH {I.HANDS},
h AS (SELECT clip_id, frame_idx, list({{'x': x, 'y': y, 'z': z}} ORDER BY kp) AS k FROM hand_pts GROUP BY ALL)"""
BL = f"""WITH {I.BODIES},
b AS (SELECT clip_id, frame_idx, list({{'x': x, 'y': y, 'z': z, 'valid': valid}} ORDER BY kp) AS k FROM body GROUP BY ALL)"""
W = "OVER (PARTITION BY clip_id ORDER BY frame_idx)"


def points(df, *more):
    """One row per keypoint, coordinates rounded, for comparison."""
    p = df.select("clip_id", "frame_idx", *more, F.posexplode_outer("kps").alias("kp", "p"))
    return p.select("clip_id", "frame_idx", "kp", *more,
                    *[F.round(F.col(f"p.{c}"), 6).alias(c) for c in "xyz"])


def r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


def d2(a, b):
    """Squared distance of two struct expressions in SQL."""
    return "(" + " + ".join(f"(({a}).{c} - ({b}).{c}) * (({a}).{c} - ({b}).{c})" for c in "xyz") + ")"


def k(i):
    return f"k[{i + 1}]"


@Q.add("w13_hand_wrist_normalize", f"""{HL},
m AS (SELECT clip_id, frame_idx, k[1] AS w, GREATEST(1e-5, list_max(list_transform(k, lambda p: sqrt({d2('p', 'k[1]')})))) AS m,
  unnest(k) AS p, unnest(generate_series(0, 20)) AS kp FROM h)
SELECT clip_id, frame_idx, CAST(kp AS INTEGER) AS kp, round((p.x - w.x) / m, 6) AS x, round((p.y - w.y) / m, 6) AS y,
       round((p.z - w.z) / m, 6) AS z FROM m""")
def _(s, d):
    return points(P.hand_wrist_normalize(I.hands(s, d)))


def _align_sql():
    rel = lambda i, t: ", ".join(f"(k[{i + 1}].{c} - k[1].{c}) / s AS {t}{c}" for c in "xyz")
    cr = lambda a, b, t: (f"{a}y * {b}z - {a}z * {b}y AS {t}x, {a}z * {b}x - {a}x * {b}z AS {t}y, "  # noqa: E731
                          f"{a}x * {b}y - {a}y * {b}x AS {t}z")
    nrm = lambda t: f"sqrt({t}x * {t}x + {t}y * {t}y + {t}z * {t}z)"
    return f"""{HL}, s0 AS (SELECT *, sqrt({d2('k[10]', 'k[1]')}) AS q FROM h),
s1 AS (SELECT clip_id, frame_idx, k, CASE WHEN q < 1e-5 THEN 1.0 ELSE q END AS s FROM s0),
s2 AS (SELECT *, {rel(9, 'm')}, {rel(5, 'i')}, {rel(17, 'q')} FROM s1),
s3 AS (SELECT *, mx / {nrm('m')} AS ux, my / {nrm('m')} AS uy, mz / {nrm('m')} AS uz FROM s2),
s4 AS (SELECT *, {cr('u', 'i', 'a')}, {cr('u', 'q', 'e')} FROM s3),
s5 AS (SELECT *, {", ".join(f"CASE WHEN {nrm('a')} < 1e-5 THEN e{c} ELSE a{c} END AS t{c}" for c in "xyz")} FROM s4),
s6 AS (SELECT *, {", ".join(f"t{c} / {nrm('t')} AS n{c}" for c in "xyz")} FROM s5),
s7 AS (SELECT *, {cr('n', 'u', 'd')}, unnest(k) AS p, unnest(generate_series(0, 20)) AS kp FROM s6),
s8 AS (SELECT *, {", ".join(f"(p.{c} - k[1].{c}) / s AS v{c}" for c in "xyz")} FROM s7)
SELECT clip_id, frame_idx, CAST(kp AS INTEGER) AS kp, round(s, 6) AS scale,
  {", ".join(f"round(vx * {t}x + vy * {t}y + vz * {t}z, 6) AS {o}" for t, o in (('d', 'x'), ('u', 'y'), ('n', 'z')))} FROM s8"""


@Q.add("w14_hand_frame_align", _align_sql())
def _(s, d):
    return points(r6(P.hand_frame_align(I.hands(s, d)), "scale"), "scale")


@Q.add("p8_validity_mask", f"""WITH {I.HANDS}
SELECT clip_id, frame_idx, CAST(kp AS INTEGER) AS kp, abs(x) > 1e-4 OR abs(y) > 1e-4 AS valid FROM hand_pts""")
def _(s, d):
    v = P.validity(I.hands(s, d))
    return v.select("clip_id", "frame_idx", F.posexplode_outer("kps").alias("kp", "p")).select(
        "clip_id", "frame_idx", "kp", "p.valid")


def _flag_sql(name, start):
    return f"""SELECT clip_id, frame_idx, max(GREATEST(abs(x), abs(y), abs(z))) > 1e-4 AND (
    bool_or(abs(x) > 2.2 OR abs(y) > 2.5) OR max((x - wx) * (x - wx) + (y - wy) * (y - wy) + (z - wz) * (z - wz)) > 0.3025
    OR avg(x * x + y * y + z * z) - avg(x) * avg(x) - avg(y) * avg(y) - avg(z) * avg(z) < 0.000225) AS {name}_invalid
  FROM (SELECT *, first_value(x) OVER v AS wx, first_value(y) OVER v AS wy, first_value(z) OVER v AS wz
        FROM body WHERE kp BETWEEN {start} AND {start + 20}
        WINDOW v AS (PARTITION BY clip_id, frame_idx ORDER BY kp)) GROUP BY clip_id, frame_idx"""


FLAGS = f"WITH {I.BODIES}, lf AS ({_flag_sql('left', 0)}), rf AS ({_flag_sql('right', 21)})"


@Q.add("p12_out_of_bounds_hands", f"{FLAGS} SELECT * FROM lf JOIN rf USING (clip_id, frame_idx)")
def _(s, d):
    return P.hand_flags(I.bodies(s, d)).select("clip_id", "frame_idx", "left_invalid", "right_invalid")


@Q.add("w3_clean_hands", f"""{FLAGS},
fl AS (SELECT clip_id, frame_idx, 0 AS hand, left_invalid AS bad FROM lf UNION ALL SELECT clip_id, frame_idx, 1, right_invalid FROM rf),
nb AS (SELECT *, max(CASE WHEN NOT bad THEN frame_idx END) OVER (PARTITION BY clip_id, hand ORDER BY frame_idx) AS a,
  min(CASE WHEN NOT bad THEN frame_idx END) OVER (PARTITION BY clip_id, hand ORDER BY frame_idx DESC) AS b FROM fl),
j AS (SELECT body.*, bad, a, b, CASE WHEN kp < 42 THEN kp // 21 ELSE 2 END AS hd FROM body
  LEFT JOIN nb ON nb.clip_id = body.clip_id AND nb.frame_idx = body.frame_idx AND kp < 42 AND hand = kp // 21)
SELECT j.clip_id, j.frame_idx, CAST(j.kp AS INTEGER) AS kp,
  {", ".join(f"round(CASE WHEN j.bad IS NULL OR NOT j.bad THEN j.{c} WHEN j.b - j.a - 1 <= 5 THEN pa.{c} + (pb.{c} - pa.{c}) * (j.frame_idx - j.a) / (j.b - j.a) ELSE 0 END, 6) AS {c}" for c in "xyz")}
FROM j LEFT JOIN body pa ON pa.clip_id = j.clip_id AND pa.kp = j.kp AND pa.frame_idx = j.a
LEFT JOIN body pb ON pb.clip_id = j.clip_id AND pb.kp = j.kp AND pb.frame_idx = j.b""")
def _(s, d):
    return points(P.clean_hands(I.bodies(s, d)))


@Q.add("p7_sanitize_visibility", f"""WITH {I.BODIES},
r AS (SELECT *, max(z) OVER (PARTITION BY clip_id) > 1.01 OR min(z) OVER (PARTITION BY clip_id) < -0.01 AS dep FROM body),
v AS (SELECT clip_id, frame_idx, kp, CASE WHEN dep THEN CASE WHEN x <> 0 AND y <> 0 THEN 1.0 ELSE 0.0 END ELSE z END AS c FROM r)
SELECT clip_id, frame_idx, round(avg(c) FILTER (WHERE kp < 21), 6) AS left_conf,
  round(avg(c) FILTER (WHERE kp BETWEEN 21 AND 41), 6) AS right_conf, round(avg(c) FILTER (WHERE kp >= 42), 6) AS body_conf
FROM v GROUP BY clip_id, frame_idx""")
def _(s, d):
    return r6(P.sanitize_visibility(I.bodies(s, d)), "left_conf", "right_conf", "body_conf").drop("kps")


SWAP = ", ".join(str(i) for i in P.SWAP)


@Q.add("w17_canonicalize_handedness", f"""WITH {I.BODIES},
vf AS (SELECT clip_id, frame_idx, bool_or(valid AND kp < 21) AS lv, bool_or(valid AND kp BETWEEN 21 AND 41) AS rv FROM body GROUP BY ALL),
st AS (SELECT clip_id, kp, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS e
       FROM body WHERE kp IN (0, 21) WINDOW w AS (PARTITION BY clip_id, kp ORDER BY frame_idx)),
en AS (SELECT clip_id, COALESCE(sum(e) FILTER (WHERE kp = 0), 0) AS le, COALESCE(sum(e) FILTER (WHERE kp = 21), 0) AS re FROM st GROUP BY clip_id),
pr AS (SELECT clip_id, avg(CASE WHEN lv THEN 1.0 ELSE 0.0 END) AS lv, avg(CASE WHEN rv THEN 1.0 ELSE 0.0 END) AS rv FROM vf GROUP BY clip_id),
fg AS (SELECT clip_id, (lv > 0.40 AND rv < 0.15) OR (lv > 0.35 AND le > 2.5 * GREATEST(1e-4, re) AND le > 0.15) AS mirrored FROM en JOIN pr USING (clip_id))
SELECT o.clip_id, o.frame_idx, CAST(o.kp AS INTEGER) AS kp, mirrored, round(CASE WHEN mirrored THEN -q.x ELSE o.x END, 6) AS x,
  round(CASE WHEN mirrored THEN q.y ELSE o.y END, 6) AS y, round(CASE WHEN mirrored THEN q.z ELSE o.z END, 6) AS z
FROM body o JOIN fg USING (clip_id) JOIN body q ON q.clip_id = o.clip_id AND q.frame_idx = o.frame_idx AND q.kp = [{SWAP}][o.kp + 1]""")
def _(s, d):
    return points(P.canonical_handedness(I.bodies(s, d)), "mirrored")


@Q.add("w9_reference_normalize", f"""{BL.replace('WITH', 'WITH RECURSIVE', 1)},
f AS (SELECT clip_id, frame_idx, k, k[43].valid AND k[44].valid AS bth, k[43].valid AND k[44].valid AND k[45].valid AND k[46].valid AS hip,
  sqrt({d2('k[43]', 'k[44]')}) AS w,
  {", ".join(f"(k[43].{c} + k[44].{c}) * 0.5 AS m{c}, (k[45].{c} + k[46].{c}) * 0.5 AS p{c}" for c in "xyz")} FROM b),
pr AS (SELECT clip_id, count(*) FILTER (WHERE bth) AS ns, median(w) FILTER (WHERE bth) AS wid,
  median(sqrt(w * w + (mx - px) * (mx - px) + (my - py) * (my - py) + (mz - pz) * (mz - pz))) FILTER (WHERE hip) AS diag,
  {", ".join(f"avg(m{c}) FILTER (WHERE bth) AS a{c}" for c in "xyz")}, count(*) AS n FROM f GROUP BY clip_id),
hp AS (SELECT clip_id, {", ".join(f"avg({c}) AS h{c}" for c in "xyz")} FROM body WHERE valid AND kp < 42 GROUP BY clip_id),
rd AS (SELECT body.clip_id, max(sqrt((x - hx) * (x - hx) + (y - hy) * (y - hy) + (z - hz) * (z - hz))) AS radius
       FROM body JOIN hp ON hp.clip_id = body.clip_id WHERE valid AND kp < 42 GROUP BY body.clip_id),
nb AS (SELECT *, max(CASE WHEN bth THEN frame_idx END) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS lo,
  min(CASE WHEN bth THEN frame_idx END) OVER (PARTITION BY clip_id ORDER BY frame_idx DESC) AS hi FROM f),
ip AS (SELECT nb.clip_id, nb.frame_idx, {", ".join(f"CASE WHEN nb.lo IS NULL THEN h.m{c} WHEN nb.hi IS NULL OR nb.hi = nb.lo THEN l.m{c} ELSE l.m{c} + (h.m{c} - l.m{c}) * (nb.frame_idx - nb.lo) / (nb.hi - nb.lo) END AS m{c}" for c in "xyz")}
  FROM nb LEFT JOIN f l ON l.clip_id = nb.clip_id AND l.frame_idx = nb.lo LEFT JOIN f h ON h.clip_id = nb.clip_id AND h.frame_idx = nb.hi),
em(clip_id, frame_idx, ex, ey, ez) AS (SELECT clip_id, frame_idx, mx, my, mz FROM ip WHERE frame_idx = 0 UNION ALL
  SELECT em.clip_id, ip.frame_idx, {", ".join(f"0.9::DOUBLE * e{c} + 0.1::DOUBLE * m{c}" for c in "xyz")} FROM em
  JOIN ip ON ip.clip_id = em.clip_id AND ip.frame_idx = em.frame_idx + 1),
sc AS (SELECT pr.*, hx, hy, hz, CASE WHEN ns > 0 THEN GREATEST(1e-3, COALESCE(diag * 0.65, wid)) WHEN hx IS NOT NULL THEN GREATEST(1e-3, radius) ELSE 1.0 END AS scale
  FROM pr LEFT JOIN hp ON hp.clip_id = pr.clip_id LEFT JOIN rd ON rd.clip_id = pr.clip_id)
SELECT o.clip_id, o.frame_idx, CAST(o.kp AS INTEGER) AS kp, round(scale, 6) AS scale,
  {", ".join(f"round((o.{c} - CASE WHEN ns > 0 THEN CASE WHEN n = 1 OR ns = 1 THEN a{c} ELSE e{c} END ELSE COALESCE(h{c}, 0) END) / scale, 5) AS {c}" for c in "xyz")}
FROM body o JOIN sc ON sc.clip_id = o.clip_id JOIN em ON em.clip_id = o.clip_id AND em.frame_idx = o.frame_idx""")
def _(s, d):
    out = r6(P.reference_normalize(I.bodies(s, d)), "scale")
    p = out.select("clip_id", "frame_idx", "scale", F.posexplode_outer("kps").alias("kp", "p"))
    return p.select("clip_id", "frame_idx", "kp", "scale",
                    *[F.round(F.col(f"p.{c}"), 5).alias(c) for c in "xyz"])


@Q.add("w10_unified_normalize", f"""{BL.replace('WITH', 'WITH RECURSIVE', 1)},
f AS (SELECT clip_id, frame_idx, sqrt(k[43].x**2 + k[43].y**2) > 0.01 AND sqrt(k[44].x**2 + k[44].y**2) > 0.01 AS ok, sqrt({d2('k[43]', 'k[44]')}) AS w,
  {", ".join(f"(k[43].{c} + k[44].{c}) * 0.5 AS m{c}" for c in "xyz")} FROM b),
pr AS (SELECT clip_id, GREATEST(1e-3, median(w) FILTER (WHERE ok)) AS scale FROM f GROUP BY clip_id),
nb AS (SELECT *, max(CASE WHEN ok THEN frame_idx END) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS lo,
  min(CASE WHEN ok THEN frame_idx END) OVER (PARTITION BY clip_id ORDER BY frame_idx DESC) AS hi FROM f),
ip AS (SELECT nb.clip_id, nb.frame_idx, {", ".join(f"CASE WHEN nb.lo IS NULL THEN h.m{c} WHEN nb.hi IS NULL OR nb.hi = nb.lo THEN l.m{c} ELSE l.m{c} + (h.m{c} - l.m{c}) * (nb.frame_idx - nb.lo) / (nb.hi - nb.lo) END AS m{c}" for c in "xyz")}
  FROM nb LEFT JOIN f l ON l.clip_id = nb.clip_id AND l.frame_idx = nb.lo LEFT JOIN f h ON h.clip_id = nb.clip_id AND h.frame_idx = nb.hi),
em(clip_id, frame_idx, ex, ey, ez) AS (SELECT clip_id, frame_idx, mx, my, mz FROM ip WHERE frame_idx = 0 UNION ALL
  SELECT em.clip_id, ip.frame_idx, {", ".join(f"0.9::DOUBLE * e{c} + 0.1::DOUBLE * m{c}" for c in "xyz")} FROM em
  JOIN ip ON ip.clip_id = em.clip_id AND ip.frame_idx = em.frame_idx + 1)
SELECT o.clip_id, o.frame_idx, CAST(o.kp AS INTEGER) AS kp, round(scale, 6) AS scale, {", ".join(f"round((o.{c} - e{c}) / scale, 6) AS {c}" for c in "xyz")}
FROM body o JOIN pr ON pr.clip_id = o.clip_id JOIN em ON em.clip_id = o.clip_id AND em.frame_idx = o.frame_idx""")
def _(s, d):
    return points(r6(P.unified_normalize(I.bodies(s, d)), "scale"), "scale")


@Q.add("w11_se3_normalize", f"""{BL},
f AS (SELECT clip_id, frame_idx, k, sqrt(k[43].x**2 + k[43].y**2) > 1e-4 AND sqrt(k[44].x**2 + k[44].y**2) > 1e-4 AS has,
  sqrt((k[43].x - k[44].x)**2 + (k[43].y - k[44].y)**2) AS dd, (k[43].x + k[44].x) * 0.5 AS mx, (k[43].y + k[44].y) * 0.5 AS my FROM b),
pr AS (SELECT clip_id, avg(dd) FILTER (WHERE dd > 1e-4) AS dist, avg(mx) FILTER (WHERE has) AS cx, avg(my) FILTER (WHERE has) AS cy FROM f GROUP BY clip_id)
SELECT o.clip_id, o.frame_idx, CAST(o.kp AS INTEGER) AS kp, round(1.0 / GREATEST(dist, 1e-4), 6) AS scale,
  round((o.x - CASE WHEN has THEN mx ELSE cx END) / GREATEST(dist, 1e-4), 6) AS x,
  round((o.y - CASE WHEN has THEN my ELSE cy END) / GREATEST(dist, 1e-4), 6) AS y, round(o.z, 6) AS z
FROM body o JOIN f ON f.clip_id = o.clip_id AND f.frame_idx = o.frame_idx JOIN pr ON pr.clip_id = o.clip_id""")
def _(s, d):
    return points(r6(P.se3_normalize(I.bodies(s, d)), "scale"), "scale")


def _part_sql():
    anchors = {"l": ("k[1]", "k[10]"), "r": ("k[22]", "k[31]"), "f": ("k[49]", "k[53]")}
    cols = [f"{a}.{c} AS {t}{c}" for t, (a, _) in anchors.items() for c in "xyz"]
    cols += [f"GREATEST(1e-5, sqrt({d2(o, a)})) AS {t}s" for t, (a, o) in anchors.items()]
    cols += [f"(k[43].{c} + k[44].{c}) * 0.5 AS t{c}" for c in "xyz"]
    cols += [f"GREATEST(1e-5, sqrt({d2('k[43]', 'k[44]')})) AS ts"]
    pick = lambda c: f"CASE WHEN kp < 21 THEN l{c} WHEN kp < 42 THEN r{c} WHEN kp < 48 THEN t{c} ELSE f{c} END"
    return f"""{BL}, p AS (SELECT clip_id, frame_idx, {", ".join(cols)} FROM b)
SELECT o.clip_id, o.frame_idx, CAST(o.kp AS INTEGER) AS kp, {", ".join(f"round((o.{c} - {pick(c)}) / ({pick('s')}), 5) AS {c}" for c in "xyz")},
  round((rx - lx) / ts, 5) AS hands_x
FROM body o JOIN p ON p.clip_id = o.clip_id AND p.frame_idx = o.frame_idx"""


@Q.add("w12_part_normalize", _part_sql())
def _(s, d):
    p = P.part_normalize(I.bodies(s, d)).select(
        "clip_id", "frame_idx", F.round("hands.x", 5).alias("hands_x"), F.posexplode_outer("kps").alias("kp", "p"))
    return p.select("clip_id", "frame_idx", "kp", "hands_x",
                    *[F.round(F.col(f"p.{c}"), 5).alias(c) for c in "xyz"])


def _phon_sql():
    feats = []
    for w in (1, 22):
        u = {c: f"(k[{w + 5}].{c} - k[{w}].{c})" for c in "xyz"}
        v = {c: f"(k[{w + 17}].{c} - k[{w}].{c})" for c in "xyz"}
        n = [f"({u['y']} * {v['z']} - {u['z']} * {v['y']})", f"({u['z']} * {v['x']} - {u['x']} * {v['z']})",
             f"({u['x']} * {v['y']} - {u['y']} * {v['x']})"]
        size = "GREATEST(1e-5, sqrt(" + " + ".join(f"{a} * {a}" for a in n) + "))"
        feats += [f"{a} / {size}" for a in n]
    dv = lambda w, c: f"COALESCE(k[{w}].{c} - lag(k[{w}].{c}) {W}, 0)"
    vel = ", ".join(f"{dv(w, c)} AS v{w}{c}" for w in (1, 22) for c in "xyz")
    dt = " + ".join(f"v1{c} * v22{c}" for c in "xyz")
    nn = " * ".join("(" + " + ".join(f"v{w}{c} * v{w}{c}" for c in "xyz") + ")" for w in (1, 22))
    feats.append(f"({dt}) / GREATEST(1e-5, sqrt({nn}))")
    face = ", ".join(f"list_avg(list_transform(k[49:60], lambda p: p.{c})) AS f{c}" for c in "xyz")
    for w in (1, 22):
        feats.append("exp(-(" + " + ".join(f"(k[{w}].{c} - f{c}) * (k[{w}].{c} - f{c})" for c in "xyz") + ") / 0.245::DOUBLE)")
    for w in (1, 22):
        for t in (4, 8, 12, 16, 20):
            feats.append(f"GREATEST(0, LEAST(1, sqrt({d2(f'k[{w + t}]', f'k[{w}]')}) / (1.85 * GREATEST(1e-4, sqrt({d2(f'k[{w + 9}]', f'k[{w}]')})))))")
    out = ", ".join(f"round({f}, 5) AS f{i}" for i, f in enumerate(feats))
    return f"{BL}, v AS (SELECT *, {vel}, {face} FROM b) SELECT clip_id, frame_idx, {out} FROM v"


@Q.add("w15_phonology_19d", _phon_sql())
def _(s, d):
    p = P.phonology(I.bodies(s, d))
    return p.select("clip_id", "frame_idx", *[F.round(F.col("phonology")[i], 5).alias(f"f{i}") for i in range(19)])


@Q.add("w16_cranial_imu", f"""{BL},
a AS (SELECT clip_id, frame_idx, k[54].x - k[53].x + 1e-6 AS dx, k[54].z - k[53].z AS dz,
  k[49].y - 0.5 * (k[53].y + k[54].y) AS dn, k[54].y - k[53].y AS dy FROM b),
g AS (SELECT clip_id, frame_idx, atan2(dz, dx) AS yaw, atan2(dn, dx) AS pitch, atan2(dy, dx) AS roll FROM a)
SELECT clip_id, frame_idx, {", ".join(f"round(GREATEST(-15, LEAST(15, COALESCE((lead({n}) {W} - lag({n}) {W}) * 15, (lead({n}, 2) {W} - {n}) * 15, ({n} - lag({n}, 2) {W}) * 15, 0))), 5) AS {n}_rate" for n in ("yaw", "pitch", "roll"))} FROM g""")
def _(s, d):
    f = P.cranial_imu(I.bodies(s, d))
    return f.select("clip_id", "frame_idx", *[F.round(c, 5).alias(c) for c in ("yaw_rate", "pitch_rate", "roll_rate")])


MOV = f"""WITH {I.BODIES},
m1 AS (SELECT *, {", ".join(f"COALESCE({c} - lag({c}) OVER w, 0) AS v{c}" for c in "xyz")} FROM body WINDOW w AS (PARTITION BY clip_id, kp ORDER BY frame_idx)),
m2 AS (SELECT *, {", ".join(f"COALESCE(v{c} - lag(v{c}) OVER w, 0) AS a{c}" for c in "xyz")} FROM m1 WINDOW w AS (PARTITION BY clip_id, kp ORDER BY frame_idx)),
mv AS (SELECT *, {", ".join(f"COALESCE(a{c} - lag(a{c}) OVER w, 0) AS j{c}" for c in "xyz")} FROM m2 WINDOW w AS (PARTITION BY clip_id, kp ORDER BY frame_idx)),
ms AS (SELECT clip_id, frame_idx, list({{'x': x, 'y': y, 'z': z}} ORDER BY kp) AS k, list({{'x': vx, 'y': vy, 'z': vz}} ORDER BY kp) AS v,
  list({{'x': ax, 'y': ay, 'z': az}} ORDER BY kp) AS a, list({{'x': jx, 'y': jy, 'z': jz}} ORDER BY kp) AS j FROM mv GROUP BY ALL)"""


def n_sql(e):
    return f"sqrt(({e}).x * ({e}).x + ({e}).y * ({e}).y + ({e}).z * ({e}).z)"


@Q.add("w25_activity_cues", f"""{MOV},
c AS (SELECT clip_id, frame_idx, k[22].y - (k[43].y + k[44].y) * 0.5 AS r_elev, k[1].y - (k[43].y + k[44].y) * 0.5 AS l_elev,
  sqrt({d2('k[22]', 'k[49]')}) AS r_nose, sqrt({d2('k[1]', 'k[49]')}) AS l_nose, {n_sql('v[22]')} AS r_energy, {n_sql('v[1]')} AS l_energy FROM ms),
p AS (SELECT *, GREATEST(r_elev, l_elev) AS e, r_energy + l_energy AS q, LEAST(r_nose, l_nose) AS dn FROM c),
s AS (SELECT *, [4 / (1 + exp(10 * e)) / (1 + exp(-10 * (0.15 - q))), 4 / (1 + exp(-15 * (0.18 - dn))) / (1 + exp(-10 * (0.25 - q))),
  4 / (1 + exp(-10 * (e - 0.05))) / (1 + exp(-10 * (q - 0.08))), 4 / (1 + exp(-10 * (e - 0.05))) / (1 + exp(-10 * (0.06 - q)))] AS pr FROM p)
SELECT clip_id, frame_idx, {", ".join(f"round({n}, 6) AS {n}" for n in ("r_elev", "l_elev", "r_nose", "l_nose", "r_energy", "l_energy"))},
  ['rest', 'fidget', 'signing', 'hold'][list_position(pr, list_max(pr))] AS state FROM s""")
def _(s, d):
    c = P.activity_cues(P.with_motion(I.bodies(s, d))).drop("priors")
    return r6(c, "r_elev", "l_elev", "r_nose", "l_nose", "r_energy", "l_energy")


def _fm(arr, w, rel=True):
    base = f"{arr}[{w}]" if rel else "{'x': 0.0, 'y': 0.0, 'z': 0.0}"
    return f"list_avg(list_transform({arr}[{w + 1}:{w + 20}], lambda p: sqrt({d2('p', base)})))"


def _act(arr, c):
    return f"CASE WHEN rv >= lv THEN {arr}[22].{c} ELSE {arr}[1].{c} END"


@Q.add("w26_transition_signature", f"""{MOV},
q AS (SELECT *, {n_sql('v[22]')} AS rv, {n_sql('v[1]')} AS lv FROM ms),
e AS (SELECT clip_id, frame_idx, GREATEST(rv, lv) AS ws, GREATEST({_fm('v', 22)}, {_fm('v', 1)}) AS fs,
  GREATEST({n_sql('j[22]')}, {n_sql('j[1]')}) AS wj, {", ".join(f"{_act('v', c)} AS p{c}, {_act('a', c)} AS q{c}" for c in "xyz")} FROM q),
f AS (SELECT *, ws / (ws + fs + 1e-4) AS br, LEAST(10, sqrt((py * qz - pz * qy)**2 + (pz * qx - px * qz)**2 + (px * qy - py * qx)**2) / (ws**3 + 1e-3)) AS cv,
  1 / (1 + exp(-20 * (0.06 - ws))) AS hd FROM e)
SELECT clip_id, frame_idx, round(ws, 5) AS wrist_speed, round(fs, 5) AS finger_speed, round(wj, 5) AS wrist_jerk, round(br, 5) AS ballistic_ratio,
  round(cv, 5) AS curvature, round(hd, 5) AS hold, round(tanh(ws / 0.15) * br * (1 - hd), 5) AS transition FROM f""")
def _(s, d):
    f = P.transition_signature(P.with_motion(I.bodies(s, d)))
    return f.select("clip_id", "frame_idx", *[F.round(c, 5).alias(c) for c in f.columns[2:]])


def _side(t, w, sh, x):
    o = {"x": f"(k[{w}].x - k[{sh}].x - {0.08 * x}) / 0.08", "y": f"(k[{w}].y - k[{sh}].y - 0.05) / 0.10",
         "z": f"(k[{w}].z - k[{sh}].z + 0.22) / 0.09"}
    prox = "exp(-0.5 * (" + " + ".join(f"({v}) * ({v})" for v in o.values()) + "))"
    return (f"{prox} AS {t}p, {n_sql(f'v[{w}]')} AS {t}v, {_fm('v', w)} AS {t}f, {_fm('a', w, False)} AS {t}a, k[{w}].y AS {t}y")


@Q.add("w27_spelling_signature", f"""{MOV},
e AS (SELECT clip_id, frame_idx, {_side('r', 22, 44, 1.0)}, {_side('l', 1, 43, -1.0)} FROM ms),
c AS (SELECT clip_id, frame_idx, GREATEST(rp, lp) AS p, {", ".join(f"CASE WHEN rp >= lp THEN r{n} ELSE l{n} END AS {n}" for n in "vfay")} FROM e)
SELECT clip_id, frame_idx, round(p, 5) AS proximity, round(exp(-15 * v * v), 5) AS stationarity, round(f / (v + f + 1e-4), 5) AS finger_ratio,
  round(tanh(10 * a), 5) AS energy, round(1 / (1 + exp(-15 * (y + 0.15))), 5) AS elevation, round(tanh(f / 0.10), 5) AS flexion FROM c""")
def _(s, d):
    f = P.spelling_signature(P.with_motion(I.bodies(s, d)))
    return f.select("clip_id", "frame_idx", *[F.round(c, 5).alias(c) for c in f.columns[2:]])


@Q.add("a56_keypoint_activity", f"""{MOV},
e AS (SELECT clip_id, frame_idx, kp, vx*vx + vy*vy + vz*vz + 0.1 * (ax*ax + ay*ay + az*az) AS e FROM mv),
n AS (SELECT *, round(0.6 * LEAST(1.0, e / GREATEST(1e-5, max(e) OVER (PARTITION BY clip_id))), 9) + CASE WHEN kp IN (48, 0, 8, 21, 29, 42, 43) THEN 10 ELSE 0 END AS s FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_idx ORDER BY s DESC, kp) AS rn FROM n)
SELECT clip_id, frame_idx, list(kp ORDER BY kp) AS kept FROM r WHERE rn <= 30 GROUP BY clip_id, frame_idx""")
def _(s, d):
    return P.active_keypoints(P.with_motion(I.bodies(s, d)))


@Q.add("w40_perspective_pitch_fix", f"""{BL},
g AS (SELECT clip_id, atan2(avg(k[49].z - (k[43].z + k[44].z) * 0.5), avg(k[49].y - (k[43].y + k[44].y) * 0.5) + 1e-6) AS t FROM b GROUP BY clip_id)
SELECT o.clip_id, o.frame_idx, CAST(o.kp AS INTEGER) AS kp, round(degrees(t), 6) AS pitch_degrees, round(o.x, 6) AS x,
  round(cos(t) * o.y + sin(t) * o.z, 6) AS y, round(cos(t) * o.z - sin(t) * o.y, 6) AS z FROM body o JOIN g ON g.clip_id = o.clip_id""")
def _(s, d):
    return points(r6(P.pitch_fix(I.bodies(s, d)), "pitch_degrees"), "pitch_degrees")


@Q.add("t12_shoulder_normalize", f"""{BL},
p AS (SELECT clip_id, frame_idx, {", ".join(f"(k[43].{c} + k[44].{c}) * 0.5 AS m{c}" for c in "xyz")}, GREATEST(1e-4, sqrt({d2('k[43]', 'k[44]')})) AS w FROM b)
SELECT o.clip_id, o.frame_idx, CAST(o.kp AS INTEGER) AS kp, {", ".join(f"round((o.{c} - m{c}) / w, 5) AS {c}" for c in "xyz")}
FROM body o JOIN p ON p.clip_id = o.clip_id AND p.frame_idx = o.frame_idx""")
def _(s, d):
    p = P.shoulder_normalize(I.bodies(s, d)).select("clip_id", "frame_idx", F.posexplode_outer("kps").alias("kp", "p"))
    return p.select("clip_id", "frame_idx", "kp", *[F.round(F.col(f"p.{c}"), 5).alias(c) for c in "xyz"])


@Q.add("f27_torso_cylinder", f"""{BL},
r AS (SELECT clip_id, frame_idx, k[22].x - (k[43].x + k[44].x) * 0.5 AS rx, k[22].y - (k[43].y + k[44].y) * 0.5 AS ry,
  k[22].z - (k[43].z + k[44].z) * 0.5 AS rz, atan2(k[44].z - k[43].z, k[44].x - k[43].x + 1e-6) AS tt FROM b),
q AS (SELECT *, atan2(rz, rx + 1e-6) - tt + pi() AS a FROM r)
SELECT clip_id, frame_idx, round(sqrt(rx * rx + rz * rz + 1e-6), 6) AS r, round(a - floor(a / (2 * pi())) * 2 * pi() - pi(), 6) AS theta,
  round(ry, 6) AS y_rel FROM q""")
def _(s, d):
    return r6(P.torso_cylinder(I.bodies(s, d), 21), "r", "theta", "y_rel")

"""Frame-stream rules on batch tables; the same machines run on live streams."""

from functools import partial

from pyspark.sql import functions as F

from tracklore.operators import poses as P
from tracklore.plans import inputs as I
from tracklore.plans.registry import QuerySet
from tracklore.session import table
from tracklore.streaming import guard as G
from tracklore.streaming import limits as L
from tracklore.streaming import machines as M
from tracklore.streaming import stateless as S
from tracklore.streaming.run import fold_batch

Q = QuerySet()
LET = f"""{I.EV}, lt AS (SELECT user_id, CAST(user_id AS VARCHAR) || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session, ts, event_id,
  chr(65 + k % 3) AS label, 0.65 + (event_id * 7 % 36) / 100.0::DOUBLE AS conf FROM act)"""
WS = "(PARTITION BY session ORDER BY ts, event_id)"


def letters(s, d):
    """Letter predictions of a learner's day, which is one session."""
    return I.events(s, d).select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("session"), "ts", "event_id",
        F.chr(65 + F.col("k") % 3).alias("label"), (0.65 + (F.col("event_id") * 7 % 36) / 100.0).alias("conf"), "k")


def framed(row):
    """Frames of a letter: held 14 frames, then a pause of 3 to 62."""
    run = F.sequence(F.lit(0), F.coalesce(17 + row["k"] * 7 % 60, F.lit(0)))
    return F.transform(run, lambda i: F.struct(i.alias("i"), F.when(i < 14, row["label"]).alias("letter"), row["conf"].alias("conf")))


def stabilized(s, d, machine):
    return fold_batch(letters(s, d), "session", ["ts", "event_id"], ["letter", "conf"], machine, framed)


def r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@Q.add("t1_letter_stabilizer")
def _(s, d):
    return stabilized(s, d, M.LetterStabilizer).drop("text")


@Q.add("t2_sentence_buffer")
def _(s, d):
    out = stabilized(s, d, M.LetterStabilizer)
    # an unfinished sentence ends with its session
    return out.where("event in ('END', 'OPEN')").select("session", "text")


@Q.add("f22_gesture_rule", f"""WITH {I.HANDS}, h AS (SELECT clip_id, frame_idx, list(x ORDER BY kp) AS x, list(y ORDER BY kp) AS y FROM hand_pts GROUP BY ALL),
f AS (SELECT *, abs(x[5] - x[18]) > abs(x[3] - x[18]) AS th, (y[9] < y[7])::INT + (y[13] < y[11])::INT + (y[17] < y[15])::INT + (y[21] < y[19])::INT AS n FROM h)
SELECT clip_id, frame_idx, n + th::INT AS fingers, CASE WHEN n + th::INT >= 5 THEN 'SPACE' WHEN n + th::INT = 1 AND th AND y[5] < y[4] THEN 'SUBMIT'
  WHEN n + th::INT = 0 THEN 'FIST' END AS gesture FROM f""")
def _(s, d):
    return S.gesture_rule(I.hands(s, d)).drop("kps")


def _fists(name, frames):
    @Q.add(name, f"""WITH {I.EV}, g AS (SELECT user_id AS clip_id, event_id AS frame_idx, event_type <> 'error' AS fist,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM act), o AS (SELECT *, COALESCE(max(CASE WHEN NOT fist THEN rn END) OVER
  (PARTITION BY clip_id ORDER BY rn ROWS UNBOUNDED PRECEDING), 0) AS opened FROM g)
SELECT clip_id, CAST(rn AS BIGINT) AS frame_idx FROM o WHERE fist AND (rn - opened) % {frames} = 0""")
    def _(s, d):
        from tracklore.operators import ordered

        ev = I.events(s, d).select(F.col("user_id").alias("clip_id"), "event_id", "ts",
                                   F.when(F.col("event_type") != "error", "FIST").alias("gesture"))
        day = F.to_date("ts")
        n = ordered.running(ev, ["clip_id"], ["event_id"], day, {"frame_idx": ("count", F.lit(1))})
        n = n.withColumn("frame_idx", F.col("frame_idx") - 1)
        return S.held_fists(n, ["clip_id"], F.to_date("ts"), frames).withColumn("frame_idx", F.col("frame_idx") + 1)


_fists("t3_control_gestures", 4)
_fists("t3_control_gestures_20", 20)


@Q.add("t5_majority_vote", f"""WITH {LET}, l AS (SELECT *, lag(label) OVER w AS l1, lag(label, 2) OVER w AS l2, lag(conf) OVER w AS c1, lag(conf, 2) OVER w AS c2 FROM lt WINDOW w AS {WS}),
b AS (SELECT *, CASE WHEN label = l1 OR label = l2 THEN label WHEN l1 = l2 THEN l1 END AS voted FROM l)
SELECT session, event_id, voted, round((CASE WHEN label = voted THEN conf ELSE 0 END + CASE WHEN l1 = voted THEN c1 ELSE 0 END + CASE WHEN l2 = voted THEN c2 ELSE 0 END)
 / ((label = voted)::INT + COALESCE(l1 = voted, false)::INT + COALESCE(l2 = voted, false)::INT), 6) AS confidence FROM b WHERE voted IS NOT NULL""")
def _(s, d):
    v = S.majority_of_three(letters(s, d), "session", ["ts", "event_id"])
    return r6(v.where("voted is not null").select("session", "event_id", "voted", "confidence"), "confidence")


@Q.add("t5_gated_majority", f"""WITH {LET}, n AS (SELECT *, row_number() OVER {WS} AS rn FROM lt),
w AS (SELECT *, COALESCE(max(CASE WHEN conf <= 0.8 THEN rn END) OVER (PARTITION BY session ORDER BY rn ROWS UNBOUNDED PRECEDING), 0) AS weak FROM n)
SELECT session, event_id, CASE WHEN conf > 0.8 AND (SELECT count(*) FROM n m WHERE m.session = w.session AND m.rn <= w.rn AND m.rn > w.rn - 5 AND m.rn > weak AND m.label = w.label) > 2
  THEN label END AS accepted FROM w""")
def _(s, d):
    return S.gated_majority(letters(s, d), "session", ["ts", "event_id"]).select("session", "event_id", "accepted")


@Q.add("t6_word_builder", f"""WITH {LET}, g AS (SELECT *, lag(ts) OVER w AS pt, lag(label) OVER w AS pl FROM lt WINDOW w AS {WS}),
n AS (SELECT *, (pt IS NULL OR epoch_us(ts) - epoch_us(pt) >= 7200000000) AS nw FROM g), k AS (SELECT *, sum(nw::INT) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS word_no FROM n)
SELECT session, CAST(word_no AS BIGINT) AS word_no, string_agg(lower(label), '' ORDER BY ts, event_id) AS word FROM k WHERE nw OR pl <> label GROUP BY session, word_no""")
def _(s, d):
    return S.words_by_pause(letters(s, d), "session", "ts", ["ts", "event_id"], 7200)


@Q.add("t7_one_euro_filter", f"""WITH RECURSIVE {I.TRIPLES}, f(clip_id, frame_idx, x, dx) AS (
  SELECT clip_id, frame_idx, x, 0.0::DOUBLE FROM triples WHERE frame_idx = 0 UNION ALL
  SELECT clip_id, frame_idx, a * v + (1 - a) * px, e FROM (SELECT *, 1 / (1 + 30 / (2 * pi() * (1 + 10 * abs(e)) + 1e-6)) AS a FROM (
    SELECT t.clip_id, t.frame_idx, t.x AS v, f.x AS px, (1 / (1 + 30 / (2 * pi() + 1e-6))) * (t.x - f.x) * 30 + (1 - 1 / (1 + 30 / (2 * pi() + 1e-6))) * f.dx AS e
    FROM f JOIN triples t ON t.clip_id = f.clip_id AND t.frame_idx = f.frame_idx + 1)))
SELECT clip_id, CAST(frame_idx AS INTEGER) AS frame_idx, round(x, 6) AS x FROM f""")
def _(s, d):
    out = G.one_euro(I.triples(s, d), "x", "y", "z")
    return r6(out.select("clip_id", "frame_idx", "x"), "x")


@Q.add("t8_variable_dt_step", f"""WITH {I.TRIPLES}, t AS (SELECT *, frame_idx * frame_idx * 0.004::DOUBLE AS ts FROM triples),
g AS (SELECT *, ts - lag(ts) OVER w AS g, x - lag(x) OVER w AS d, sqrt(x*x+y*y+z*z) > 1e-4 AND lag(sqrt(x*x+y*y+z*z)) OVER w > 1e-4 AS ok FROM t WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)),
v AS (SELECT *, CASE WHEN g IS NULL OR g <= 0 OR g > 0.5 THEN 1 / 30.0::DOUBLE ELSE g END + 1e-5 AS dt FROM g),
u AS (SELECT *, CASE WHEN ok THEN d / dt ELSE 0 END AS vx FROM v)
SELECT clip_id, CAST(frame_idx AS INTEGER) AS frame_idx, round(vx, 4) AS vx,
  round(CASE WHEN ok THEN (vx - lag(vx) OVER (PARTITION BY clip_id ORDER BY frame_idx)) / dt ELSE 0 END, 3) AS ax FROM u""")
def _(s, d):
    f = I.triples(s, d).withColumn("ts", F.col("frame_idx") * F.col("frame_idx") * 0.004)
    v = S.variable_step(f, "ts")
    return v.select("clip_id", "frame_idx", F.round("vx", 4).alias("vx"), F.round("ax", 3).alias("ax"))


def flat(s, d):
    return I.bodies(s, d).select("clip_id", "frame_idx", F.flatten(F.transform(
        "kps", lambda p: F.array(p["x"], p["y"], p["z"]))).alias("flat"))


@Q.add("t9_hand_swap_repair")
def _(s, d):
    f = flat(s, d).select("clip_id", F.col("frame_idx").cast("int").alias("frame_idx"), F.slice("flat", 1, 3).alias("left"), F.slice("flat", 64, 3).alias("right"))
    pick = lambda a, b: F.when(F.col("swapped"), F.col(b)[0]).otherwise(F.col(a)[0])
    return G.orientation(f).select("clip_id", "frame_idx", "swapped", pick("left", "right").alias("left_x"), pick("right", "left").alias("right_x"))


@Q.add("t10_dominance_mirror", f"""WITH {I.BODIES}, v AS (SELECT clip_id, frame_idx, kp, sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2 + (z - lag(z) OVER w)**2) AS sp
  FROM body WHERE kp IN (0, 21) WINDOW w AS (PARTITION BY clip_id, kp ORDER BY frame_idx)),
p AS (SELECT clip_id, frame_idx, COALESCE(max(sp) FILTER (WHERE kp = 0), 0) AS l, COALESCE(max(sp) FILTER (WHERE kp = 21), 0) AS r FROM v GROUP BY ALL),
s AS (SELECT *, sum(l) OVER w AS sl, sum(r) OVER w AS sr, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT clip_id, frame_idx, n >= 10 AND sl / (sl + sr + 1e-6) > 0.52 AS left_dominant FROM s""")
def _(s, d):
    m = P.with_motion(I.bodies(s, d)).select("clip_id", "frame_idx", P.length(P.pt(0, "vel")).alias("l"), P.length(P.pt(21, "vel")).alias("r"))
    # the vectors have no clearly dominant hand: a lower share splits them
    return G.dominance(m, "l", "r", 0.52).select("clip_id", "frame_idx", "left_dominant")


@Q.add("t11_backchannel_gate", f"""WITH {I.TRIPLES}, a AS (SELECT *, z > 0.05 OR abs(z) > 0.15 AS act FROM triples),
l AS (SELECT *, COALESCE(max(CASE WHEN act THEN frame_idx END) OVER (PARTITION BY clip_id ORDER BY frame_idx), -1) AS la FROM a),
h AS (SELECT o.clip_id, o.frame_idx, any_value(o.act) AS act, list(p.x ORDER BY p.frame_idx) AS xs FROM l o JOIN l p
  ON p.clip_id = o.clip_id AND p.frame_idx <= o.frame_idx AND p.frame_idx > o.la AND p.frame_idx > o.frame_idx - 15 GROUP BY ALL)
SELECT t.clip_id, CAST(t.frame_idx AS INTEGER) AS frame_idx, COALESCE(len(xs) >= 8 AND list_stddev_pop(xs) > 0.05 AND
  len(list_filter(generate_series(2, len(xs)), lambda i: sign(xs[i]) <> sign(xs[i - 1]))) BETWEEN 1 AND 4, false) AS nodding
FROM l t LEFT JOIN h ON h.clip_id = t.clip_id AND h.frame_idx = t.frame_idx""")
def _(s, d):
    t = I.triples(s, d).withColumn("energy", F.abs("z"))
    return G.nodding(t, "x", "z", "energy").select("clip_id", F.col("frame_idx").cast("int").alias("frame_idx"), "nodding")


class Sentences(M.LetterStabilizer):
    """The sentences of a session with their number, the open one included."""

    SCHEMA = "number int, text string"

    def __init__(self) -> None:
        super().__init__()
        self.number = 0

    def _only(self, events: list[tuple]) -> list[tuple]:
        out = []
        for event, _, text in events:
            if event in ("END", "OPEN") and text:
                self.number += 1
                out.append((self.number, text))
        return out

    def run(self, row, n: int) -> list[tuple]:
        return self._only(super().run(row, n))

    def finish(self) -> list[tuple]:
        return self._only(super().finish())


@Q.add("t4_letters_to_sentence")
def _(s, d):
    """Stabilized letters to sentences, corrected against part names, punctuated."""
    from tracklore.functions import text as X
    from tracklore.operators import corpus as C
    from tracklore.operators import spelling as SP

    said = stabilized(s, d, Sentences)
    tokens = said.select(F.concat_ws("#", "session", "number").alias("sentence_id"), F.posexplode_outer(X.tokens(F.lower("text"))).alias("pos", "word")).where("word is not null")
    part = table(s, d, "part").select(F.split("p_name", " ").alias("w"))
    uni = C.explode_tokens(part, F.col("w")).groupBy(F.col("token").alias("word")).agg(F.count(F.lit(1)).alias("freq"))
    bi = part.groupBy(F.get("w", F.lit(0)).alias("w1"), F.get("w", F.lit(1)).alias("w2")).agg(F.count(F.lit(1)).alias("freq"))
    fixed = SP.correct_phrases(tokens, uni, bi, "sentence_id")
    name = F.split("sentence_id", "#")
    return fixed.select(name[0].alias("session"), name[1].cast("int").alias("number"), X.sentence_case("words", F.array(F.lit("anna"))).alias("sentence"))


def chained(s, d):
    """Events of the letters' frames; a purchase submits, an error takes back, a signup closes the word, each 15 frames after its letter."""
    from tracklore.streaming import chain

    kind = F.when(F.col("event_type") == "purchase", "SUBMIT").when(F.col("event_type") == "error", "BACKSPACE").when(F.col("event_type") == "signup", "SPACE")

    def frames(row):
        return F.transform(framed(row), lambda f: F.struct(
            f["i"].alias("i"), F.when(f["i"] == 15, row["kind"]).alias("control"), f["letter"].alias("letter"), f["conf"].alias("conf")))

    given = letters(s, d).join(I.events(s, d).select("event_id", kind.alias("kind")), "event_id")
    return chain.events(given, "session", ["ts", "event_id"], frames)


def part_words(s, d):
    from tracklore.operators import corpus as C

    part = table(s, d, "part").select("p_type", F.split("p_name", " ").alias("w"))
    uni = C.explode_tokens(part, F.col("w")).groupBy(F.col("token").alias("word")).agg(F.count(F.lit(1)).alias("freq"))
    bi = part.groupBy(F.get("w", F.lit(0)).alias("w1"), F.get("w", F.lit(1)).alias("w2")).agg(F.count(F.lit(1)).alias("freq"))
    return uni, bi


@Q.add("t4_suggestions")
def _(s, d):
    """Every letter with the open sentence and the three commonest words that begin like the open word."""
    from tracklore.streaming import chain

    return chain.suggestions(chained(s, d), "session", part_words(s, d)[0])


@Q.add("t4_frame_chain")
def _(s, d):
    """Sentences of all sessions, corrected against part names, with the names of a session protected, and translated."""
    from tracklore.streaming import chain

    uni, bi = part_words(s, d)
    said = chained(s, d)
    lexicon = letters(s, d).groupBy("session").agg(F.array(F.lower(F.repeat(F.min("label"), F.lit(2))), F.lit("anna")).alias("names"))
    words = uni.select("word", F.concat(F.lit("v"), "word").alias("translation"))
    phrases = table(s, d, "part").select(F.lower("p_name").alias("phrase")).distinct().withColumn("translation", F.concat(F.lit("{sp} "), "phrase"))
    return chain.sentences(said, "session", uni, bi, lexicon, words, phrases)


@Q.add("t13_stream_guard")
def _(s, d):
    b = flat(s, d).withColumn("t", F.col("frame_idx") / 30.0)
    return G.guarded(fold_batch(b, "clip_id", ["frame_idx"], ["frame_idx", "t", "flat"], M.Steady))


@Q.add("t14_adaptive_chunk")
def _(s, d):
    f = I.frames(s, d).withColumn("pause", F.abs("x") < 0.02)
    return fold_batch(f, "clip_id", ["frame_idx"], ["frame_idx", "pause"], M.AdaptiveChunk)


@Q.add("t15_sliding_ctc_commit")
def _(s, d):
    e = I.events(s, d).select(F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("session"),
                              "ts", "event_id", (F.col("k") % 4).alias("token"), "k")

    def frames(row):
        return F.transform(F.coalesce(F.sequence(F.lit(0), row["k"]), F.array(F.lit(None).cast("int"))), lambda i: F.struct(
            i.alias("i"), F.when(i < 3, row["token"]).otherwise(0).alias("token")))

    return fold_batch(e, "session", ["ts", "event_id"], ["i", "token"], M.SlidingCommit, frames)


@Q.add("t16_j_z_tracker")
def _(s, d):
    f = I.triples(s, d)
    w = f.select("clip_id", "frame_idx", F.col("x").alias("ix"), F.col("y").alias("iy"), F.col("y").alias("px"), F.col("z").alias("py"),
                 F.when(F.col("clip_id") % 2 == 0, "I").otherwise("X").alias("shape"), F.lit(0.9).alias("conf"))
    return fold_batch(w, "clip_id", ["frame_idx"], ["frame_idx", "ix", "iy", "px", "py", "shape", "conf"],
                      partial(M.StrokeTracker, 0.2))


REQ = """rq AS (SELECT event_id, user_id % 40 AS ip, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS rn
  FROM events WHERE event_type IN ('signup', 'error', 'click'))"""


REQ_HOT = REQ.replace("user_id % 40", "CASE WHEN user_id % 3 < 2 THEN 0 ELSE user_id % 40 END")
LIMITED = """WITH RECURSIVE {req}, f(ip, rn, event_id, n, til, allowed, retry) AS (
  SELECT ip, rn, event_id, 1, t + {seconds}.0::DOUBLE, true, 0 FROM rq WHERE rn = 1 UNION ALL
  SELECT rq.ip, rq.rn, rq.event_id, CASE WHEN t > til THEN 1 WHEN n >= 5 THEN n ELSE n + 1 END, CASE WHEN t > til THEN t + {seconds}.0::DOUBLE ELSE til END,
    t > til OR n < 5, CASE WHEN t > til OR n < 5 THEN 0 ELSE CAST(trunc(til - t) AS INTEGER) END
  FROM f JOIN rq ON rq.ip = f.ip AND rq.rn = f.rn + 1)
SELECT ip, event_id, allowed, retry AS retry_seconds FROM f"""


def requests(s, d, ip):
    return I.events(s, d).where(F.col("event_type").isin("signup", "error", "click")).select(
        ip.alias("ip"), "ts", "event_id", (F.unix_micros("ts") / 1e6).alias("t"))


@Q.add("t17_rate_limit", LIMITED.format(req=REQ, seconds=43200))
def _(s, d):
    """Addresses that are sparse in time, under a window of half a day."""
    return L.rate_limit(requests(s, d, F.col("user_id") % 40), "ip", ["ts", "event_id"], "event_id", "t", seconds=43200.0)


@Q.add("t17_rate_limit_hot_address", LIMITED.format(req=REQ_HOT, seconds=900))
def _(s, d):
    """Five requests in 15 minutes; one address sends most of them."""
    ip = F.when(F.col("user_id") % 3 < 2, F.lit(0)).otherwise(F.col("user_id") % 40)
    return L.rate_limit(requests(s, d, ip), "ip", ["ts", "event_id"], "event_id", "t")


@Q.add("t18_revocation_ttl", f"""WITH {I.EV}, r AS (SELECT k AS token, ts AS mt, ts + INTERVAL 2 DAY AS expires_at FROM act WHERE event_type = 'error'),
c AS (SELECT event_id AS check_id, k AS token, ts AS mt FROM act WHERE event_type = 'view')
SELECT check_id, token, COALESCE((SELECT arg_max(expires_at, r.mt) FROM r WHERE r.token = c.token AND r.mt <= c.mt) >= mt, false) AS is_revoked FROM c""")
def _(s, d):
    ev = I.events(s, d)
    r = ev.where("event_type = 'error'").select(F.col("k").alias("token"), F.col("ts").alias("revoked_at"),
                                                (F.col("ts") + F.expr("interval 2 day")).alias("expires_at"))
    c = ev.where("event_type = 'view'").select(F.col("event_id").alias("check_id"), F.col("k").alias("token"), F.col("ts").alias("checked_at"))
    return S.revoked(c, r)


@Q.add("t19_cache_ttl", f"""WITH {I.EV}, e AS (SELECT k AS "key", CAST(event_id AS VARCHAR) AS payload, ts, ts + INTERVAL 12 HOUR AS expires_at FROM act
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) = 1)
SELECT "key", payload FROM e, today WHERE expires_at > now""")
def _(s, d):
    ev = I.events(s, d)
    e = ev.select(F.col("k").alias("key"), F.col("event_id").cast("string").alias("payload"), F.col("ts").alias("created_at"),
                  (F.col("ts") + F.expr("interval 12 hour")).alias("expires_at"))
    return S.cache_live(e, I.now(ev), "key").drop("expires_at")


@Q.add("t20_latest_frame_wins", f"""WITH {LET} SELECT session, arg_max(label, (ts, event_id)) AS label, count(*) AS offered FROM lt GROUP BY session""")
def _(s, d):
    return S.latest_frames(letters(s, d), "session", ["ts", "event_id"], "label")


def _recent(name, n):
    @Q.add(name, f"""SELECT user_id, event_id, CAST(rn AS INTEGER) AS age FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
FROM events) WHERE rn <= {n}""")
    def _(s, d):
        return S.recent_frames(I.events(s, d).select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], n).drop("ts")


_recent("t21_recent_frames", 20)
_recent("t21_recent_frames_150", 150)


@Q.add("t22_occlusion_fill", f"""WITH RECURSIVE {I.TRIPLES}, f(clip_id, frame_idx, v, occluded) AS (
  SELECT clip_id, frame_idx, z, abs(x) + abs(y) < 0.12 FROM triples WHERE frame_idx = 0 UNION ALL
  SELECT t.clip_id, t.frame_idx, CASE WHEN abs(t.x) + abs(t.y) < 0.12 THEN f.v * 0.95::DOUBLE ELSE t.z END, abs(t.x) + abs(t.y) < 0.12
  FROM f JOIN triples t ON t.clip_id = f.clip_id AND t.frame_idx = f.frame_idx + 1)
SELECT clip_id, CAST(frame_idx AS INTEGER) AS frame_idx, round(v, 6) AS value, occluded FROM f""")
def _(s, d):
    t = I.triples(s, d).withColumn("near", F.abs("x") + F.abs("y"))
    out = G.held(t, "near", "z").select("clip_id", F.col("frame_idx").cast("int").alias("frame_idx"), "value", "occluded")
    return r6(out, "value")

"""Stream rules that built-in windows, joins and filters express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklore.functions import text as X
from tracklore.operators import ordered


def majority_of_three(rows: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Label held by more than half of the last three frames, with its mean confidence."""
    w = Window.partitionBy(session).orderBy(*order)
    l = [F.col("label"), F.lag("label").over(w), F.lag("label", 2).over(w)]
    c = [F.col("conf"), F.lag("conf").over(w), F.lag("conf", 2).over(w)]
    j = rows.select("*", *[x.alias(f"__l{i}") for i, x in enumerate(l)], *[x.alias(f"__c{i}") for i, x in enumerate(c)])
    a, b, d = (F.col(f"__l{i}") for i in range(3))
    best = F.when((a == b) | (a == d), a).when(b == d, b)
    hits = [F.when(F.col(f"__l{i}") == F.col("voted"), F.col(f"__c{i}")) for i in range(3)]
    total = sum((F.coalesce(h, F.lit(0.0)) for h in hits[1:]), F.coalesce(hits[0], F.lit(0.0)))
    n = sum((h.isNotNull().cast("int") for h in hits[1:]), hits[0].isNotNull().cast("int"))
    j = j.withColumn("voted", best).withColumn("confidence", total / n)
    return j.drop(*[f"__{k}{i}" for k in "lc" for i in range(3)])


def gated_majority(rows: DataFrame, session: str, order: list[str], size: int = 5, gate: float = 0.80) -> DataFrame:
    """Accept a label seen in more than half of the buffer; a weak frame empties it."""
    w = Window.partitionBy(session).orderBy(*order)
    seq = rows.withColumn("__n", F.row_number().over(w))
    weak = F.last(F.when(F.col("conf") <= gate, F.col("__n")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0))
    seq = seq.withColumn("__weak", F.coalesce(weak, F.lit(0)))
    recent = [F.when((F.lag("__n", i).over(w) if i else F.col("__n")) > F.col("__weak"),
                     F.lag("label", i).over(w) if i else F.col("label")) for i in range(size)]
    seq = seq.withColumn("__r", F.array_compact(F.array(*recent)))
    votes = F.size(F.filter("__r", lambda x: x == F.col("label")))
    ok = (F.col("conf") > gate) & (votes > size // 2)
    return seq.withColumn("accepted", F.when(ok, F.col("label"))).drop("__n", "__weak", "__r")


def words_by_pause(letters: DataFrame, session: str, ts: str, order: list[str], pause_seconds: float) -> DataFrame:
    """Letters of confident frames joined to words; a pause starts the next word and
    an immediate repeat is not added again."""
    w = Window.partitionBy(session).orderBy(*order)
    gap = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))
    new = gap.isNull() | (gap >= pause_seconds * 1e6)
    s = letters.withColumn("__new", new).withColumn("__word", F.sum(F.col("__new").cast("int")).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    repeat = ~F.col("__new") & (F.lag("label").over(w) == F.col("label"))
    kept = s.withColumn("__rep", repeat).where("not __rep")
    return kept.groupBy(session, F.col("__word").alias("word_no")).agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct(*order, F.lower("label").alias("l")))), lambda x: x["l"]), "").alias("word"))


def gesture_rule(hands: DataFrame) -> DataFrame:
    """Extended fingers of a 21-joint hand: five is SPACE, thumb up is SUBMIT."""
    y = lambda i: F.get("kps", F.lit(i))["y"]
    x = lambda i: F.get("kps", F.lit(i))["x"]
    thumb = F.abs(x(4) - x(17)) > F.abs(x(2) - x(17))
    fingers = sum(((y(t) < y(t - 2)).cast("int") for t in (12, 16, 20)), (y(8) < y(6)).cast("int")) + thumb.cast("int")
    h = hands.withColumn("fingers", fingers).withColumn("__up", thumb & (y(4) < y(3)))
    return h.withColumn("gesture", F.when(F.col("fingers") >= 5, "SPACE").when(
        (F.col("fingers") == 1) & F.col("__up"), "SUBMIT").when(F.col("fingers") == 0, "FIST")).drop("__up")


def held_fists(gestures: DataFrame, keys: list[str], chunk: Column, frames: int = 20) -> DataFrame:
    """BACKSPACE on every ``frames``-th frame of an unbroken fist."""
    r = ordered.running(gestures, keys, ["frame_idx"], chunk, {
        "__open": ("last", F.when(F.coalesce(F.col("gesture"), F.lit("")) != "FIST", F.col("frame_idx")))})
    held = F.col("frame_idx") - F.coalesce("__open", F.lit(-1))
    return r.where((F.col("gesture") == "FIST") & (held % frames == 0)).select(*keys, "frame_idx")


def variable_step(frames: DataFrame, ts: str) -> DataFrame:
    """Velocity and acceleration over real time gaps; odd gaps count as 1/30 s."""
    w = Window.partitionBy("clip_id", "kp").orderBy("frame_idx")
    gap = F.col(ts) - F.lag(ts).over(w)
    dt = F.when(gap.isNull() | (gap <= 0) | (gap > 0.5), 1 / 30.0).otherwise(gap) + 1e-5
    f = frames.withColumn("__dt", dt)
    n = lambda *c: F.sqrt(sum((x * x for x in c[1:]), c[0] * c[0]))
    prev = [F.lag(c).over(w) for c in "xyz"]
    ok = (n(*[F.col(c) for c in "xyz"]) > 1e-4) & (n(*prev) > 1e-4)
    f = f.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    for c in "xyz":
        f = f.withColumn(f"v{c}", F.when(F.col("__ok"), (F.col(c) - F.lag(c).over(w)) / F.col("__dt")).otherwise(0.0))
    for c in "xyz":
        f = f.withColumn(f"a{c}", F.when(F.col("__ok"), (F.col(f"v{c}") - F.lag(f"v{c}").over(w)) / F.col("__dt")).otherwise(0.0))
    return f.drop("__dt", "__ok")


def revoked(checks: DataFrame, revocations: DataFrame) -> DataFrame:
    """Is a token revoked at the time of a check?  The newest revocation before the
    check counts until its expiry.

    Each check looks up its newest revocation by position, through one ordered pass
    over both sides of a token.
    """
    r = revocations.select("token", F.col("revoked_at").alias("at"), "expires_at", F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("check_id"))
    c = checks.select("token", F.col("checked_at").alias("at"), F.lit(None).cast("timestamp").alias("expires_at"), F.lit(1).alias("side"), "check_id")
    both = r.unionByName(c)
    done = ordered.running(both, ["token"], ["at", "side", "check_id"], F.to_date("at"), {"__e": ("last", F.col("expires_at"))})
    return done.where("side = 1").select("check_id", "token", F.coalesce(F.col("__e") >= F.col("at"), F.lit(False)).alias("is_revoked"))


def cache_live(entries: DataFrame, now: Column, key: str) -> DataFrame:
    """Newest entry per key, served while it has not expired."""
    newest = entries.groupBy(key).agg(F.max_by(F.struct("payload", "expires_at"), F.struct("created_at", "payload")).alias("e"))
    return newest.where(F.col("e.expires_at") > now).select(key, "e.payload", "e.expires_at")


def latest_frames(rows: DataFrame, session: str, order: list[str], value: str) -> DataFrame:
    """Of unprocessed frames only the newest per session."""
    return rows.groupBy(session).agg(F.max_by(value, F.struct(*order)).alias(value), F.count(F.lit(1)).alias("offered"))


def recent_frames(rows: DataFrame, session: str, order: list[str], n: int = 150, since: Column | None = None) -> DataFrame:
    """The last n frames per session, optionally only those after a time."""
    w = Window.partitionBy(session).orderBy(*[F.desc(o) for o in order])
    src = rows if since is None else rows.where(since)
    return src.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def request_ip(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ip", X.client_ip("forwarded", "real", "remote"))

"""Learner analytics: leaderboards, progress, streaks and review schedules.

Inputs follow the application tables: activities (user_id, ts, points),
attempts (user_id, lesson_id, completion, ts, event_id), reviews (user_id, item,
quality, ts, event_id).  All metrics are for every learner at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklore.operators import ordered
from tracklore.session import written

DAILY_GOAL = 5
FIRST_EASE, LOWEST_EASE = 2.5, 1.3
LESSON_XP, REVIEW_XP = 10, 5
MAX_INT = 2147483647
# an interval grows by 1.3 or more per success, so it passes the int limit and
# stays there before this many successes in a row
SATURATED = 96
# rows of a dimension that travel together as one array
CHUNK = 256


def chunked(rows: DataFrame, dim: DataFrame, *cols: str) -> DataFrame:
    """Each row with each chunk ``__c`` (an array of structs) of a dimension of any size.

    The dimension is dealt into chunks of about ``CHUNK`` rows by hash and met by an equi-join on the chunk number, which
    Spark broadcasts or shuffles by the chunks' size; only the number of chunks is read ahead.
    """
    n = F.greatest(F.lit(1), F.ceil(dim.agg(F.count(F.lit(1))).scalar() / CHUNK)).cast("int")
    packed = dim.select(*cols, F.pmod(F.xxhash64(*cols), n).cast("int").alias("__k"))
    packed = packed.groupBy("__k").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("__c"))
    return rows.withColumn("__k", F.explode(F.sequence(F.lit(0), n - 1))).join(packed, "__k").drop("__k")


def grid(users: DataFrame, dim: DataFrame, *cols: str) -> DataFrame:
    """Every learner with every row of a dimension: the shape the reports print."""
    return chunked(users, dim, *cols).withColumn("__d", F.explode("__c")).select(
        *users.columns, *[F.col(f"__d.{c}").alias(c) for c in cols]
    )


# -- leaderboard and XP ---------------------------------------------------------


def total_xp(activities: DataFrame) -> DataFrame:
    return activities.groupBy("user_id").agg(F.sum("points").cast("bigint").alias("total_xp"))


def top_n(xp: DataFrame, n: int = 10) -> DataFrame:
    best = xp.orderBy(F.desc("total_xp"), "user_id").limit(n)
    # n rows are left, so the window below is bounded
    w = Window.orderBy(F.desc("total_xp"), "user_id")
    return best.withColumn("rank", F.row_number().over(w).cast("bigint"))


def user_rank(xp: DataFrame) -> DataFrame:
    return ordered.competition_rank(xp, "total_xp").select("user_id", "total_xp", "rank")


def weekly_xp(activities: DataFrame, today: Column) -> DataFrame:
    """Seven calendar days ending today, days without activity at zero."""
    start = F.date_sub(today, 6)
    sums = (
        activities.where(F.col("ts") >= start.cast("timestamp"))  # on the column itself, so that the scan can skip
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(F.sum("points").cast("bigint").alias("s"))
    )
    days = activities.select("user_id").distinct().withColumn(
        "day", F.explode(F.sequence(start, today))
    )
    return days.join(sums, ["user_id", "day"], "left").select(
        "user_id", F.col("day").cast("string").alias("day"),
        F.coalesce("s", F.lit(0)).alias("xp"),
    )


# -- lesson progress ------------------------------------------------------------


def user_lessons(attempts: DataFrame) -> DataFrame:
    """Upsert as an aggregate: best completion, first completion time, attempts."""
    return attempts.groupBy("user_id", "lesson_id").agg(
        F.max("completion").alias("completion"),
        (F.max("completion") >= 100).alias("is_completed"),
        F.min(F.when(F.col("completion") >= 100, F.col("ts"))).alias("completed_at"),
        F.min("ts").alias("started_at"),
        F.count(F.lit(1)).alias("total_attempts"),
    )


def lesson_completions(attempts: DataFrame) -> DataFrame:
    """First completion per lesson: its XP and the review it opens for next day."""
    return (
        attempts.where(F.col("completion") >= 100)
        .groupBy("user_id", "lesson_id")
        .agg(F.min("ts").alias("completed_at"))
        .select(
            "user_id", "lesson_id",
            F.date_add(F.to_date("completed_at"), 1).cast("string").alias("due_day"),
            F.lit(LESSON_XP).cast("bigint").alias("xp"),
            F.lit(1).alias("interval"),
            F.lit(FIRST_EASE).alias("ease"),
        )
    )


def category_progress_completed(ul: DataFrame, lessons: DataFrame) -> DataFrame:
    done = (
        ul.where("is_completed").join(lessons, "lesson_id")
        .groupBy("user_id", "category_id").agg(F.count(F.lit(1)).alias("done"))
    )
    size = lessons.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))
    g = grid(ul.select("user_id").distinct(), size, "category_id", "n")
    return g.join(done, ["user_id", "category_id"], "left").select(
        "user_id", "category_id",
        (F.coalesce("done", F.lit(0)) / F.col("n")).alias("progress"),
    )


def _started_average(ul: DataFrame, lessons: DataFrame) -> DataFrame:
    return ul.join(lessons, "lesson_id").groupBy("user_id", "category_id").agg(
        (F.sum("completion") / F.count(F.lit(1))).alias("a"))


def category_average(ul: DataFrame, lessons: DataFrame) -> DataFrame:
    """Mean completion of the lessons a learner started, 0 where none is."""
    avg = _started_average(ul, lessons)
    g = grid(
        ul.select("user_id").distinct(), lessons.select("category_id").distinct(), "category_id"
    )
    return g.join(avg, ["user_id", "category_id"], "left").select(
        "user_id", "category_id", F.coalesce("a", F.lit(0.0)).alias("average")
    )


def lessons_completed(ul: DataFrame) -> DataFrame:
    return ul.groupBy("user_id").agg(F.count_if("is_completed").alias("lessons_completed"))


def daily_goal(ul: DataFrame, today: Column) -> DataFrame:
    n = F.count_if(F.col("is_completed") & (F.to_date("completed_at") == today))
    return ul.groupBy("user_id").agg(n.alias("completed_today")).select(
        "user_id", "completed_today", F.lit(DAILY_GOAL).alias("daily_goal"),
        F.least(F.lit(100.0), F.col("completed_today") / DAILY_GOAL * 100).alias("percent"),
    )


def first_missing(have: DataFrame, key: str, n: int = 1) -> DataFrame:
    """The first n numbers from 1 that have(key, number) leaves out, per key: key, position, number.

    The i-th number held has `number - i` missing ones below it, so the k-th missing number is k more than the count of
    held numbers with fewer than k missing below; no list of what is missing is ever made.
    """
    mine = Window.partitionBy(key).orderBy("number")
    below = have.select(key, "number").distinct().withColumn("__m", F.col("number") - F.row_number().over(mine))
    each = F.array(*[F.struct(F.lit(k).alias("position"), (k + F.count_if(F.col("__m") < k)).alias("number")) for k in range(1, n + 1)])
    return below.groupBy(key).agg(each.alias("__g")).select(key, F.inline("__g"))


def recommendation(ul: DataFrame, lessons: DataFrame) -> DataFrame:
    """Weakest category, then its first open lesson, then any open lesson, then
    the least completed one.

    Categories, lessons and lessons within a category are numbered. A category not begun averages 0, so only the first of
    those can be the weakest; the first open lesson is the first number that the completed lessons leave out. No row
    is made for what a learner hasn't touched.
    """
    ul, own = written(ul), written(lessons.select("lesson_id", "category_id").distinct())
    categories = ordered.positions(own.select("category_id").distinct(), [F.col("category_id")], "number")
    every = ordered.positions(own.select("lesson_id").distinct(), [F.col("lesson_id")], "number")
    inside = Window.partitionBy("category_id").orderBy("lesson_id")
    ranked = own.withColumn("number", F.row_number().over(inside))
    users = ul.select("user_id").distinct()

    begun = _started_average(ul, own)
    gap = first_missing(begun.join(categories, "category_id"), "user_id").select("user_id", "number")
    fresh = users.join(gap, "user_id", "left").withColumn("number", F.coalesce("number", F.lit(1))).join(categories, "number")
    weakest = begun.select("user_id", "category_id", F.col("a").alias("average")).unionByName(
        fresh.select("user_id", "category_id", F.lit(0.0).alias("average"))
    ).groupBy("user_id").agg(F.min(F.struct("average", "category_id")).alias("w")).select("user_id", "w.*")

    done = ul.where("is_completed").select("user_id", "lesson_id").distinct()
    there = done.join(ranked, "lesson_id").join(weakest.select("user_id", "category_id"), ["user_id", "category_id"], "left_semi")
    here = (
        weakest.join(first_missing(there, "user_id").drop("position"), "user_id", "left")
        .withColumn("number", F.coalesce("number", F.lit(1)))
        .join(ranked.select("category_id", "number", F.col("lesson_id").alias("here")), ["category_id", "number"], "left")
        .drop("number")
    )
    anywhere = (
        users.join(first_missing(done.join(every, "lesson_id"), "user_id").drop("position"), "user_id", "left")
        .withColumn("number", F.coalesce("number", F.lit(1)))
        .join(every, "number").select("user_id", F.col("lesson_id").alias("anywhere"))
    )
    least = ul.groupBy("user_id").agg(F.min(F.struct("completion", "lesson_id")).alias("least"))
    reason = (
        F.when(F.col("average") < 25, "You need to focus on this category!")
        .when(F.col("average") < 50, "Keep improving in this category.")
        .otherwise("Challenge yourself with the next category!")
    )
    return here.join(anywhere, "user_id", "left").join(least, "user_id").select(
        "user_id", "category_id", "average",
        F.coalesce("here", "anywhere", "least.lesson_id").alias("lesson_id"), reason.alias("reason"),
    )


def progress_message(ul: DataFrame, lessons: DataFrame) -> DataFrame:
    """Message bands over the mean completion of all lessons, unstarted ones at 0."""
    n = lessons.agg(F.count(F.lit(1))).scalar()
    avg = F.sum("completion") / 100 / n
    message = (
        F.when(F.col("average") < 0.25, "You're just getting started! Keep up the momentum.")
        .when(F.col("average") < 0.5, "Great progress! Continue with the next category.")
        .when(F.col("average") < 0.75,
              "You're doing amazing! Time to tackle more advanced lessons.")
        .otherwise("You've come a long way! Challenge yourself with expert-level content.")
    )
    return ul.groupBy("user_id").agg(avg.alias("average")).withColumn("message", message)


def lesson_overview(ul: DataFrame, lessons: DataFrame) -> DataFrame:
    """Every lesson with its category and the learner's completion, 0 if unstarted."""
    g = grid(ul.select("user_id").distinct(), lessons, "lesson_id", "category_id")
    return g.join(ul, ["user_id", "lesson_id"], "left").select(
        "user_id", "lesson_id", "category_id",
        (F.coalesce("completion", F.lit(0)) / 100).alias("completion"),
    )


def open_lessons(ul: DataFrame, lessons: DataFrame) -> DataFrame:
    g = grid(ul.select("user_id").distinct(), lessons, "lesson_id")
    return g.join(ul.where("is_completed"), ["user_id", "lesson_id"], "left_anti")


def fill_recommendations(ul: DataFrame, lessons: DataFrame, n: int = 3) -> DataFrame:
    """First n lessons a learner has not been shown yet: the first n numbers that the shown lessons leave out.

    A learner whose lessons are all unknown to `lessons` gets the first n of them.
    """
    every = ordered.positions(lessons.select("lesson_id").distinct(), [F.col("lesson_id")], "number")
    first = F.inline(F.array(*[F.struct(F.lit(k).alias("position"), F.lit(k).cast("bigint").alias("number")) for k in range(1, n + 1)]))
    gaps = first_missing(ul.join(every, "lesson_id"), "user_id", n)
    none = ul.select("user_id").distinct().join(gaps, "user_id", "left_anti").select("user_id", first)
    return gaps.unionByName(none).join(every, "number").select("user_id", "position", "lesson_id")


def achievements(users: DataFrame, badges: DataFrame, unlocked: DataFrame) -> DataFrame:
    g = grid(users, badges, "achievement_id")
    return g.join(unlocked, ["user_id", "achievement_id"], "left").select(
        "user_id", "achievement_id", F.col("unlocked_at").isNotNull().alias("is_unlocked"),
        F.date_format("unlocked_at", "yyyy-MM-dd HH:mm:ss").alias("unlocked_at"),
    )


def achievement_progress(users: DataFrame, badges: DataFrame, unlocked: DataFrame) -> DataFrame:
    """Unlocked badges of each learner and their share of all; only unlocked pairs are met, never learners x badges."""
    own = badges.select("achievement_id").distinct()
    got = unlocked.select("user_id", "achievement_id").distinct().join(own, "achievement_id").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("unlocked"))
    n = own.agg(F.count(F.lit(1))).scalar()
    out = users.select("user_id").distinct().join(got, "user_id", "left").withColumn("unlocked", F.coalesce("unlocked", F.lit(0)).cast("bigint"))
    return out.select("user_id", "unlocked", F.try_divide("unlocked", n).alias("progress"))


# -- spaced repetition ----------------------------------------------------------


def clamped_fold(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column,
    delta: Column, start: float, floor: float, name: str, count: str | None = None,
) -> DataFrame:
    """Final v of v := max(floor, v + delta) over each key's rows in order, and on
    request the number of rows.

    The fold equals S + max(start, floor - min prefix), which merges over chunks:
    windows stay inside a chunk and one (sum, lowest prefix) row per chunk moves on.
    """
    inside = Window.partitionBy(*keys, "__ch").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    upto = Window.partitionBy(*keys).orderBy("__ch").rowsBetween(Window.unboundedPreceding, -1)
    d = F.col("__d")
    per_chunk = (
        df.select(*keys, *order, chunk.alias("__ch"), delta.alias("__d"))
        .withColumn("__pre", F.sum(d).over(inside))
        .groupBy(*keys, "__ch")
        .agg(F.sum(d).alias("__s"), F.min("__pre").alias("__low"), F.count(F.lit(1)).alias("__n"))
        .withColumn("__low", F.col("__low") + F.coalesce(F.sum("__s").over(upto), F.lit(0)))
    )
    out = per_chunk.groupBy(*keys).agg(
        F.sum("__s").alias("__s"), F.min("__low").alias("__low"), F.sum("__n").alias("__n"))
    v = F.col("__s") + F.greatest(F.lit(start), F.lit(floor) - F.col("__low"))
    return out.select(*keys, v.alias(name), *([F.col("__n").alias(count)] if count else []))


def days_after(ts: str, days: str) -> Column:
    """Timestamp plus days; an interval past the calendar ends shortly before 9999."""
    room = F.datediff(F.lit("9999-01-01"), F.to_date(ts))
    whole = F.least(F.col(days), room).cast("bigint") * 86_400_000_000
    return F.timestamp_micros(F.unix_micros(ts) + whole)


def ease_step(q: Column) -> Column:
    return F.lit(0.1) - (5 - q) * (F.lit(0.08) + (5 - q) * F.lit(0.02))


def _last_stop(stop: Column, order: list[str]) -> Column:
    return F.max(F.when(stop, F.struct(*order))).alias("__stop")


def _tail(df: DataFrame, marks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of each key after its last stop."""
    return df.join(marks.select(*keys, "__stop"), keys).where(
        F.col("__stop").isNull() | (F.struct(*order) > F.col("__stop"))
    )


def _first_grades(rows: DataFrame, keys: list[str], order: list[str], grade: str) -> DataFrame:
    """The first SATURATED grades of each key, in order, as one short array."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return (
        rows.withColumn("__rn", F.row_number().over(w))
        .where(F.col("__rn") <= SATURATED)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("__rn", F.col(grade).alias("g")))).alias("__g"))
    )


def sm2_server(reviews: DataFrame, keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    """State after the last review: reset under quality 3, else 1, 3, ceil(i * ease).

    A failed review resets everything, so only reviews after the last failure
    matter; the interval saturates within the first SATURATED of them.
    """
    everything = reviews.groupBy(*keys).agg(
        _last_stop(F.col("quality") < 3, order),
        F.max("ts").alias("last_reviewed"),
        F.least(F.lit(100.0), 100 + 10 * F.sum("quality")).alias("retention"),
        (F.count_if(F.col("quality") >= 3) * REVIEW_XP).alias("xp"),
    )
    tail = _tail(reviews, everything, keys, order)
    ease = clamped_fold(
        tail, keys, order, chunk, ease_step(F.col("quality")), FIRST_EASE, LOWEST_EASE,
        "ease", "repetitions",
    )
    start = F.struct(
        F.lit(0).alias("n"), F.lit(1.0).alias("i"), F.lit(FIRST_EASE).alias("e")
    )

    def step(acc, s):
        e = F.greatest(F.lit(LOWEST_EASE), acc["e"] + F.lit(0.1)
                       - (5 - s["g"]) * (F.lit(0.08) + (5 - s["g"]) * F.lit(0.02)))
        n = acc["n"] + 1
        i = F.when(n == 1, F.lit(1.0)).when(n == 2, F.lit(3.0)).otherwise(
            F.least(F.lit(float(MAX_INT)), F.ceil(acc["i"] * e).cast("double"))
        )
        return F.struct(n.alias("n"), i.alias("i"), e.alias("e"))

    intervals = _first_grades(tail, keys, order, "quality").select(
        *keys, F.aggregate("__g", start, step)["i"].cast("int").alias("interval")
    )
    return (
        everything.join(ease, keys, "left").join(intervals, keys, "left")
        .select(
            *keys, "last_reviewed", "retention", "xp",
            F.coalesce("repetitions", F.lit(0)).alias("repetitions"),
            F.coalesce("interval", F.lit(1)).alias("interval"),
            F.coalesce("ease", F.lit(FIRST_EASE)).alias("ease"),
        )
        .withColumn("due_date", days_after("last_reviewed", "interval"))
    )


def grade(correct: Column, accuracy: Column) -> Column:
    return (
        F.when(~correct, 1).when(accuracy < 0.6, 2).when(accuracy < 0.8, 3)
        .when(accuracy < 0.95, 4).otherwise(5)
    )


def sm2_device(answers: DataFrame, keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    """Device variant: 1, 6, round(i * ease); the ease moves on every answer.

    The interval restarts at the last failure while the ease does not, so the
    ease up to that failure is one clamped fold and the rest a short one.
    """
    graded = answers.withColumn("g", grade(F.col("correct"), F.col("accuracy")))
    fold = lambda rows, name: clamped_fold(
        rows, keys, order, chunk, ease_step(F.col("g")), FIRST_EASE, LOWEST_EASE, name
    )
    totals = graded.groupBy(*keys).agg(
        _last_stop(F.col("g") < 3, order),
        F.count_if("correct").alias("correct_count"),
        F.count_if(~F.col("correct")).alias("incorrect_count"),
        F.max("ts").alias("last_reviewed"),
    )
    head = graded.join(totals.select(*keys, "__stop"), keys).where(
        F.struct(*order) <= F.col("__stop"))
    tail = _tail(graded, totals, keys, order)
    start = lambda e: F.struct(
        F.lit(0).alias("n"), F.lit(1.0).alias("i"), e.alias("e")
    )

    def step(acc, s):
        n = acc["n"]
        i = F.when(n == 0, F.lit(1.0)).when(n == 1, F.lit(6.0)).otherwise(
            F.least(F.lit(float(MAX_INT)), F.bround(acc["i"] * acc["e"], 0))
        )
        e = F.greatest(F.lit(LOWEST_EASE), acc["e"] + (
            F.lit(0.1) - (5 - s["g"]) * (F.lit(0.08) + (5 - s["g"]) * F.lit(0.02))))
        return F.struct((n + 1).alias("n"), i.alias("i"), e.alias("e"))

    intervals = (
        _first_grades(tail, keys, order, "g").join(fold(head, "__e0"), keys, "left")
        .select(*keys, F.aggregate(
            "__g", start(F.coalesce("__e0", F.lit(FIRST_EASE))), step
        )["i"].cast("int").alias("interval"))
    )
    reps = tail.groupBy(*keys).agg(F.count(F.lit(1)).alias("repetitions"))
    return (
        totals.join(fold(graded, "ease"), keys).join(reps, keys, "left")
        .join(intervals, keys, "left")
        .select(
            *keys, "correct_count", "incorrect_count", "last_reviewed", "ease",
            F.coalesce("repetitions", F.lit(0)).alias("repetitions"),
            F.coalesce("interval", F.lit(1)).alias("interval"),
        )
        .withColumn("next_review", days_after("last_reviewed", "interval"))
    )


def upcoming_reviews(srs: DataFrame, today: Column) -> DataFrame:
    d = F.to_date("due_date")
    return srs.groupBy("user_id").agg(
        F.count_if(d == today).alias("due_today"),
        F.count_if(d == F.date_add(today, 1)).alias("due_tomorrow"),
        F.count_if((d > F.date_add(today, 1)) & (d <= F.date_add(today, 7))).alias("due_this_week"),
        F.count_if(d < today).alias("overdue"),
    )


def review_progress(srs: DataFrame, today: Column, now: Column) -> DataFrame:
    """Share of due reviews; this page counts the week from today, tomorrow included."""
    d = F.to_date("due_date")
    parts = srs.groupBy("user_id").agg(
        F.count_if(F.col("due_date") <= now).alias("due"),
        F.count_if(d == F.date_add(today, 1)).alias("tomorrow"),
        F.count_if((d > today) & (d <= F.date_add(today, 7))).alias("week"),
    )
    total = F.col("due") + F.col("tomorrow") + F.col("week")
    return parts.withColumn(
        "progress", F.when(total > 0, F.col("due") / total).otherwise(0.0)
    )


def due_reviews(srs: DataFrame, lessons: DataFrame, now: Column) -> DataFrame:
    """Due reviews with their lesson, earliest first within a learner."""
    w = Window.partitionBy("user_id").orderBy("due_date", "lesson_id")
    return srs.where(F.col("due_date") <= now).join(lessons, "lesson_id", "left").select(
        "user_id", "lesson_id", "category_id", "repetitions",
        F.date_format("due_date", "yyyy-MM-dd HH:mm:ss").alias("due_date"),
        F.row_number().over(w).alias("position"),
    )


def review_queue(signs: DataFrame, now: Column, n: int = 10) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("next_review", "item")
    return (
        signs.where(F.col("next_review") <= now)
        .withColumn("position", F.row_number().over(w))
        .where(F.col("position") <= n)
        .select("user_id", "item", "position")
    )


def forgotten_signs(signs: DataFrame, now: Column) -> DataFrame:
    """Signs missed often or not seen for a month, the most missed first."""
    order = Window.partitionBy("user_id").orderBy(F.desc("incorrect_count"), "item")
    late = F.unix_micros(now) - F.unix_micros("last_reviewed") > F.lit(30 * 86_400_000_000)
    return signs.where(
        (F.col("incorrect_count") > F.col("correct_count") * 0.5) | late
    ).select("user_id", "item", "incorrect_count", "correct_count", F.row_number().over(order).alias("position"))


def weekly_report(signs: DataFrame) -> DataFrame:
    ratio = F.col("correct_count") / (F.col("correct_count") + F.col("incorrect_count") + 1)
    return signs.groupBy("user_id").agg(
        F.avg(ratio).alias("average_accuracy"),
        F.max_by("item", F.struct("incorrect_count", -F.col("item"))).alias("top_missed"),
    )


def daily_activity(answers: DataFrame, today: Column) -> DataFrame:
    """Minutes with activity and accuracy per learner and day of the last week."""
    return (
        answers.where(F.col("ts") >= F.date_sub(today, 6).cast("timestamp"))
        .groupBy("user_id", F.to_date("ts").cast("string").alias("day"))
        .agg(
            F.count_distinct(F.date_trunc("minute", "ts")).alias("minutes"),
            F.avg(F.col("correct").cast("double")).alias("accuracy"),
        )
    )


def calibration_level(answers: DataFrame, questions: int = 5) -> DataFrame:
    """Level from the first answers: 4 right is advanced (3), 2 intermediate (2)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.count_if("correct")
    return (
        answers.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= questions)
        .groupBy("user_id").agg(n.alias("right_answers"))
        .withColumn("level", F.when(F.col("right_answers") >= 4, 3)
                    .when(F.col("right_answers") >= 2, 2).otherwise(1))
    )


def account_duration(activities: DataFrame) -> DataFrame:
    span = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    return activities.groupBy("user_id").agg(
        F.round(span / F.lit(86_400_000_000.0), 2).alias("days"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_login"),
    )


# -- streaks, combos, counters --------------------------------------------------


def streaks(activities: DataFrame) -> DataFrame:
    """Current streak (as of the last active day) and longest one per learner."""
    days = activities.select("user_id", F.to_date("ts").alias("day")).distinct()
    # one row per calendar day is left, which bounds the window below
    w = Window.partitionBy("user_id").orderBy("day")
    island = F.date_sub(F.col("day"), F.row_number().over(w))
    runs = days.withColumn("island", island).groupBy("user_id", "island").agg(
        F.count(F.lit(1)).alias("length"), F.max("day").alias("last_day")
    )
    return runs.groupBy("user_id").agg(
        F.max_by("length", "last_day").alias("current_streak"),
        F.max("length").alias("longest_streak"),
        F.max("last_day").cast("string").alias("last_day"),
    )


def combos(answers: DataFrame, chunk: Column) -> DataFrame:
    """Consecutive right answers and their multiplier, min(3, 1 + combo / 2)."""
    order = ["ts", "event_id"]
    counted = ordered.running(
        answers.select("user_id", "event_id", "ts", "correct"), ["user_id"], order, chunk,
        {"n": ("count", F.lit(1))},
    )
    broken = ordered.running(
        counted, ["user_id"], order, chunk,
        {"b": ("max", F.when(~F.col("correct"), F.col("n")))},
    )
    combo = F.col("n") - F.coalesce("b", F.lit(0))
    return broken.select(
        "user_id", "event_id", combo.alias("combo"),
        F.least(F.lit(3.0), 1 + combo * 0.5).alias("multiplier"),
    )


def likes_views(actions: DataFrame, chunk: Column) -> DataFrame:
    """Likes with the floor at zero applied after every action, and views."""
    delta = (
        F.when(F.col("event_type").isin("click", "purchase"), 1.0)
        .when(F.col("event_type") == "error", -1.0)
        .otherwise(0.0)
    )
    likes = clamped_fold(actions, ["k"], ["ts", "event_id"], chunk, delta, 0.0, 0.0, "likes")
    views = actions.groupBy("k").agg(F.count_if(F.col("event_type") == "view").alias("views"))
    return views.join(likes, "k").select(
        F.col("k").alias("video_id"), F.col("likes").cast("bigint").alias("likes"), "views"
    )


def audit_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy(
        "event_type",
        F.when(F.col("value") > 100, "failure").otherwise("success").alias("status"),
        F.to_date("ts").cast("string").alias("day"),
    ).agg(F.count(F.lit(1)).alias("n"))


def distinct_categories(items: DataFrame, col: str) -> DataFrame:
    names = items.select(F.col(col).alias("category")).distinct()
    return ordered.positions(names, [F.col("category")], "position")

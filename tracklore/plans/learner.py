"""Learner queries over `events`, one row per learner action."""

from pyspark.sql import functions as F

from tracklore.operators import learner as L
from tracklore.plans import inputs as I
from tracklore.plans.registry import QuerySet
from tracklore.session import table

Q = QuerySet()
H = f"WITH {I.EV}"
UL = """ul AS (
  SELECT user_id, lesson_id, max(completion) AS completion, max(completion) >= 100 AS is_completed,
         min(CASE WHEN completion >= 100 THEN ts END) AS completed_at, min(ts) AS started_at,
         count(*) AS total_attempts
  FROM act GROUP BY user_id, lesson_id)"""
HU = f"{H}, {I.LESSON_SQL}, {UL}, users AS (SELECT DISTINCT user_id FROM act)"


def chunk():
    return F.to_date("ts")


def ul(s, d):
    return L.user_lessons(I.events(s, d))


XP = "xp AS (SELECT user_id, CAST(sum(points) AS BIGINT) AS total_xp FROM act GROUP BY user_id)"


@Q.add("a22_top_n_leaderboard", f"""{H}, {XP}
SELECT user_id, total_xp, row_number() OVER (ORDER BY total_xp DESC, user_id) AS rank
FROM xp ORDER BY total_xp DESC, user_id LIMIT 10""")
def _(s, d):
    return L.top_n(L.total_xp(I.events(s, d)))


@Q.add("o1_top_n_by_metric", """SELECT event_id, user_id, value FROM events
ORDER BY value DESC, event_id LIMIT 25""")
def _(s, d):
    ev = table(s, d, "events").select("event_id", "user_id", "value")
    return ev.orderBy(F.desc("value"), "event_id").limit(25)


@Q.add("a23_user_rank", f"""{H}, {XP}
SELECT user_id, total_xp, rank() OVER (ORDER BY total_xp DESC) AS rank FROM xp""")
def _(s, d):
    return L.user_rank(L.total_xp(I.events(s, d)))


@Q.add("a24_weekly_xp", f"""{H},
days AS (SELECT user_id, CAST(d - CAST(i AS INTEGER) AS DATE) AS day
  FROM (SELECT DISTINCT user_id FROM act), today, generate_series(0, 6) g(i))
SELECT days.user_id, CAST(days.day AS VARCHAR) AS day, CAST(COALESCE(sum(points), 0) AS BIGINT) AS xp
FROM days LEFT JOIN act ON act.user_id = days.user_id AND CAST(act.ts AS DATE) = days.day
GROUP BY days.user_id, days.day""")
def _(s, d):
    ev = I.events(s, d)
    return L.weekly_xp(ev, I.today(ev))


@Q.add("w36_max_progress_upsert", f"""{HU}
SELECT user_id, lesson_id, completion, is_completed, total_attempts,
       strftime(completed_at, '%Y-%m-%d %H:%M:%S') AS completed_at FROM ul""")
def _(s, d):
    return ul(s, d).select(
        "user_id", "lesson_id", "completion", "is_completed", "total_attempts",
        F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed_at"))


@Q.add("w37_complete_lesson_xp", f"""{HU}
SELECT user_id, lesson_id, CAST(CAST(completed_at AS DATE) + 1 AS VARCHAR) AS due_day,
       CAST(10 AS BIGINT) AS xp, 1 AS "interval", 2.5::DOUBLE AS ease
FROM ul WHERE is_completed""")
def _(s, d):
    return L.lesson_completions(I.events(s, d))


@Q.add("a25_category_progress_completed", f"""{HU},
size AS (SELECT category_id, count(*) AS n FROM lessons GROUP BY category_id),
done AS (SELECT user_id, category_id, count(*) AS c FROM ul JOIN lessons USING (lesson_id)
         WHERE is_completed GROUP BY user_id, category_id)
SELECT users.user_id, size.category_id, COALESCE(c, 0) / CAST(n AS DOUBLE) AS progress
FROM users CROSS JOIN size LEFT JOIN done
  ON done.user_id = users.user_id AND done.category_id = size.category_id""")
def _(s, d):
    return L.category_progress_completed(ul(s, d), I.lessons(I.events(s, d)))


AVG = """cavg AS (SELECT users.user_id, c.category_id, COALESCE(a, 0.0) AS average
  FROM users CROSS JOIN (SELECT DISTINCT category_id FROM lessons) c LEFT JOIN
    (SELECT user_id, category_id, CAST(sum(completion) AS DOUBLE) / count(*) AS a
     FROM ul JOIN lessons USING (lesson_id) GROUP BY user_id, category_id) x
  ON x.user_id = users.user_id AND x.category_id = c.category_id)"""


@Q.add("a26_category_progress_avg", f"""{HU}, {AVG}
SELECT user_id, category_id, round(average / 100, 6) AS progress FROM cavg""")
def _(s, d):
    a = L.category_average(ul(s, d), I.lessons(I.events(s, d)))
    return a.select("user_id", "category_id", F.round(F.col("average") / 100, 6).alias("progress"))


@Q.add("a27_lessons_completed", f"""{HU}
SELECT user_id, count(*) FILTER (WHERE is_completed) AS lessons_completed FROM ul GROUP BY user_id""")
def _(s, d):
    return L.lessons_completed(ul(s, d))


@Q.add("a27_daily_goal", f"""{HU},
c AS (SELECT user_id, count(*) FILTER (WHERE is_completed AND CAST(completed_at AS DATE) = d) AS n
      FROM ul, today GROUP BY user_id)
SELECT user_id, n AS completed_today, 5 AS daily_goal, LEAST(100.0, n / 5.0 * 100)::DOUBLE AS percent FROM c""")
def _(s, d):
    ev = I.events(s, d)
    return L.daily_goal(L.user_lessons(ev), I.today(ev))


@Q.add("a30_weakest_category_recommendation", f"""{HU}, {AVG},
w AS (SELECT * FROM cavg QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY average, category_id) = 1),
open AS (SELECT users.user_id, lessons.lesson_id, lessons.category_id FROM users CROSS JOIN lessons
  WHERE NOT EXISTS (SELECT 1 FROM ul WHERE ul.user_id = users.user_id
                    AND ul.lesson_id = lessons.lesson_id AND is_completed)),
worst AS (SELECT user_id, lesson_id FROM ul
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY completion, lesson_id) = 1)
SELECT w.user_id, w.category_id, w.average,
  COALESCE((SELECT min(lesson_id) FROM open o WHERE o.user_id = w.user_id AND o.category_id = w.category_id),
           (SELECT min(lesson_id) FROM open o WHERE o.user_id = w.user_id), worst.lesson_id) AS lesson_id,
  CASE WHEN w.average < 25 THEN 'You need to focus on this category!'
       WHEN w.average < 50 THEN 'Keep improving in this category.'
       ELSE 'Challenge yourself with the next category!' END AS reason
FROM w JOIN worst USING (user_id)""")
def _(s, d):
    return L.recommendation(ul(s, d), I.lessons(I.events(s, d)))


@Q.add("a31_progress_message", f"""{HU},
m AS (SELECT user_id, sum(completion) / 100.0::DOUBLE / (SELECT count(*) FROM lessons) AS average
      FROM ul GROUP BY user_id)
SELECT user_id, round(average, 6) AS average, CASE
  WHEN average < 0.25 THEN 'You''re just getting started! Keep up the momentum.'
  WHEN average < 0.5 THEN 'Great progress! Continue with the next category.'
  WHEN average < 0.75 THEN 'You''re doing amazing! Time to tackle more advanced lessons.'
  ELSE 'You''ve come a long way! Challenge yourself with expert-level content.' END AS message FROM m""")
def _(s, d):
    out = L.progress_message(ul(s, d), I.lessons(I.events(s, d)))
    return out.withColumn("average", F.round("average", 6))


@Q.add("j5_lesson_overview", f"""{HU}
SELECT users.user_id, lessons.lesson_id, lessons.category_id,
       COALESCE(completion, 0) / 100.0::DOUBLE AS completion
FROM users CROSS JOIN lessons LEFT JOIN ul
  ON ul.user_id = users.user_id AND ul.lesson_id = lessons.lesson_id""")
def _(s, d):
    return L.lesson_overview(ul(s, d), I.lessons(I.events(s, d)))


@Q.add("j8_lessons_not_completed", f"""{HU}
SELECT users.user_id, lessons.lesson_id FROM users CROSS JOIN lessons
WHERE NOT EXISTS (SELECT 1 FROM ul WHERE ul.user_id = users.user_id
                  AND ul.lesson_id = lessons.lesson_id AND is_completed)""")
def _(s, d):
    return L.open_lessons(ul(s, d), I.lessons(I.events(s, d)))


@Q.add("j20_fill_recommendations", f"""{HU},
seen AS (SELECT DISTINCT user_id, lesson_id FROM act WHERE event_type = 'view'),
vu AS (SELECT DISTINCT user_id FROM seen)
SELECT user_id, lesson_id, CAST(rn AS INTEGER) AS position FROM (
  SELECT vu.user_id, lessons.lesson_id,
         row_number() OVER (PARTITION BY vu.user_id ORDER BY lessons.lesson_id) AS rn
  FROM vu CROSS JOIN lessons WHERE NOT EXISTS
    (SELECT 1 FROM seen WHERE seen.user_id = vu.user_id AND seen.lesson_id = lessons.lesson_id))
WHERE rn <= 3""")
def _(s, d):
    ev = I.events(s, d)
    seen = ev.where("event_type = 'view'").select("user_id", "lesson_id").distinct()
    return L.fill_recommendations(seen, I.lessons(ev))


BADGE = """badge AS (SELECT r_regionkey AS achievement_id FROM region),
unl AS (SELECT user_id, k % 7 AS achievement_id, min(ts) AS unlocked_at FROM act
        WHERE event_type = 'purchase' GROUP BY ALL),
shown AS (SELECT users.user_id, badge.achievement_id, unlocked_at IS NOT NULL AS is_unlocked,
                 strftime(unlocked_at, '%Y-%m-%d %H:%M:%S') AS unlocked_at
  FROM users CROSS JOIN badge LEFT JOIN unl
    ON unl.user_id = users.user_id AND unl.achievement_id = badge.achievement_id)"""


def _badges(s, d):
    ev = I.events(s, d)
    unl = ev.where("event_type = 'purchase'").groupBy(
        "user_id", (F.col("k") % 7).alias("achievement_id")
    ).agg(F.min("ts").alias("unlocked_at"))
    badges = table(s, d, "region").select(F.col("r_regionkey").alias("achievement_id"))
    return ev.select("user_id").distinct(), badges, unl


@Q.add("j6_achievements_unlocked", f"{HU}, {BADGE} SELECT * FROM shown")
def _(s, d):
    return L.achievements(*_badges(s, d))


@Q.add("a32_achievement_progress", f"""{HU}, {BADGE}
SELECT user_id, count(*) FILTER (WHERE is_unlocked) AS unlocked,
       avg(CAST(is_unlocked AS DOUBLE)) AS progress FROM shown GROUP BY user_id""")
def _(s, d):
    return L.achievement_progress(*_badges(s, d))


# server review schedule, the recursion spelled out one review per step
SRS = """rv AS (SELECT user_id, item, quality, ts,
    row_number() OVER (PARTITION BY user_id, item ORDER BY ts, event_id) AS rn FROM act),
sm(user_id, item, rn, reps, iv, ease, ret) AS (
  SELECT DISTINCT user_id, item, CAST(0 AS BIGINT), 0, CAST(1 AS BIGINT), 2.5::DOUBLE, 100.0::DOUBLE FROM rv
  UNION ALL
  SELECT user_id, item, rn, reps, CASE WHEN reps = 0 THEN 1 WHEN reps = 1 THEN 1 WHEN reps = 2 THEN 3
           ELSE CAST(ceil(iv * ease) AS BIGINT) END, ease, ret
  FROM (SELECT sm.user_id, sm.item, rv.rn, CASE WHEN quality >= 3 THEN reps + 1 ELSE 0 END AS reps, iv,
           CASE WHEN quality >= 3 THEN GREATEST(1.3::DOUBLE, ease + 0.1::DOUBLE
                  - (5 - quality) * (0.08::DOUBLE + (5 - quality) * 0.02::DOUBLE)) ELSE 2.5::DOUBLE END AS ease,
           LEAST(100.0::DOUBLE, ret + quality * 10) AS ret
        FROM sm JOIN rv ON rv.user_id = sm.user_id AND rv.item = sm.item AND rv.rn = sm.rn + 1)),
lastrv AS (SELECT user_id, item, max(rn) AS rn, max(ts) AS last_reviewed,
                  count(*) FILTER (WHERE quality >= 3) * 5 AS xp FROM rv GROUP BY user_id, item),
srs AS (SELECT lastrv.user_id, lastrv.item, last_reviewed, xp, reps AS repetitions,
               CAST(iv AS INTEGER) AS "interval", ease, ret AS retention,
               last_reviewed + to_days(CAST(iv AS INTEGER)) AS due_date
        FROM lastrv JOIN sm USING (user_id, item, rn))"""
HS = f"{H.replace('WITH', 'WITH RECURSIVE', 1)}, {I.LESSON_SQL}, {SRS}"


def srs(s, d):
    return L.sm2_server(I.events(s, d), ["user_id", "item"], ["ts", "event_id"], chunk())


@Q.add("w38_sm2_server", f"""{HS}
SELECT user_id, item, CAST(xp AS BIGINT) AS xp, CAST(repetitions AS BIGINT) AS repetitions, "interval",
       round(ease, 6) AS ease, retention, CAST(CAST(due_date AS DATE) AS VARCHAR) AS due_day FROM srs""")
def _(s, d):
    return srs(s, d).select(
        "user_id", "item", "xp", "repetitions", "interval", F.round("ease", 6).alias("ease"),
        "retention", F.to_date("due_date").cast("string").alias("due_day"))


DEV = """gr AS (SELECT user_id, item, correct, ts, CASE WHEN NOT correct THEN 1 WHEN accuracy < 0.6 THEN 2
      WHEN accuracy < 0.8 THEN 3 WHEN accuracy < 0.95 THEN 4 ELSE 5 END AS g,
    row_number() OVER (PARTITION BY user_id, item ORDER BY ts, event_id) AS rn FROM act),
dv(user_id, item, rn, reps, iv, ease) AS (
  SELECT DISTINCT user_id, item, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 1.0::DOUBLE, 2.5::DOUBLE FROM gr
  UNION ALL
  SELECT dv.user_id, dv.item, gr.rn, CASE WHEN g >= 3 THEN reps + 1 ELSE 0 END,
    CASE WHEN g < 3 OR reps = 0 THEN 1.0 WHEN reps = 1 THEN 6.0 ELSE round_even(iv * ease, 0) END,
    GREATEST(1.3::DOUBLE, ease + (0.1::DOUBLE - (5 - g) * (0.08::DOUBLE + (5 - g) * 0.02::DOUBLE)))
  FROM dv JOIN gr ON gr.user_id = dv.user_id AND gr.item = dv.item AND gr.rn = dv.rn + 1),
lastgr AS (SELECT user_id, item, max(rn) AS rn, max(ts) AS last_reviewed, count(*) FILTER (WHERE correct) AS correct_count,
                  count(*) FILTER (WHERE NOT correct) AS incorrect_count FROM gr GROUP BY user_id, item),
signs AS (SELECT lastgr.user_id, lastgr.item, correct_count, incorrect_count, last_reviewed, ease,
                 reps AS repetitions, CAST(iv AS INTEGER) AS "interval",
                 last_reviewed + to_days(CAST(iv AS INTEGER)) AS next_review
          FROM lastgr JOIN dv USING (user_id, item, rn))"""
HD = f"{H.replace('WITH', 'WITH RECURSIVE', 1)}, {DEV}"


def signs(s, d):
    return L.sm2_device(I.events(s, d), ["user_id", "item"], ["ts", "event_id"], chunk())


@Q.add("w39_sm2_device", f"""{HD}
SELECT user_id, item, correct_count, incorrect_count, repetitions, "interval", round(ease, 6) AS ease,
       CAST(CAST(next_review AS DATE) AS VARCHAR) AS next_day FROM signs""")
def _(s, d):
    return signs(s, d).select(
        "user_id", "item", "correct_count", "incorrect_count", "repetitions", "interval",
        F.round("ease", 6).alias("ease"), F.to_date("next_review").cast("string").alias("next_day"))


@Q.add("a28_upcoming_reviews", f"""{HS}
SELECT user_id, count(*) FILTER (WHERE CAST(due_date AS DATE) = d) AS due_today,
  count(*) FILTER (WHERE CAST(due_date AS DATE) = d + 1) AS due_tomorrow,
  count(*) FILTER (WHERE CAST(due_date AS DATE) > d + 1 AND CAST(due_date AS DATE) <= d + 7) AS due_this_week,
  count(*) FILTER (WHERE CAST(due_date AS DATE) < d) AS overdue
FROM srs, today GROUP BY user_id""")
def _(s, d):
    return L.upcoming_reviews(srs(s, d), I.today(I.events(s, d)))


@Q.add("a29_review_progress", f"""{HS},
c AS (SELECT user_id, count(*) FILTER (WHERE due_date <= now) AS due,
  count(*) FILTER (WHERE CAST(due_date AS DATE) = d + 1) AS tomorrow,
  count(*) FILTER (WHERE CAST(due_date AS DATE) > d AND CAST(due_date AS DATE) <= d + 7) AS week
  FROM srs, today GROUP BY user_id)
SELECT *, CASE WHEN due + tomorrow + week > 0 THEN due / CAST(due + tomorrow + week AS DOUBLE)
          ELSE 0.0 END AS progress FROM c""")
def _(s, d):
    ev = I.events(s, d)
    return L.review_progress(srs(s, d), I.today(ev), I.now(ev))


@Q.add("j7_due_reviews", f"""{HS}
SELECT user_id, item AS lesson_id, category_id, CAST(repetitions AS BIGINT) AS repetitions,
  strftime(due_date, '%Y-%m-%d %H:%M:%S') AS due_date,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY due_date, item) AS INTEGER) AS position
FROM (SELECT srs.* FROM srs, today WHERE due_date <= now) x LEFT JOIN lessons ON lessons.lesson_id = x.item""")
def _(s, d):
    ev = I.events(s, d)
    return L.due_reviews(srs(s, d).withColumnRenamed("item", "lesson_id"), I.lessons(ev), I.now(ev))


@Q.add("a35_review_queue", f"""{HD}
SELECT user_id, item, CAST(rn AS INTEGER) AS position FROM (
  SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY next_review, item) AS rn
  FROM signs, today WHERE next_review <= now) WHERE rn <= 10""")
def _(s, d):
    return L.review_queue(signs(s, d), I.now(I.events(s, d)))


@Q.add("a34_forgotten_signs", f"""{HD}
SELECT user_id, item, incorrect_count, correct_count, CAST(row_number() OVER (PARTITION BY user_id ORDER BY incorrect_count DESC, item) AS INTEGER) AS position FROM signs, today
WHERE incorrect_count > correct_count * 0.5 OR epoch_us(now) - epoch_us(last_reviewed) > 2592000000000""")
def _(s, d):
    return L.forgotten_signs(signs(s, d), I.now(I.events(s, d)))


@Q.add("a33_weekly_report", f"""{HD},
r AS (SELECT user_id, avg(correct_count / CAST(correct_count + incorrect_count + 1 AS DOUBLE)) AS average_accuracy
      FROM signs GROUP BY user_id)
SELECT user_id, round(average_accuracy, 6) AS average_accuracy, item AS top_missed FROM r JOIN (
  SELECT user_id, item FROM signs
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY incorrect_count DESC, item) = 1) USING (user_id)""")
def _(s, d):
    return L.weekly_report(signs(s, d)).withColumn(
        "average_accuracy", F.round("average_accuracy", 6))


@Q.add("a33_daily_activity", f"""{H}
SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT date_trunc('minute', ts)) AS minutes,
       round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy
FROM act, today WHERE CAST(ts AS DATE) > d - 7 GROUP BY user_id, CAST(ts AS DATE)""")
def _(s, d):
    ev = I.events(s, d)
    return L.daily_activity(ev, I.today(ev)).withColumn("accuracy", F.round("accuracy", 6))


@Q.add("a36_calibration_level", f"""{H},
f AS (SELECT user_id, count(*) FILTER (WHERE correct) AS right_answers FROM (
  SELECT * FROM act QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5)
  GROUP BY user_id)
SELECT *, CASE WHEN right_answers >= 4 THEN 3 WHEN right_answers >= 2 THEN 2 ELSE 1 END AS level FROM f""")
def _(s, d):
    return L.calibration_level(I.events(s, d))


@Q.add("a37_account_duration", """SELECT user_id,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0::DOUBLE, 2) AS days,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_login FROM events GROUP BY user_id""")
def _(s, d):
    return L.account_duration(I.events(s, d))


@Q.add("a38_distinct_categories", """SELECT p_brand AS category,
  row_number() OVER (ORDER BY p_brand) AS position FROM (SELECT DISTINCT p_brand FROM part)""")
def _(s, d):
    return L.distinct_categories(table(s, d, "part"), "p_brand")


@Q.add("w34_streak", """WITH days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM days),
r AS (SELECT user_id, island, count(*) AS length, max(day) AS last_day FROM i GROUP BY user_id, island)
SELECT user_id, arg_max(length, last_day) AS current_streak, max(length) AS longest_streak,
       CAST(max(last_day) AS VARCHAR) AS last_day FROM r GROUP BY user_id""")
def _(s, d):
    return L.streaks(I.events(s, d))


@Q.add("w35_combo", f"""{H},
n AS (SELECT user_id, event_id, ts, correct,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM act),
b AS (SELECT *, n - COALESCE(max(CASE WHEN NOT correct THEN n END)
        OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS combo FROM n)
SELECT user_id, event_id, combo, LEAST(3.0, 1 + combo * 0.5)::DOUBLE AS multiplier FROM b""")
def _(s, d):
    return L.combos(I.events(s, d), chunk())


@Q.add("a59_likes_views", f"""{H},
a AS (SELECT k, event_type, row_number() OVER w AS rn, sum(CASE WHEN event_type IN ('click', 'purchase') THEN 1
        WHEN event_type = 'error' THEN -1 ELSE 0 END) OVER w AS s FROM act
      WINDOW w AS (PARTITION BY k ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT k AS video_id, CAST(arg_max(s, rn) - LEAST(0, min(s)) AS BIGINT) AS likes,
       count(*) FILTER (WHERE event_type = 'view') AS views FROM a GROUP BY k""")
def _(s, d):
    return L.likes_views(I.events(s, d), chunk())


@Q.add("a60_account_audit_counts", """SELECT event_type,
  CASE WHEN value > 100 THEN 'failure' ELSE 'success' END AS status,
  CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY ALL""")
def _(s, d):
    return L.audit_counts(I.events(s, d))

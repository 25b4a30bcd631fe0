"""Reports that make no learner x lesson rows, against plain loops."""

import random

from pyspark.sql import functions as F

from tracklore.operators import learner as L


def test_first_missing_numbers(spark):
    rnd = random.Random(3)
    held = {u: set(rnd.sample(range(1, 12), rnd.randint(1, 11))) for u in range(30)}
    rows = [(u, n) for u, s in held.items() for n in s for _ in range(2)]
    have = spark.createDataFrame(rows, "user_id int, number bigint")
    got = {(r.user_id, r.position): r.number for r in L.first_missing(have, "user_id", 4).collect()}
    for u, s in held.items():
        want = [n for n in range(1, 20) if n not in s][:4]
        assert [got[u, k] for k in range(1, 5)] == want


def _case(spark, seed, users=25, lessons=17, categories=4):
    rnd = random.Random(seed)
    dim = [(n * 3, n % categories) for n in range(lessons)]
    ul = []
    for u in range(users):
        share = rnd.choice((0.1, 0.6, 1.0))
        for lesson, _ in dim:
            if rnd.random() < share:
                c = rnd.choice((0, 10, 40, 100)) if share < 1 or u % 2 else 100
                ul.append((u, lesson, c, c >= 100))
        if not any(r[0] == u for r in ul):
            ul.append((u, dim[0][0], 100, True))
    return ul, dim, spark.createDataFrame(ul, "user_id int, lesson_id int, completion int, is_completed boolean"), \
        spark.createDataFrame(dim, "lesson_id int, category_id int")


def test_recommendation_is_the_loop_over_all_categories(spark):
    ul, dim, ul_df, lessons = _case(spark, 8)
    got = {r.user_id: (r.category_id, round(r.average, 9), r.lesson_id) for r in L.recommendation(ul_df, lessons).collect()}
    for u in {r[0] for r in ul}:
        mine = {r[1]: r[2] for r in ul if r[0] == u}
        done = {r[1] for r in ul if r[0] == u and r[3]}
        averages = []
        for c in {c for _, c in dim}:
            have = [mine[n] for n, k in dim if k == c and n in mine]
            averages.append((sum(have) / len(have) if have else 0.0, c))
        a, c = min(averages)
        open_ = [n for n, _ in dim if n not in done]
        here = [n for n, k in dim if k == c and n not in done]
        least = min((v, n) for n, v in mine.items())[1]
        assert got[u] == (c, round(a, 9), min(here, default=min(open_, default=least))), u


def test_fill_is_the_first_unseen_lessons(spark):
    ul, dim, ul_df, lessons = _case(spark, 9)
    stranger = spark.createDataFrame([(99, 1000)], "user_id int, lesson_id int")
    seen = ul_df.select("user_id", "lesson_id").unionByName(stranger)
    got = {(r.user_id, r.position): r.lesson_id for r in L.fill_recommendations(seen, lessons, 3).collect()}
    want = {}
    for u in {r[0] for r in ul} | {99}:
        shown = {r[1] for r in ul if r[0] == u}
        for k, n in enumerate([n for n, _ in sorted(dim) if n not in shown][:3], 1):
            want[u, k] = n
    assert got == want


def test_many_lessons_make_no_product(spark):
    """300,000 lessons and 2,000 learners: the product would be 600 million rows."""
    lessons = spark.range(300_000).select(F.col("id").alias("lesson_id"), (F.col("id") % 1000).alias("category_id"))
    ul = spark.range(20_000).select((F.col("id") % 2000).alias("user_id"), (F.col("id") % 2000 + F.floor(F.col("id") / 2000)).alias("lesson_id"),
                                    F.lit(100).alias("completion"), F.lit(True).alias("is_completed"))
    got = L.fill_recommendations(ul, lessons, 2).where("user_id = 0").orderBy("position").collect()
    assert [r.lesson_id for r in got] == [10, 11]
    assert L.recommendation(ul, lessons).count() == 2000


def test_badges_without_learners_times_badges(spark):
    users = spark.createDataFrame([(1,), (2,), (2,)], "user_id int")
    badges = spark.createDataFrame([(0,), (1,), (2,), (3,)], "achievement_id int")
    got = spark.createDataFrame([(1, 0), (1, 0), (1, 9), (1, 3)], "user_id int, achievement_id int")
    rows = {r.user_id: (r.unlocked, r.progress) for r in L.achievement_progress(users, badges, got).collect()}
    assert rows == {1: (2, 0.5), 2: (0, 0.0)}

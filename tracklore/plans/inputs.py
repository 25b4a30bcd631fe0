"""Learner, clip, hand and text tables derived from the base tables.

Every derived table exists twice: as a DataFrame and as a SQL common table
expression with the same columns, so that a plan and its oracle start equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.functions.vectors import let
from tracklore.session import table

LESSONS, CATEGORIES = 20, 5


def events(spark: SparkSession, d: str) -> DataFrame:
    """One row per learner action, with every per-event attribute used below."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(
        "event_id", "user_id", "event_type", "value",
        F.col("ts").cast("timestamp").alias("ts"),
        k.alias("k"),
        F.floor("value").cast("int").alias("points"),
        (k % LESSONS).alias("lesson_id"),
        F.least(F.lit(100), F.floor("value").cast("int")).alias("completion"),
        (k % 10).alias("item"),
        ((k * 7 + F.col("event_id")) % 6).cast("double").alias("quality"),
        (F.col("event_type") != "error").alias("correct"),
        ((F.col("event_id") * 13) % 100 / F.lit(100.0)).alias("accuracy"),
    )


EV = """ev AS (
  SELECT event_id, user_id, event_type, value, ts,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
act AS (
  SELECT *, CAST(floor(value) AS INTEGER) AS points, k % 20 AS lesson_id,
         LEAST(100, CAST(floor(value) AS INTEGER)) AS completion, k % 10 AS item,
         CAST((k * 7 + event_id) % 6 AS DOUBLE) AS quality,
         event_type <> 'error' AS correct,
         ((event_id * 13) % 100) / 100.0::DOUBLE AS accuracy
  FROM ev),
today AS (SELECT CAST(max(ts) AS DATE) AS d, max(ts) AS now FROM events)"""


def today(ev: DataFrame):
    """Scalar date of the newest action; wall clocks never enter a query."""
    return ev.agg(F.to_date(F.max("ts"))).scalar()


def now(ev: DataFrame):
    return ev.agg(F.max("ts")).scalar()


def lessons(ev: DataFrame) -> DataFrame:
    return ev.select("lesson_id").distinct().withColumn(
        "category_id", F.col("lesson_id") % CATEGORIES
    )


LESSON_SQL = """lessons AS (
  SELECT DISTINCT lesson_id, lesson_id % 5 AS category_id FROM act)"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    """One joint per vector: element i of the vector is x at frame i."""
    e = table(spark, d, "embeddings")
    return e.select(
        F.col("vec_id").alias("clip_id"),
        F.lit(0).alias("kp"),
        F.posexplode_outer(F.col("embedding").cast("array<double>")).alias("frame_idx", "x"),
    )


FRAMES = """frames AS (
  SELECT vec_id AS clip_id, 0 AS kp,
         unnest(generate_series(0, len(embedding) - 1)) AS frame_idx,
         CAST(unnest(embedding) AS DOUBLE) AS x
  FROM embeddings)"""


def triples(spark: SparkSession, d: str) -> DataFrame:
    """One joint in space: 21 frames per vector, x/y/z from elements 3f..3f+2."""
    v = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("clip_id"),
        F.lit(0).alias("kp"),
        F.explode_outer(
            F.transform(
                F.sequence(F.lit(0), F.lit(20)),
                lambda i: F.struct(
                    i.alias("frame_idx"),
                    F.element_at(v, i * 3 + 1).alias("x"),
                    F.element_at(v, i * 3 + 2).alias("y"),
                    F.element_at(v, i * 3 + 3).alias("z"),
                ),
            )
        ).alias("s"),
    ).select("clip_id", "kp", "s.*")


TRIPLES = """triples AS (
  SELECT vec_id AS clip_id, 0 AS kp, f AS frame_idx,
         CAST(embedding[3*f+1] AS DOUBLE) AS x, CAST(embedding[3*f+2] AS DOUBLE) AS y,
         CAST(embedding[3*f+3] AS DOUBLE) AS z
  FROM (SELECT vec_id, embedding, unnest(generate_series(0, 20)) AS f FROM embeddings))"""

CLIP = 25  # frames per clip where one vector is one frame


def hands(spark: SparkSession, d: str) -> DataFrame:
    """One vector is one 21-joint hand; CLIP consecutive vectors form a clip."""
    v = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / CLIP).cast("bigint").alias("clip_id"),
        (F.col("vec_id") % CLIP).cast("int").alias("frame_idx"),
        F.transform(
            F.sequence(F.lit(0), F.lit(20)),
            lambda i: F.struct(
                F.element_at(v, i * 3 + 1).alias("x"),
                F.element_at(v, i * 3 + 2).alias("y"),
                F.element_at(v, i * 3 + 3).alias("z"),
            ),
        ).alias("kps"),
    )


HANDS = """hand_pts AS (
  SELECT vec_id // 25 AS clip_id, CAST(vec_id % 25 AS INTEGER) AS frame_idx, j AS kp,
         CAST(embedding[3*j+1] AS DOUBLE) AS x, CAST(embedding[3*j+2] AS DOUBLE) AS y,
         CAST(embedding[3*j+3] AS DOUBLE) AS z
  FROM (SELECT vec_id, embedding, unnest(generate_series(0, 20)) AS j FROM embeddings))"""


def bodies(spark: SparkSession, d: str) -> DataFrame:
    """60-keypoint frames: element (7*kp + 3*axis + 5) mod 64 of each vector."""
    v = F.col("embedding").cast("array<double>")

    def axis(v, i, a):
        return F.element_at(v, ((i * 7 + a * 3 + 5) % 64 + 1).cast("int"))

    return table(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / CLIP).cast("bigint").alias("clip_id"),
        (F.col("vec_id") % CLIP).cast("int").alias("frame_idx"),
        let(v, lambda v: F.transform(
            F.sequence(F.lit(0), F.lit(59)),
            lambda i: F.struct(
                axis(v, i, 0).alias("x"), axis(v, i, 1).alias("y"), axis(v, i, 2).alias("z"),
                (F.abs(axis(v, i, 0)) > 0.02).alias("valid"),
            ),
        )).alias("kps"),
    )


BODIES = """body AS (
  SELECT vec_id // 25 AS clip_id, CAST(vec_id % 25 AS INTEGER) AS frame_idx, j AS kp,
         CAST(embedding[(7*j+5) % 64 + 1] AS DOUBLE) AS x,
         CAST(embedding[(7*j+8) % 64 + 1] AS DOUBLE) AS y,
         CAST(embedding[(7*j+11) % 64 + 1] AS DOUBLE) AS z,
         abs(CAST(embedding[(7*j+5) % 64 + 1] AS DOUBLE)) > 0.02 AS valid
  FROM (SELECT vec_id, embedding, unnest(generate_series(0, 59)) AS j FROM embeddings))"""


def logits(spark: SparkSession, d: str) -> DataFrame:
    """First ten vector elements times ten as class scores; the label is the target."""
    v = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.floor(F.col("vec_id") / CLIP).cast("bigint").alias("seq_id"),
        (F.col("vec_id") % CLIP).cast("int").alias("t"),
        F.transform(F.slice(v, 1, 10), lambda x: x * 10).alias("logits"),
        F.col("label").alias("target"),
    )


LOGITS = """logit AS (
  SELECT vec_id AS row_id, vec_id // 25 AS seq_id, CAST(vec_id % 25 AS INTEGER) AS t,
         label AS target, c, CAST(embedding[c+1] AS DOUBLE) * 10 AS z
  FROM (SELECT vec_id, label, embedding, unnest(generate_series(0, 9)) AS c FROM embeddings)),
prob AS (
  SELECT row_id, seq_id, t, target, c, z,
         exp(z - mz) / sum(exp(z - mz)) OVER (PARTITION BY row_id) AS p
  FROM (SELECT *, max(z) OVER (PARTITION BY row_id) AS mz FROM logit))"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """A user turn as reference, the following assistant turn as hypothesis."""
    c = table(spark, d, "conversations")
    a = c.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp")
    )
    return c.where("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("ref")
    ).join(a, ["conv_id", "turn"])


PAIRS = """pair AS (
  SELECT u.conv_id, u.turn, u.text AS ref, a.text AS hyp
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def words(col: str = "text"):
    """Lower-case whitespace tokens without empties."""
    return F.filter(F.split(F.lower(F.col(col)), r"[ \t\n\r]+"), lambda w: w != "")


WORDS_SQL = "list_filter(string_split_regex(lower({c}), '[ \\t\\n\\r]+'), lambda w: w <> '')"

"""Uncertainty, out-of-distribution and conformal scores over class scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklore.functions import vectors as V
from tracklore.operators import ordered

ORACLE_ENTROPY, PSEUDO_ENTROPY, MARGIN, PSEUDO_MARGIN = 1.20, 0.35, 0.25, 0.70
EPISTEMIC_LIMIT, ENERGY_LIMIT, OOD_ENERGY = 0.45, 2.50, -6.0
GROUNDING = 0.5


def frame_scores(preds: DataFrame, classes: int) -> DataFrame:
    norm = math.log(max(2, classes))
    p = F.transform(V.softmax("logits"), lambda x: F.least(F.greatest(x, F.lit(1e-8)), F.lit(1.0)))
    r = F.col("r")
    return (
        preds.withColumn("r", V.ranked(p))
        .select(
            "seq_id", "t", (V.entropy(F.transform(r, lambda s: -s["np"])) / norm).alias("entropy"),
            (r[1]["np"] - r[0]["np"]).alias("margin"), (-r[0]["np"]).alias("top"),
            r[0]["c"].alias("token"), r[1]["c"].alias("runner_up"),
        )
    )


def sequence_uncertainty(preds: DataFrame, classes: int) -> DataFrame:
    norm = math.log(max(2, classes))
    s = frame_scores(preds, classes).groupBy("seq_id").agg(
        F.avg("entropy").alias("mean_entropy"), F.avg("margin").alias("mean_margin"),
        F.min("top").alias("min_confidence"),
    )
    e, m = F.col("mean_entropy"), F.col("mean_margin")
    score = (e + (1 - m) + (1 - F.col("min_confidence"))) / 3
    return s.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).withColumn(
        "action",
        F.when((e >= ORACLE_ENTROPY / norm) | (m <= MARGIN), "ORACLE_ANNOTATION")
        .when((e <= PSEUDO_ENTROPY / norm) & (m >= PSEUDO_MARGIN), "PSEUDO_LABEL")
        .otherwise("NEUTRAL"),
    )


def ambiguous_frames(preds: DataFrame, classes: int, k: int = 5) -> DataFrame:
    w = Window.partitionBy("seq_id").orderBy(F.round("entropy", 9).desc(), "t")
    return (
        frame_scores(preds, classes).withColumn("position", F.row_number().over(w))
        .where(F.col("position") <= k).select("seq_id", "t", "position", "token", "runner_up")
    )


def prioritized_pool(scored: DataFrame) -> DataFrame:
    """Oracle queue by falling score and pseudo-label queue by rising score."""
    queued = scored.where(F.col("action") != "NEUTRAL").select(
        "seq_id", "action",
        F.round(F.when(F.col("action") == "ORACLE_ANNOTATION", -F.col("score"))
                .otherwise(F.col("score")), 9).alias("key"),
    )
    parts = []
    for action in ("ORACLE_ANNOTATION", "PSEUDO_LABEL"):
        one = queued.where(F.col("action") == action)
        parts.append(ordered.positions(
            one, [F.col("key"), F.col("seq_id")], "position"))
    return parts[0].unionByName(parts[1]).select("action", "position", "seq_id")


def target_scores(preds: DataFrame, kind: str = "margin") -> DataFrame:
    """Nonconformity of the target: 1 - p, or the mass down to it (aps)."""
    p = V.softmax("logits")
    target = F.element_at("p", F.col("target") + 1)
    if kind == "margin":
        score = 1 - target
    else:
        # mass of the classes ranked at or above the target
        score = V.let(target, lambda g: F.aggregate(
            F.transform("p", lambda x, i: F.when(
                (x > g) | ((x == g) & (i <= F.col("target"))), x).otherwise(0.0)),
            F.lit(0.0), lambda a, x: a + x))
    return preds.withColumn("p", p).withColumn("score", score)


def conformal_quantile(scored: DataFrame, alpha: float = 0.1, rank_of: str = "linear") -> DataFrame:
    """Quantile at ceil((n + 1)(1 - alpha)) / n over all calibration scores."""
    level = lambda n: F.least(F.lit(1.0), F.ceil((n + 1) * (1 - alpha)) / n)
    return ordered.exact_quantiles(scored, [], "score", {"q_hat": level}, rank_of)


def conformal_sets(preds: DataFrame, kind: str, alpha: float = 0.1) -> DataFrame:
    """Prediction set of every row under the calibrated threshold."""
    scored = target_scores(preds, kind)
    q = conformal_quantile(scored.select("score"), alpha, "higher").scalar()
    r = scored.withColumn("q", q).withColumn("r", V.ranked("p"))
    if kind == "aps":
        # classes whose preceding mass stays under q
        start = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("size"))
        size = F.aggregate("r", start, lambda a, s: F.struct(
            (a["mass"] - s["np"]).alias("mass"),
            (a["size"] + (a["mass"] < F.col("q")).cast("int")).alias("size"),
        ))["size"]
    else:
        size = F.size(F.filter("r", lambda s: -s["np"] >= 1 - F.col("q")))
    sized = r.withColumn("set_size", F.greatest(F.lit(1), size))
    chosen = F.transform(F.slice("r", F.lit(1), F.col("set_size")), lambda s: s["c"])
    return sized.select(
        "row_id", "set_size", F.array_contains(chosen, F.col("target")).alias("covered"), "q"
    )


def coverage(sets: DataFrame) -> DataFrame:
    return sets.agg(
        F.max("q").alias("q_hat"), F.avg("set_size").alias("mean_set_size"),
        F.avg(F.col("covered").cast("double")).alias("coverage"),
    )


def weighted_quantiles(
    calib: DataFrame, tests: DataFrame, alpha: float = 0.1, parts: int | None = None
) -> DataFrame:
    """Per test weight: first score whose cumulative weight share reaches 1 - alpha.

    Calibration rows (score, weight) are cut into score ranges; range totals give
    every row its cumulative weight, and a test row only visits the range its
    threshold falls in, as one more row of an ordered union.
    """
    per_score = calib.groupBy("score").agg(F.sum("weight").alias("w"))
    src = ordered._range_bucket(per_score, F.col("score"), parts)
    sums = src.groupBy("__b").agg(F.sum("w").alias("s"))
    upto = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # at most `parts` rows
    ends = sums.select("__b", F.sum("s").over(upto).alias("hi"), "s")
    inside = Window.partitionBy("__b").orderBy("score").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    cum = src.join(F.broadcast(ends), "__b").select(
        "__b", "score", (F.sum("w").over(inside) + F.col("hi") - F.col("s")).alias("cum"),
        F.lit(None).cast(tests.schema["row_id"].dataType).alias("row_id"),
    )
    ladder = ends.agg(F.array_sort(F.collect_list(F.struct("hi", "__b")))).scalar()
    goal = (1 - alpha) * (F.element_at("ladder", -1)["hi"] + F.col("weight") + 1e-6)
    asked = (
        tests.withColumn("ladder", ladder).withColumn("goal", goal)
        .withColumn("__b", F.get(F.filter("ladder", lambda s: s["hi"] >= F.col("goal")), F.lit(0))["__b"])
        .select("__b", "row_id", "goal")
    )
    none = asked.where(F.col("__b").isNull()).select("row_id", F.lit(1.0).alias("quantile"))
    # downwards by cumulative weight the last score seen is the smallest that reaches the goal
    salt = F.pmod(F.xxhash64("row_id"), F.lit(16))
    # the thresholds of light test rows crowd into few ranges: only those are
    # repeated per salt (at most `parts` range numbers are broadcast)
    used = asked.where(F.col("__b").isNotNull()).select("__b").distinct()
    both = cum.join(F.broadcast(used), "__b", "left_semi").withColumn("salt", F.explode_outer(F.sequence(F.lit(0), F.lit(15)))).unionByName(
        asked.where(F.col("__b").isNotNull()).select(
            "__b", F.lit(None).cast("double").alias("score"), F.col("goal").alias("cum"), "row_id",
            salt.cast("int").alias("salt")))
    down = Window.partitionBy("__b", "salt").orderBy(F.desc("cum"), F.col("row_id").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    found = both.withColumn("quantile", F.last("score", ignorenulls=True).over(down)).where(
        F.col("row_id").isNotNull()
    ).select("row_id", "quantile")
    return found.unionByName(none)


def free_energy(preds: DataFrame, temperature: float = 1.0) -> DataFrame:
    e = -temperature * V.logsumexp("logits", temperature)
    return preds.select("row_id", e.alias("energy"), (e > OOD_ENERGY).alias("is_ood"))


def mean_class(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Average probability per class over all rows of a key."""
    return (
        preds.select(*keys, F.posexplode_outer(V.softmax("logits")).alias("c", "p"))
        .groupBy(*keys, "c").agg(F.avg("p").alias("p"))
    )


def epistemic(preds: DataFrame) -> DataFrame:
    """Entropy of the mean minus mean entropy over the passes of a sequence."""
    mean = mean_class(preds, ["seq_id"])
    q = F.greatest("p", F.lit(1e-8))
    of_mean = mean.groupBy("seq_id").agg(
        F.sum(-F.col("p") * F.log(q)).alias("total"), F.max("p").alias("top"))
    p = V.softmax("logits")
    h = F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.log(F.greatest(x, F.lit(1e-8))))
    of_each = preds.groupBy("seq_id").agg(
        F.avg(h).alias("expected"), F.avg(-V.logsumexp("logits")).alias("energy"))
    mi = F.greatest(F.lit(0.0), F.col("total") - F.col("expected"))
    return of_mean.join(of_each, "seq_id").select(
        "seq_id", mi.alias("mi"), "energy",
        F.least(F.lit(1.0), F.col("top") * F.exp(-mi)).alias("confidence"),
        ((mi > EPISTEMIC_LIMIT) | (F.col("energy") > ENERGY_LIMIT)).alias("is_ood"),
    )


def token_grounding(dists: DataFrame) -> DataFrame:
    """Mean risk exp(-KL(with vision, without)) per sentence; high means ungrounded."""
    kl = V.total(F.zip_with("p1", "p0", lambda a, b: F.when(a > 0, a * (
        F.log(a) - F.log(F.greatest(b, F.lit(1e-8))))).otherwise(0.0)))
    risk = F.exp(-F.greatest(F.lit(0.0), kl))
    return dists.groupBy("seq_id").agg(F.avg(risk).alias("score")).withColumn(
        "is_hallucinated", F.col("score") > 1 - GROUNDING
    )


def ensemble(preds: DataFrame) -> DataFrame:
    """Best class per (seq, t) after averaging the views."""
    mean = mean_class(preds, ["seq_id", "t"])
    return mean.groupBy("seq_id", "t").agg(
        F.max_by("c", F.struct("p", -F.col("c"))).alias("token")
    )


def collapse(tokens: DataFrame, blank: Column | int = 0) -> DataFrame:
    """Drop repeats, then blanks; one ordered token array per sequence."""
    w = Window.partitionBy("seq_id").orderBy("t")
    last = F.lag("token").over(w)
    blank = blank if isinstance(blank, Column) else F.lit(blank)
    kept = tokens.withColumn("__last", last).where(
        (F.col("token") != blank) & (F.col("__last").isNull() | (F.col("__last") != F.col("token")))
    )
    return kept.groupBy("seq_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("t", "token"))), lambda s: s["token"]).alias("tokens")
    )

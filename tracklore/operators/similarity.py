"""Nearest-item joins, lexicon joins and span joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklore.functions import vectors as V
from tracklore.operators import metric
from tracklore.operators.learner import chunked
from tracklore.session import written

BUCKET = 64  # frames per bucket of a range join
ALIGNED = 2000  # series of a task that aligns them


# -- small candidate tables -----------------------------------------------------


def centroids(rows: DataFrame, vec: str, label: str) -> DataFrame:
    """Mean vector per label; element sums are combined before the shuffle."""
    e = rows.select(label, F.posexplode_outer(vec).alias("i", "x"))
    m = e.groupBy(label, "i").agg(F.avg("x").alias("x"))
    return m.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))


def classify(rows: DataFrame, key: str, vec: str, candidates: DataFrame, label: str, centre: str,
             scale: float = 100.0) -> DataFrame:
    """Best candidate by cosine and its softmax share.

    On unit vectors the nearest is the best, and a share in double precision needs only the candidates that come within
    40 / scale of it, less the logarithm of their number: what lies beyond adds less than 1e-17.
    """
    unit = lambda v: F.transform(v, lambda x: x / V.norm(v))
    n = candidates.agg(F.count(F.lit(1)))
    t = metric.tree(candidates.select(label, unit(F.col(centre)).alias("u")), label, {"u": 1.0})
    q = written(metric.bounded(metric.asked(rows.select(key, unit(F.col(vec)).alias("u")), t, key), t))
    wide = F.col("bound") * F.col("bound") + 2 * (40 + F.log(n.scalar() + 1)) / scale
    cos = F.transform("members", lambda m: F.struct(V.dot("v0", m["v0"]).alias("cos"), m["item"].alias("label")))
    part = metric.reached(q.withColumn("bound", F.sqrt(wide)), t, wide=True).withColumn("__s", cos)
    best = F.array_max("__s")
    total = F.aggregate("__s", F.lit(0.0), lambda a, s: a + F.exp(scale * (s["cos"] - best["cos"])))
    each = part.select("query", best.alias("best"), total.alias("total")).groupBy("query").agg(
        F.max("best").alias("best"), F.collect_list(F.struct("best", "total")).alias("parts"))
    spread = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["total"] * F.exp(scale * (p["best"]["cos"] - F.col("best.cos"))))
    return each.select(F.col("query").alias(key), F.col("best.label").alias("predicted"), F.col("best.cos").alias("similarity"),
                       (1 / spread).alias("probability"))


def nearest_code(rows: DataFrame, key: str, vec: str, codes: DataFrame, code: str, centre: str) -> DataFrame:
    """Closest codebook entry by squared distance; ties take the smaller code."""
    best = metric.nearest(rows.select(key, F.col(vec).alias("v")), codes.select(code, F.col(centre).alias("v")), key, code, {"v": 1.0})
    return best.withColumn("distance", F.col("distance") * F.col("distance"))


def fit_codes(rows: DataFrame, vec: str, k: int, seed: int = 7) -> DataFrame:
    """Codebook by k-means of the machine-learning library."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed).fit(rows.select(array_to_vector(vec).alias("features")))
    data = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return rows.sparkSession.createDataFrame(data, "code int, centre array<double>")


def bone_directions(kps: str = "kps") -> Column:
    """Unit vectors of the 20 finger bones, flattened."""
    # fixed values: parent joint of joints 1..20
    parents = (0, 1, 2, 3, 0, 5, 6, 7, 0, 9, 10, 11, 0, 13, 14, 15, 0, 17, 18, 19)
    bones = []
    for child, parent in enumerate(parents, 1):
        a, b = F.get(kps, F.lit(child)), F.get(kps, F.lit(parent))
        bones.append(V.let(F.array(*[a[c] - b[c] for c in "xyz"]), lambda d: V.let(
            F.greatest(V.norm(d), F.lit(1e-9)), lambda n: F.transform(d, lambda x: x / n))))
    return F.flatten(F.array(*bones))


# -- exact nearest different label ----------------------------------------------


def hard_negatives(rows: DataFrame, key: str, label: str, parts: dict[str, tuple[str, float]]) -> DataFrame:
    """For each row the nearest row of another label, by a weighted sum of part distances; ties, judged on nine
    places, go to the smallest key."""
    given = rows.select(key, label, *[F.col(v).alias(name) for name, (v, _) in parts.items()])
    weights = {name: w for name, (_, w) in parts.items()}
    items = given.withColumnRenamed(key, "negative")
    return metric.nearest(given, items, key, "negative", weights, label, places=9)


# -- lexicon --------------------------------------------------------------------


def minimal_pair_counts(lexicon: DataFrame, key: str) -> DataFrame:
    """Per gloss how many others share handshape and sign type at another location.

    Counted from group sizes, never by listing the pairs of a group.
    """
    known = lexicon.where("handshape is not null and signtype is not null and location is not null")
    group = known.groupBy("handshape", "signtype", "location").agg(F.count(F.lit(1)).alias("same"))
    total = group.groupBy("handshape", "signtype").agg(F.sum("same").alias("of"))
    n = group.join(total, ["handshape", "signtype"]).withColumn("pairs", F.col("of") - F.col("same"))
    return known.join(n, ["handshape", "signtype", "location"]).select(key, "pairs")


def lexicon_match(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Exact lemma, else the lemma without digits, '_' and '-'."""
    bare = F.regexp_replace(F.lower("lemma"), r"[0-9_\-]", "")
    exact = lexicon.groupBy(F.lower("lemma").alias("word")).agg(F.min("entry").alias("e1"))
    loose = lexicon.groupBy(bare.alias("word")).agg(F.min("entry").alias("e2"))
    w = words.withColumn("__w", F.lower("word"))
    j = w.join(exact.withColumnRenamed("word", "__w"), "__w", "left").withColumn(
        "__b", F.regexp_replace("__w", r"[0-9_\-]", "")).join(loose.withColumnRenamed("word", "__b"), "__b", "left")
    return j.select("word", F.coalesce("e1", "e2").alias("entry"))


# -- spans ----------------------------------------------------------------------


def weave(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Sentence per clip: word tokens outside spelled spans, spelled words at the
    middle of their span.  The range condition meets on frame buckets."""
    s = spans.select("clip_id", "start", "end", "word")
    keyed = s.withColumn("b", F.explode_outer(F.sequence(
        F.floor(F.col("start") / BUCKET), F.floor((F.col("end") - 1) / BUCKET))))
    t = tokens.withColumn("b", F.floor(F.col("frame_idx") / BUCKET))
    inside = (t["clip_id"] == keyed["clip_id"]) & (t["b"] == keyed["b"]) & (
        t["frame_idx"] >= keyed["start"]) & (t["frame_idx"] < keyed["end"])
    kept = t.join(keyed, inside, "left_anti").select("clip_id", "frame_idx", F.lit(0).alias("kind"), F.col("token").alias("word"))
    spelled = s.select("clip_id", F.floor((F.col("start") + F.col("end")) / 2).cast("int").alias("frame_idx"), F.lit(1).alias("kind"), "word")
    return kept.unionByName(spelled).groupBy("clip_id").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("frame_idx", "kind", "word"))), lambda x: x["word"]), " ").alias("sentence"))


def align_exemplars(rows: DataFrame, key: str, series: str, exemplars: DataFrame, label: str, centre: str) -> DataFrame:
    """Nearest exemplar of each series by dynamic time warping.

    Series lie in blocks of about ``ALIGNED`` on tasks that are as many as the blocks, so a task doesn't grow with the table.
    """
    from tracklore.functions.edit import dtw_distance
    few = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = rows.select(key, series).repartition(max(few, -(-rows.count() // ALIGNED)))
    src = chunked(given, exemplars, label, centre).withColumn("__e", F.explode_outer("__c"))
    d = src.select(key, F.col(f"__e.{label}").alias("exemplar"), F.round(dtw_distance(series, f"__e.{centre}"), 6).alias("cost"))
    return d.groupBy(key).agg(F.min(F.struct("cost", "exemplar")).alias("b")).select(key, "b.exemplar", "b.cost")

"""Corpus tables: splits, vocabularies, counts, leakage and quality audits.

Audits aggregate first and join the small result; token tables are counted per
(document, token) before they are shuffled by token, so a word that fills a third
of the corpus arrives as partial counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklore.functions import text as X
from tracklore.functions.vectors import let
from tracklore.operators import lists, ordered


def explode_tokens(docs: DataFrame, words: Column, *keep: str) -> DataFrame:
    """One row per token; outer explode avoids a second evaluation as a filter."""
    return docs.select(*keep, F.explode_outer(words).alias("token")).where("token is not null")


# -- vocabulary -----------------------------------------------------------------


def build_vocab(tokens: DataFrame) -> DataFrame:
    """Distinct tokens in sorted order, ids from 4 after the reserved four."""
    distinct = tokens.select("token").distinct()
    p = ordered.positions(distinct, [F.col("token")])
    return p.select("token", (F.col("pos") + X.OFFSET - 1).alias("id"))


def label_ids(rows: DataFrame, label: str, order: str) -> DataFrame:
    """Labels numbered by first appearance along ``order``."""
    first = rows.groupBy(F.col(label).alias("label")).agg(F.min(order).alias("first"))
    p = ordered.positions(first, [F.col("first"), F.col("label")])
    return p.select("label", (F.col("pos") - 1).alias("id"))


def add_tokens(vocab: DataFrame, words: DataFrame) -> DataFrame:
    """Unseen words appended with the next ids."""
    fresh = words.select("token").distinct().join(vocab, "token", "left_anti")
    top = vocab.agg(F.max("id")).scalar()
    p = ordered.positions(fresh, [F.col("token")])
    return p.select("token", (F.col("pos") + top).alias("id"))


def class_counts(tokens: DataFrame, by: str = "token") -> DataFrame:
    return tokens.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def class_weights(counts: DataFrame) -> DataFrame:
    """(largest count / count) ** 0.35 within [1, 10]."""
    top = counts.agg(F.max("n")).scalar()
    w = F.least(F.lit(10.0), F.greatest(F.lit(1.0), F.pow(top / F.col("n"), 0.35)))
    return counts.withColumn("weight", w)


def lookup_ids(tokens: DataFrame, vocab: DataFrame, missing: int = X.UNK) -> DataFrame:
    """Attach ids; the join broadcasts the vocabulary only while it is small."""
    return tokens.join(vocab, "token", "left").withColumn("id", F.coalesce("id", F.lit(missing)))


def encode(docs: DataFrame, words: Column, vocab: DataFrame, key: str, missing: int = X.UNK) -> DataFrame:
    """Token ids per document. Each distinct token of a block of documents is looked up once; the
    documents themselves stay in files until the ids are there."""
    return lists.looked_up(docs, key, words, "token", lambda tokens: lookup_ids(tokens, vocab, missing), "id", "ids")


def decode(encoded: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    def named(ids: DataFrame) -> DataFrame:
        return ids.join(vocab, "id", "left").withColumn("token", F.coalesce("token", F.lit("<UNK>")))

    ids = F.transform("ids", lambda i: F.when(~i.isin(X.PAD, X.BOS, X.EOS), i))
    return lists.looked_up(encoded, key, ids, "id", named, "token", "tokens").select(key, F.array_join("tokens", " ").alias("text"))


def vocab_contiguity(vocab: DataFrame) -> DataFrame:
    return vocab.agg(
        F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count_distinct("id").alias("distinct_ids"),
        (F.max("id") - F.min("id") + 1 - F.count_distinct("id")).alias("missing"),
        (F.count("id") - F.count_distinct("id")).alias("duplicates"), F.count_if(F.col("id") < 0).alias("negative"))


def missing_ids(vocab: DataFrame) -> DataFrame:
    """Ids inside the range that no token has: gaps between neighbours, spelled out."""
    ids = vocab.select("id").distinct()
    after = ids.select((F.col("id") + 1).alias("id")).join(ids, "id", "left_anti")
    before = ids.select((F.col("id") - 1).alias("id")).join(ids, "id", "left_anti")
    # starts and ends of gaps alternate, so equal positions belong together
    a = ordered.positions(after, [F.col("id")], "k").withColumnRenamed("id", "lo")
    b = ordered.positions(before, [F.col("id")], "k").select(
        (F.col("k") - 1).alias("k"), F.col("id").alias("hi"))
    return a.join(b, "k").select(F.explode(F.sequence("lo", "hi")).alias("id"))


def label_collisions(pairs: DataFrame) -> DataFrame:
    """Ids with several strings and strings with several ids."""
    distinct = pairs.select("id", "label").distinct()
    a = distinct.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    b = distinct.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return a.select(F.lit("id").alias("kind"), F.col("id").cast("string").alias("key"), "n").unionByName(
        b.select(F.lit("label").alias("kind"), F.col("label").alias("key"), "n"))


def unk_rate(docs: DataFrame, words: Column, vocab: DataFrame, key: str, source: str) -> DataFrame:
    """Unknown share of tokens and sequences, per source and over all."""
    per = explode_tokens(docs, words, key, source).groupBy(key, source, "token").agg(F.count(F.lit(1)).alias("n"))
    seen = per.join(vocab.select("token", F.lit(1).alias("known")), "token", "left")
    seq = seen.groupBy(key, source).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("u"))
    return seq.rollup(source).agg(
        (F.sum("u") / F.sum("n") * 100).alias("unk_percent"),
        (F.count_if(F.col("u") > 0) / F.count(F.lit(1)) * 100).alias("sequence_percent"),
        F.sum("n").alias("tokens"))


# -- splits, order, leakage -----------------------------------------------------


def rescue_empty_train(rows: DataFrame, key: str) -> DataFrame:
    """If no row is in train, the first row of val (else of test) moves there."""
    counts = rows.agg(F.count_if(F.col("split") == "train").alias("t"),
                      F.min(F.when(F.col("split") == "val", F.col(key))).alias("v"),
                      F.min(F.when(F.col("split") == "test", F.col(key))).alias("e"))
    donor = counts.select(F.when(F.col("t") == 0, F.coalesce("v", "e"))).scalar()
    return rows.withColumn("split", F.when(F.col(key) == donor, "train").otherwise(F.col("split")))


def shuffled(rows: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """Reproducible epoch order: range partitions of a seeded hash, with each row's position in it."""
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed), F.lit(epoch)))
    return ordered.positions(rows.withColumn("__h", h), [F.col("__h"), F.col(key)], "position").drop("__h")


def alternate(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Even positions from ``a``, odd ones from ``b``; the shorter side wraps."""
    pa = ordered.positions(a.select(key), [F.col(key)], "p").withColumn("p", F.col("p") - 1)
    pb = ordered.positions(b.select(key), [F.col(key)], "p").withColumn("p", F.col("p") - 1)
    na, nb = a.agg(F.count(F.lit(1))).scalar(), b.agg(F.count(F.lit(1))).scalar()

    def side(p: DataFrame, parity: int) -> DataFrame:
        own, total = (F.col("na"), F.col("nb")) if parity == 0 else (F.col("nb"), F.col("na"))
        longest = F.greatest(own, total)
        turns = F.sequence(F.lit(0), ((longest - 1 - F.col("p")) / own).cast("bigint"))
        return p.withColumn("na", na).withColumn("nb", nb).withColumn("turn", F.explode(turns)).select(
            ((F.col("p") + F.col("turn") * own) * 2 + parity).alias("position"), F.col(key),
            F.lit("ab"[parity]).alias("side"))

    return side(pa, 0).unionByName(side(pb, 1))


def cross_split_leaks(rows: DataFrame, content: Column) -> DataFrame:
    """Content hashes present in several splits, counted without pairing copies."""
    h = rows.select("split", F.sha2(content, 256).alias("hash"))
    per = h.groupBy("hash").agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")])
    return per.where(((F.col("train") > 0).cast("int") + (F.col("val") > 0).cast("int") + (F.col("test") > 0).cast("int")) > 1)


def shared_hashes(rows: DataFrame, content: Column) -> DataFrame:
    h = rows.select("split", F.md5(content).alias("hash"))
    return h.where("split = 'train'").select("hash").intersect(h.where("split = 'val'").select("hash"))


def shingles(words: Column, n: int) -> Column:
    """Distinct word n-grams of a text of any length."""
    def of(w):
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - F.lit(n - 1))).otherwise(
            F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " ")))

    return let(words, of)


def near_duplicate_leaks(docs: DataFrame, items: DataFrame, doc_words: Column, item_words: Column,
                         n: int = 8, share: float = 0.5) -> DataFrame:
    """Documents holding at least ``share`` of an item's word n-grams.

    The item side is fixed by the evaluation set; documents meet it on n-grams that
    occur there, so pairs exist only where text is shared. N-grams travel as two
    64-bit hashes, never as text.
    """
    names = ["g0", "g1"]

    def grams(rows: DataFrame, key: str, words: Column) -> DataFrame:
        g = rows.select(key, F.explode_outer(shingles(words, n)).alias("g")).where("g is not null")
        return g.select(key, *[F.xxhash64("g", F.lit(i)).alias(c) for i, c in enumerate(names)])

    i = grams(items, "item_id", item_words)
    size = i.groupBy("item_id").agg(F.count(F.lit(1)).alias("of"))
    hits = grams(docs, "doc_id", doc_words).join(i, names).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("common"))
    return hits.join(size, "item_id").where(F.col("common") >= share * F.col("of")).select(
        "doc_id", "item_id", "common", (F.col("common") / F.col("of")).alias("share"))


# -- audits ---------------------------------------------------------------------


def corpus_audit(rows: DataFrame) -> DataFrame:
    """Per source and overall: rows, mean quality, mean weight."""
    return rows.rollup("source").agg(
        F.count(F.lit(1)).alias("n"), F.avg("quality").alias("avg_quality"), F.avg("weight").alias("avg_weight"))


def rejection_rate(attempted: DataFrame, accepted: DataFrame) -> DataFrame:
    a = attempted.groupBy("source").agg(F.count(F.lit(1)).alias("attempted"))
    b = accepted.groupBy("source").agg(F.count(F.lit(1)).alias("accepted"))
    j = a.join(b, "source", "full_outer").na.fill(0, ["attempted", "accepted"])
    rejected = F.greatest(F.lit(0), F.col("attempted") - F.col("accepted"))
    return j.withColumn("rejected_percent", rejected / F.greatest(F.lit(1), F.col("attempted")) * 100)


def sanitize_weight(w: Column, quality: Column, floor: float = 0.25) -> Column:
    bad = w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")) | (w < 0)
    return F.when(bad, 0.0).otherwise(F.greatest(F.lit(floor), F.least(F.lit(1.0), quality)))


def weight_audit(rows: DataFrame, keys: list[str]) -> DataFrame:
    w = F.col("weight")
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(w).alias("min_w"), F.max(w).alias("max_w"), F.avg(w).alias("mean_w"),
        F.count_if(w == 0).alias("zeros"), F.count_if(w < 0).alias("negatives"), F.count_if(F.isnan(w)).alias("nans"),
        F.count_if(F.abs(w) == float("inf")).alias("infs"))
    q = ordered.exact_quantiles(rows.select(*keys, "weight"), keys, "weight",
                                {"p1": 0.01, "median_w": 0.5, "p99": 0.99})
    return base.join(q, keys, "left")


def weight_correlation(rows: DataFrame, label: str) -> DataFrame:
    freq = rows.groupBy(label).agg(F.count(F.lit(1)).alias("frequency"))
    return rows.join(freq, label).groupBy("source").agg(
        F.corr("weight", "frequency").alias("with_frequency"), F.corr("weight", "length").alias("with_length"))


def truncation_audit(rows: DataFrame, limits: list[int]) -> DataFrame:
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.max("length").alias("longest"), F.avg("length").alias("mean_length"),
        *[e for k in limits for e in (
            F.count_if(F.col("length") > k).alias(f"over_{k}"),
            (F.count_if(F.col("length") > k) / F.count(F.lit(1)) * 100).alias(f"percent_over_{k}"))])


def length_distribution(rows: DataFrame, fields: dict[str, int], key: str = "source") -> DataFrame:
    """Per key, over all, and per field: rows, rows over the field's limit, and exact quantiles of original and stored lengths.

    ``fields`` maps a length column to its limit; the stored length is cut at the limit. All fields pass through one
    histogram of (key, field, length), which is what the quantiles are read from, so a key with most of the rows is a few
    counts and the rows themselves are never sorted. Null lengths count as rows of no length. ``grouped`` is 0 in the row over all.
    """
    limit = F.col("limit")
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).cast("long").alias("limit"), F.col(f).cast("long").alias("length"))
                            for f, k in fields.items()])
    h = rows.select(key, F.explode(each).alias("e")).select(key, "e.*").groupBy(key, "field", "limit", "length").agg(F.count(F.lit(1)).alias("n"))
    full = ["field", "limit", "length"]
    h = h.groupingSets([[F.col(c) for c in (key, *full)], [F.col(c) for c in full]], key, *full).agg(F.sum("n").alias("n"), F.grouping(key).alias("__all"))
    cells = h.withColumn("stored", F.least("length", limit)).withColumn("grouped", 1 - F.col("__all").cast("int"))
    at = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    quantiles = lambda c: [F.percentile(c, F.lit(q), F.col("n")).alias(f"{c}_{p}") for p, q in at.items()]
    return cells.groupBy(key, "grouped", "field", "limit").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("length") > limit, F.col("n"))), F.lit(0)).alias("truncated"), F.max("length").alias("longest"),
        *quantiles("length"), *quantiles("stored"))


def frequency_band(n: Column) -> Column:
    """How often a word or class occurs, by powers of ten: 0 for 1-9, 1 for 10-99 and so on."""
    return F.length(n.cast("string")) - 1


def unk_by_frequency(docs: DataFrame, words: Column, vocab: DataFrame) -> DataFrame:
    """Unknown share of words and of their occurrences per frequency band of the word, over all documents."""
    counts = docs.select(F.explode(words).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    j = counts.join(vocab.select("token", F.lit(1).alias("known")).distinct(), "token", "left")
    unknown = F.col("known").isNull()
    return j.groupBy(frequency_band(F.col("n")).alias("band")).agg(
        F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens"), (F.count_if(unknown) / F.count(F.lit(1)) * 100).alias("unk_words_percent"),
        (F.sum(F.when(unknown, F.col("n")).otherwise(0)) / F.sum("n") * 100).alias("unk_percent"))


def coverage_by_frequency(classes: DataFrame, lexicon: DataFrame, key: str, top: int = 100) -> DataFrame:
    """Share of classes with lexicon attributes per frequency band, and among the ``top`` most frequent (ties by key).

    ``classes`` holds counts ``n`` per class and possibly source; a class is counted once, with all its rows.
    """
    n = classes.groupBy(key).agg(F.sum("n").alias("n"))
    j = n.join(lexicon.select(key, F.lit(1).alias("known")).distinct(), key, "left")
    facts = [F.count(F.lit(1)).alias("classes"), F.count("known").alias("covered"), (F.count("known") / F.count(F.lit(1)) * 100).alias("percent")]
    bands = j.groupBy(frequency_band(F.col("n")).alias("band")).agg(*facts).select(F.format_string("10^%d", "band").alias("part"), "classes", "covered", "percent")
    best = j.orderBy(F.desc("n"), key).limit(top).agg(*facts).select(F.lit(f"top {top}").alias("part"), "classes", "covered", "percent")
    return bands.unionByName(best)


def coverage(classes: DataFrame, lexicon: DataFrame, key: str) -> DataFrame:
    """Share of classes with lexicon attributes, per source and over all."""
    j = classes.join(lexicon.select(key, F.lit(1).alias("known")).distinct(), key, "left")
    return j.rollup("source").agg(
        F.count(F.lit(1)).alias("classes"), F.count("known").alias("covered"),
        (F.count("known") / F.count(F.lit(1)) * 100).alias("percent"),
        (F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)) / F.sum("n") * 100).alias("weighted_percent"))


def shard_mix(rows: DataFrame, part: str = "task") -> DataFrame:
    """Share of each task (or source, or validity) per shard and its distance from the global share."""
    cells = rows.groupBy("shard", part).agg(F.count(F.lit(1)).alias("n"))
    shard = cells.groupBy("shard").agg(F.sum("n").alias("of"))
    task = cells.groupBy(part).agg(F.sum("n").alias("all"))
    total = cells.agg(F.sum("n")).scalar()
    return cells.join(shard, "shard").join(task, part).select(
        "shard", part, (F.col("n") / F.col("of") * 100).alias("percent"),
        (F.col("n") / F.col("of") * 100 - F.col("all") / total * 100).alias("deviation"))


def shard_mixes(rows: DataFrame, parts: list[str], workers: int) -> DataFrame:
    """Shares of every value of all ``parts`` per shard and per worker (shard modulo ``workers``), from one scan.

    One row per (level, number, part, value) that occurs, with its share there, its global share and the distance of the two.
    """
    level = F.explode(F.array(F.struct(F.lit("shard").alias("level"), F.col("shard").cast("long").alias("number")),
                              F.struct(F.lit("worker").alias("level"), F.pmod("shard", F.lit(workers)).cast("long").alias("number")),
                              F.struct(F.lit("all").alias("level"), F.lit(None).cast("long").alias("number"))))
    value = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.coalesce(F.col(p).cast("string"), F.lit("none")).alias("value")) for p in parts]))
    # shards meet their counts first, so levels and parts multiply cells and not rows
    cells = rows.groupBy("shard", *parts).agg(F.count(F.lit(1)).alias("n")).select("n", "shard", *parts, level.alias("l")).select("n", "l.*", value.alias("v"))
    cells = cells.groupBy("level", "number", "v.part", "v.value").agg(F.sum("n").alias("n"))
    of = cells.groupBy("level", "number", "part").agg(F.sum("n").alias("of"))
    there = ordered._join_on(cells, of, ["level", "number", "part"]).withColumn("percent", F.col("n") / F.col("of") * 100)
    whole = there.where("level = 'all'").select("part", "value", F.col("percent").alias("overall"))
    return there.where("level <> 'all'").join(whole, ["part", "value"]).select(
        "level", "number", "part", "value", "n", "percent", (F.col("percent") - F.col("overall")).alias("deviation"))


def feature_schema_audit(rows: DataFrame) -> DataFrame:
    f = F.col("features")
    return rows.groupBy("source", F.size(f).alias("width")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size(f) == 0).alias("empty"),
        F.count_if(F.exists(f, lambda x: F.isnan(x))).alias("with_nan"),
        F.count_if(F.exists(f, lambda x: F.abs(x) == float("inf"))).alias("with_inf"))


def clip_schema_audit(clips: DataFrame, least: int, expected: int) -> DataFrame:
    """Per source, task and width: clips, those without, with one and with fewer than ``least`` frames, ragged, NaN and infinite ones.

    ``clips`` has source, task and frames (array of arrays). The width of a clip is that of its frames; clips whose
    frames differ, or that have a null frame, are ``ragged`` and have no width, like clips without frames. ``action`` is
    what a loader with ``expected`` channels would do: keep, cut, pad, or nothing to read.
    """
    f = F.col("frames")
    sizes = F.transform(f, lambda x: F.when(x.isNotNull(), F.size(x)))
    shape = clips.withColumn("__t", F.coalesce(F.when(f.isNotNull(), F.size(f)), F.lit(0))).withColumn("__lo", F.array_min(sizes)).withColumn("__hi", F.array_max(sizes))
    ragged = F.coalesce((F.col("__lo") != F.col("__hi")) | F.exists(f, lambda x: x.isNull()), F.lit(False))
    any_of = lambda test: F.coalesce(F.exists(f, lambda x: F.coalesce(F.exists(x, test), F.lit(False))), F.lit(False))
    width = F.when(~ragged & (F.col("__t") > 0), F.col("__lo"))
    action = F.when(width.isNull() | (width == 0), "none").when(width > expected, "cut").when(width < expected, "pad").otherwise("keep")
    return shape.groupBy("source", "task", width.alias("width"), action.alias("action")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("__t") == 0).alias("no_frame"), F.count_if(F.col("__t") == 1).alias("one_frame"),
        F.count_if(F.col("__t") < least).alias("too_short"), F.count_if(ragged).alias("ragged"), F.count_if(any_of(F.isnan)).alias("with_nan"),
        F.count_if(any_of(lambda x: F.abs(x) == float("inf"))).alias("with_inf"))


def attribute_id_stability(rows: DataFrame) -> DataFrame:
    d = rows.select("attribute", "id").distinct()
    return d.groupBy("attribute").agg(F.count(F.lit(1)).alias("ids")).where("ids > 1")


def charset_audit(encoded: DataFrame) -> DataFrame:
    i = encoded.select(F.explode_outer("ids").alias("id"))
    return i.agg(
        F.count("id").alias("n"), F.count_if((F.col("id") < 0) | (F.col("id") >= 42)).alias("out_of_range"),
        F.count_if(F.col("id") == X.SPACE_ID).alias("spaces"), F.count_if(F.col("id").between(31, 40)).alias("digits"),
        F.count_if(F.col("id").between(5, 30)).alias("letters"))


def per_class_cap(rows: DataFrame, cls: str, order: str, n: int) -> DataFrame:
    """First n rows of each class; Spark trims each class before the shuffle."""
    w = Window.partitionBy(cls).orderBy(order)
    return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def curriculum_subset(rows: DataFrame, order: list[Column], stage: int) -> DataFrame:
    """First 33 %, 66 % or all rows by difficulty, at least ten."""
    share = {1: 0.33, 2: 0.66, 3: 1.0}[stage]
    n = rows.agg(F.count(F.lit(1))).scalar()
    p = ordered.positions(rows, order).withColumn("__n", n)
    return p.where(F.col("pos") <= F.greatest(F.lit(10), F.floor(F.col("__n") * share))).drop("__n")


def stitch(clips: DataFrame, k: int, seed: int, limit: int, pause: int = 4) -> DataFrame:
    """Concatenate clips(clip_id, length, text, ids, weight) in seeded groups of k.

    Groups hold at most ``k`` clips: positions along a seeded hash, cut every k. Clips that begin within ``limit`` frames
    stay, and everything in the row is of those; the last one is cut at the limit. A text that lacks a final mark gets
    a full stop.
    """
    h = F.xxhash64(F.col("clip_id"), F.lit(seed))
    p = ordered.positions(clips.withColumn("__h", h), [F.col("__h"), F.col("clip_id")])
    p = p.withColumn("group_id", F.floor((F.col("pos") - 1) / k))
    w = Window.partitionBy("group_id").orderBy("pos")
    p = p.withColumn("start", F.coalesce(F.sum(F.col("length") + pause).over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    p = p.where(F.col("start") < limit)
    g = p.groupBy("group_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "clip_id", "start", "text", "ids"))).alias("m"),
        (F.sum("length") + (F.count(F.lit(1)) - 1) * pause).alias("frames"), F.avg("weight").alias("weight"))
    single = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))
    texts = F.filter(F.transform("m", lambda s: single(s["text"])), lambda t: t != "")
    texts = F.transform(texts, lambda t: F.when(t.rlike("[.!?]$"), t).otherwise(F.concat(t, F.lit("."))))
    ids = F.concat(F.array(F.lit(X.BOS)), F.flatten(F.transform("m", lambda s: s["ids"])), F.array(F.lit(X.EOS)))
    return g.select(
        "group_id", F.transform("m", lambda s: s["clip_id"]).alias("clips"),
        F.transform("m", lambda s: s["start"]).alias("starts"), F.least(F.col("frames"), F.lit(limit)).alias("frames"),
        F.array_join(texts, " ").alias("text"), ids.alias("ids"), "weight")


def merge_adjacent(rows: DataFrame, max_k: int, max_len: int, period: int) -> DataFrame:
    """Odd rows of rows(idx, n, ids) take in the next 2..max_k rows, wrapping.

    A row joins while the merged ids stay within ``max_len``; a later, shorter row
    may still fit, so the running length is folded over at most max_k rows.
    """
    k = F.lit(2) + F.col("idx") % max(1, max_k - 1)
    want = rows.where(F.col("idx") % 2 == 1).select(
        "idx", F.explode(F.sequence(F.lit(0), (k - 1).cast("int"))).alias("off"), "n").select(
        "idx", "off", F.pmod(F.col("idx") + F.col("off"), F.col("n")).alias("src"))
    parts = want.join(rows.select(F.col("idx").alias("src"), "ids"), "src").groupBy("idx").agg(
        F.array_sort(F.collect_list(F.struct("off", "ids"))).alias("m"))

    def take(acc, s):
        fits = F.size(acc) + F.size(s["ids"]) + 2 <= max_len
        grown = F.concat(acc, s["ids"])
        dotted = F.when(F.element_at(grown, -1) == period, grown).otherwise(F.concat(grown, F.array(F.lit(period).cast("bigint"))))
        return F.when(fits, dotted).otherwise(acc)

    merged = F.aggregate("m", F.array(F.lit(X.BOS).cast("bigint")), take)
    return parts.select("idx", F.slice(F.concat(merged, F.array(F.lit(X.EOS).cast("bigint"))), 1, max_len).alias("ids"))

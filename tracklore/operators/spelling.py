"""Dictionary lookup, correction, completion and segmentation of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklore.functions import edit
from tracklore.functions.text import CONVERSATION_PAIRS, CONVERSATION_WORDS
from tracklore.session import spread, written

EDITS = 2
TOP = 12
CROWD = 64  # dictionary words under one key before the rest of them is cut again

# -- dictionary words within two edits ------------------------------------------


def _segment(length: Column, edits: Column, i: Column) -> tuple[Column, Column]:
    """Place (from 0) and letters of even segment i of a piece; one more segment than edits, the longer ones last."""
    short, more = F.floor(length / (edits + 1)).cast("int"), length % (edits + 1)
    behind = i - (edits + 1 - more)  # of the first longer segment
    return short * i + F.greatest(behind, F.lit(0)), short + (behind >= 0).cast("int")


def _rest(length: Column, edits: Column, i: Column, at: Column, n: Column) -> tuple[Column, Column, Column]:
    """What to cut next beside a segment that agrees: (is it the right side, its length, its edits).

    Left of segment i at most i edits are left to make, right of it the others; the side that gives longer segments is taken.
    """
    right = length - at - n
    after = right * (i + 1) >= at * (edits - i + 1)
    return after, F.when(after, right).otherwise(at), F.when(after, edits - i).otherwise(i)


def _indexed(d: DataFrame) -> DataFrame:
    """Each dictionary piece (term, ctx, at, length, edits) under the key of each of its segments, with what is left of it."""
    d = d.withColumn("i", F.explode(F.array(*map(F.lit, range(EDITS + 1))))).where("i <= edits")
    at, n = _segment(F.col("length"), F.col("edits"), F.col("i"))
    d = d.withColumn("_at", at).withColumn("_n", n)
    after, length, edits = _rest(*map(F.col, ("length", "edits", "i", "_at", "_n")))
    key = F.xxhash64("ctx", "i", F.substring("term", F.col("at") + F.col("_at") + 1, F.col("_n")))
    return d.select("term", "freq", key.alias("key"), F.when(after, F.col("at") + F.col("_at") + F.col("_n")).otherwise(F.col("at")).alias("at"),
                    length.alias("length"), edits.alias("edits"))


def _probes(q: DataFrame) -> DataFrame:
    """Each query piece under the keys it can share with a dictionary piece of `length`.

    A segment that agrees is displaced by at most the edits before it, and by the difference of lengths less those behind it.
    """
    moves = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(m).alias("m")) for i in range(EDITS + 1) for m in range(-i, i + 1)))
    gap = F.col("own") - F.col("length")
    q = q.withColumn("_c", F.explode(moves)).select("*", "_c.i", "_c.m").where(F.col("edits") - F.col("i") >= F.abs(F.col("m") - gap))
    at, n = _segment(F.col("length"), F.col("edits"), F.col("i"))
    q = q.withColumn("_at", at).withColumn("_n", n).withColumn("_begin", F.col("_at") + F.col("m")).where("_begin >= 0 and _begin + _n <= own")
    after, length, edits = _rest(*map(F.col, ("length", "edits", "i", "_at", "_n")))
    key = F.xxhash64("ctx", "i", F.substring("word", F.col("at") + F.col("_begin") + 1, F.col("_n")))
    end = F.col("_begin") + F.col("_n")
    return q.select("word", key.alias("key"), F.when(after, F.col("at") + end).otherwise(F.col("at")).alias("at"),
                    F.when(after, F.col("own") - end).otherwise(F.col("_begin")).alias("own"), length.alias("length"), edits.alias("edits"))


def near_pairs(words: DataFrame, unigrams: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(word, term, freq, distance) of all dictionary words within two edits of words(word), each pair once.

    Segment index: a dictionary word is cut into three even segments; a word within two edits shares one of them at an
    admissible place. Both sides meet on (length, segment, text). A key that more than `crowd` dictionary words share, such
    as the beginning of addresses, is no reason to compare: what is left beside it, and the edits left for that, is cut
    and looked up again, until the words part or nothing can be cut.
    """
    d = written(unigrams.select(F.col("word").alias("term"), "freq").where("term is not null"))
    n = F.char_length("term")
    d = d.select("term", "freq", F.xxhash64(n).alias("ctx"), F.lit(0).alias("at"), n.alias("length"), F.lit(EDITS).alias("edits"))
    q = spread(written(words.select("word").where("word is not null").distinct()), "word").withColumn("own", F.char_length("word"))
    q = q.withColumn("length", F.explode(F.sequence(F.greatest(F.col("own") - EDITS, F.lit(0)), F.col("own") + EDITS)))
    q = q.select("word", F.xxhash64("length").alias("ctx"), F.lit(0).alias("at"), "own", "length", F.lit(EDITS).alias("edits"))
    whole = F.col("length") > F.col("edits")  # else no segment of each would have a letter
    pairs = q.where(~whole).join(d.where(~whole).select("term", "freq", "ctx"), "ctx").select("word", "term", "freq")
    d, q = d.where(whole), q.where(whole)
    while True:
        d, q = _indexed(d), _probes(q)
        crowded = written(d.where(whole).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key"))
        if crowded.isEmpty():
            pairs = pairs.unionByName(q.select("word", "key").join(d.select("term", "freq", "key"), "key").drop("key"))
            break
        few_d, few_q = (x.join(crowded, "key", "left_anti") for x in (d, q))
        pairs = pairs.unionByName(few_q.select("word", "key").join(few_d.select("term", "freq", "key"), "key").drop("key"))
        d = written(d.join(crowded, "key", "left_semi").withColumnRenamed("key", "ctx"))
        q = written(q.join(crowded, "key", "left_semi").distinct().withColumnRenamed("key", "ctx"))
    near = pairs.withColumn("distance", F.levenshtein("word", "term", EDITS)).where("distance >= 0")
    return near.dropDuplicates(["word", "term"])


def candidates(words: DataFrame, unigrams: DataFrame, top: int = TOP) -> DataFrame:
    """Dictionary words within two edits of words(word), nearest and commonest first."""
    w = Window.partitionBy("word").orderBy("distance", F.desc("freq"), "term")
    ranked = near_pairs(words, unigrams).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= top).select("word", "term", "freq", "distance", "rank")


# -- correction -----------------------------------------------------------------


def scored_candidates(words: DataFrame, unigrams: DataFrame, boosted: dict[str, int] = CONVERSATION_WORDS) -> DataFrame:
    """Candidates with their cost: fingerspelling edits less a share of the frequency; words of conversation have a fixed one."""
    c = spread(candidates(words, unigrams), "word", "term")
    usual = F.try_element_at(F.create_map(*(F.lit(x) for pair in boosted.items() for x in pair)), F.col("term")) if boosted else F.lit(None).cast("long")
    return c.withColumn("score", edit.spelling_distance("word", "term") + _share(F.coalesce(usual, F.col("freq"))))


def _share(freq: Column) -> Column:
    return -F.log10(F.greatest(F.lit(10), freq)) * 0.25


def _bonus(bigrams: DataFrame, pairs: tuple = CONVERSATION_PAIRS) -> DataFrame:
    """w1, w2, bonus: 3 for a pair of conversation, else a share of the pair's frequency."""
    known = bigrams.select("w1", "w2", _share(F.col("freq")).alias("bonus"))
    if not pairs:
        return known
    usual = bigrams.sparkSession.createDataFrame([p.split() for p in pairs], "w1 string, w2 string").withColumn("bonus", F.lit(-3.0))
    return known.unionByName(usual).groupBy("w1", "w2").agg(F.min("bonus").alias("bonus"))


def settled(w: Column, prev: Column, names: Column) -> Column:
    """What a word becomes without a look at the dictionary, else null: protected names and single letters stay, short forms
    follow the word before (null at the start)."""
    return (
        F.when(F.array_contains(names, w), w)
        .when((w == "u") & prev.isin("can", "thank", "love", "see", "meet", "how", "are"), "you")
        .when((w == "r") & prev.isin("you", "they", "we"), "are")
        .when(w.isin("i", "1", "l") & (prev.isNull() | prev.isin("and", "that", "so", "but")), "i")
        .when(F.char_length(w) <= 1, w))


def correct_words(rows: DataFrame, unigrams: DataFrame, bigrams: DataFrame, names: list[str]) -> DataFrame:
    """Best candidate of rows(key, word, prev): settled words, else the lowest cost with the word before as context."""
    c = scored_candidates(rows, unigrams).select("word", "term", "score", "rank")
    asked = rows.select("word", "prev").distinct()
    j = asked.join(c, "word", "left").join(_bonus(bigrams).toDF("prev", "term", "bonus"), ["prev", "term"], "left")
    total = F.round(F.col("score") + F.coalesce("bonus", F.lit(0.0)), 9)
    best = j.groupBy("word", "prev").agg(F.min_by("term", F.struct(total, "rank")).alias("_best"))
    out = rows.alias("r").join(best.alias("b"), (F.col("r.word") == F.col("b.word")) & F.col("r.prev").eqNullSafe(F.col("b.prev")))
    w, p = F.col("r.word"), F.col("r.prev")
    protected = F.array(*map(F.lit, names)).cast("array<string>")
    return out.select("r.key", "r.word", "r.prev", F.coalesce(settled(w, p, protected), F.col("_best"), w).alias("corrected"))


def correct_phrases(tokens: DataFrame, unigrams: DataFrame, bigrams: DataFrame, key: str, names: list[str] = (),
                    lexicon: DataFrame | None = None) -> DataFrame:
    """Left-to-right correction of tokens(key, pos, word), each choice the context of the next.

    A word's usual choice is made once for each distinct word, and one for each word before it whose bonus turns it. A bonus never
    costs, so only a candidate with one can take the place of the usual choice. What may turn a token is joined to it for each
    distinct pair of neighbours, and the fold looks it up. Names and short forms are settled as for single words;
    lexicon(key, names) adds names of a phrase's own.
    """
    protected = F.array(*map(F.lit, names)).cast("array<string>")
    c = written(scored_candidates(tokens.select("word"), unigrams).groupBy("word").agg(
        F.array_sort(F.collect_list(F.struct("rank", "term", "score"))).alias("c")))
    usual = F.array_min(F.transform("c", lambda x: F.struct(F.round(x["score"], 9).alias("total"), x["rank"].alias("rank"), x["term"].alias("term"))))
    c = c.withColumn("best", usual).select("word", "c", F.struct("best.total", "best.rank").alias("least"), F.col("best.term").alias("usual"))
    w = Window.partitionBy(key).orderBy("pos")
    t = spread(tokens, key).select(key, "pos", "word", F.lag("word").over(w).alias("before"))
    # a word can come out as one of its candidates, as itself or as a short form written out
    terms = c.select("word", F.explode("c").alias("s"), "least", "usual").select(
        "word", F.col("s.term").alias("w"), F.col("s.rank").alias("rank"), F.col("s.score").alias("score"), "least", "usual")
    near = t.where("before is not null").select("before", "word").distinct()
    forms = F.explode(F.array(F.col("before"), F.lit("you"), F.lit("are"), F.lit("i"))).alias("w1")
    first = near.select("before", forms).where("w1 = before or before in ('u', 'r', 'i', '1', 'l')")
    first = first.unionByName(terms.select(F.col("word").alias("before"), F.col("w").alias("w1"))).distinct()
    cost = F.struct(F.round(F.col("score") + F.col("bonus"), 9).alias("total"), "rank")
    helped = terms.withColumnRenamed("w", "w2").join(_bonus(bigrams), "w2").withColumn("cost", cost).groupBy("word", "w1").agg(
        F.min_by("w2", "cost").alias("term"), F.min("cost").alias("cost"), F.first("least").alias("least"), F.first("usual").alias("usual"))
    turned = F.when((F.col("cost") <= F.col("least")) & (F.col("term") != F.col("usual")), F.struct("w1", "term"))
    maps = near.join(first, "before").join(helped.select("word", "w1", turned.alias("turned")), ["word", "w1"]).groupBy("before", "word").agg(
        F.min("w1").alias("lead"), F.collect_list("turned").alias("bg"))  # lead: the order of tokens at one place
    full = t.join(c.select("word", "usual"), "word", "left").join(maps, ["before", "word"], "left")
    rows = full.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "word", "usual", "lead", "bg"))).alias("p"))

    def step(acc, s):
        prev = F.get(acc, F.size(acc) - 1)
        by_bonus = F.get(F.filter(s["bg"], lambda e: e["w1"] == prev), F.lit(0))["term"]
        return F.concat(acc, F.array(F.coalesce(settled(s["word"], prev, F.col("names")), by_bonus, s["usual"], s["word"])))

    start = F.array().cast("array<string>")
    rows = rows.withColumn("names", protected)
    if lexicon is not None:
        own = lexicon.select(key, F.col("names").alias("_own"))
        rows = rows.join(own, key, "left").withColumn("names", F.concat("names", F.coalesce("_own", F.array().cast("array<string>"))))
    return rows.select(key, F.aggregate("p", start, step).alias("words"))


def complete(prefixes: DataFrame, unigrams: DataFrame, k: int = 5) -> DataFrame:
    """The k commonest words under each prefix: words meet prefixes on equal text."""
    lengths = prefixes.select(F.char_length("prefix").alias("n")).distinct()
    keyed = unigrams.withColumn("n", F.explode_outer(F.sequence(F.lit(1), F.char_length("word")))).join(
        lengths, "n", "left_semi").withColumn("prefix", F.substr("word", F.lit(1), F.col("n")))
    w = Window.partitionBy("prefix").orderBy(F.desc("freq"), "word")
    hits = keyed.join(prefixes.distinct(), "prefix", "left_semi")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "prefix", "rank", "word", "freq")


def known_prefixes(prefixes: DataFrame, unigrams: DataFrame) -> DataFrame:
    """Prefixes that start a word, and whether they are words themselves."""
    starts = unigrams.select(F.explode_outer(F.transform(
        F.sequence(F.lit(1), F.char_length("word")), lambda i: F.substr("word", F.lit(1), i))).alias("prefix")).distinct()
    is_word = unigrams.select(F.col("word").alias("prefix"), F.lit(True).alias("w"))
    return prefixes.distinct().join(starts, "prefix", "left_semi").join(is_word, "prefix", "left").select(
        "prefix", F.coalesce("w", F.lit(False)).alias("is_word"))


# fixed values: sentences that give a name, and how they are told
INTRODUCTIONS = (
    (r"^(?:hello|hi)?\s*,?\s*my name is\s+([A-Za-z]+)$", "Xin chào, tên {sp} là {name}."),
    (r"^my name is\s+([A-Za-z]+)$", "Tên của {sp} là {name}."),
)
SPEAKER, LISTENER = "tôi", "bạn"


def translate(sentences: DataFrame, key: str, text: str, words: DataFrame, phrases: DataFrame, names: str | None = None,
              patterns: tuple = INTRODUCTIONS, speaker: str = SPEAKER, listener: str = LISTENER) -> DataFrame:
    """Sentences that give a name by pattern, whole phrases by table, else word by word; unknown words stay as written.

    Words of the array column ``names`` (lower case) are kept with a capital. {sp} and {lp} in a translation become the
    pronouns of speaker and listener.
    """
    raw = F.trim(F.regexp_replace(F.trim(F.col(text)), r"[.?!]+$", ""))
    said = lambda c: F.replace(F.replace(c, F.lit("{sp}"), F.lit(speaker)), F.lit("{lp}"), F.lit(listener))
    own = F.col(names) if names else F.array().cast("array<string>")
    s = sentences.select(key, raw.alias("raw"), F.trim(F.col(text)).endswith("?").alias("asks"), own.alias("own"))
    told = F.lit(None).cast("string")
    for regex, form in reversed(patterns):
        name = F.initcap(F.regexp_extract(F.lower("raw"), regex, 1))
        told = F.when(F.lower("raw").rlike(regex), F.replace(said(F.lit(form)), F.lit("{name}"), name)).otherwise(told)
    s = s.withColumn("told", told)
    s = s.join(phrases.select(F.col("phrase").alias("raw_l"), said(F.col("translation")).alias("whole")),
               F.lower("raw") == F.col("raw_l"), "left").drop("raw_l")
    w = s.where("whole is null and told is null").select(key, "own", F.posexplode_outer(F.split("raw", r"[ \t\n\r]+")).alias("pos", "w"))
    w = w.select(key, "own", "pos", F.regexp_replace("w", r"[^\p{L}\p{N}_]", "").alias("w"))
    j = w.join(words.select(F.col("word").alias("wl"), said(F.col("translation")).alias("t")), F.lower("w") == F.col("wl"), "left")
    kept = F.when(F.array_contains("own", F.lower("w")), F.initcap(F.lower("w")))
    built = j.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "pos", F.coalesce(kept, "t", "w").alias("t")))), lambda x: x["t"]), " ").alias("joined"))
    out = s.join(built, key, "left").withColumn("out", F.coalesce("whole", "joined"))
    return out.select(key, F.when(F.col("told").isNotNull(), F.col("told")).when(F.col("out") == "", "").otherwise(F.concat(
        F.upper(F.substring("out", 1, 1)), F.substr("out", F.lit(2)), F.when(F.col("asks"), "?").otherwise("."))).alias("translated"))

"""Scores of predicted token sequences and class labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklore.functions import edit
from tracklore.functions import vectors as V
from tracklore.session import spread


def _rate(part: Column, whole: Column) -> Column:
    return part / F.greatest(F.lit(1), whole) * 100.0


def error_rates(pairs: DataFrame, ref: Column, hyp: Column) -> DataFrame:
    """Pooled substitution, deletion and insertion rates over all pairs."""
    ops = spread(pairs).select(F.size(ref).alias("n"), edit.edit_ops(ref, hyp).alias("o"))
    sums = ops.agg(
        F.sum("o.s").alias("s"), F.sum("o.d").alias("d"), F.sum("o.i").alias("i"),
        F.sum("n").alias("ref_tokens"),
    )
    n = F.col("ref_tokens")
    return sums.select(
        _rate(F.col("s") + F.col("d") + F.col("i"), n).alias("error_rate"),
        _rate(F.col("s"), n).alias("sub_rate"), _rate(F.col("d"), n).alias("del_rate"),
        _rate(F.col("i"), n).alias("ins_rate"), "ref_tokens",
    )


def characters(col: str) -> Column:
    return F.filter(F.split(F.lower(F.col(col)), ""), lambda c: c != "")


def cer_total(pairs: DataFrame) -> DataFrame:
    """Character error rate alone: the built-in distance, no Python."""
    sums = pairs.agg(
        F.sum(F.levenshtein(F.lower("ref"), F.lower("hyp"))).alias("edits"),
        F.sum(F.char_length(F.lower("ref"))).alias("ref_chars"),
    )
    return sums.withColumn("cer", _rate(F.col("edits"), F.col("ref_chars")))


def _ngrams(tokens: str, max_n: int) -> Column:
    t = F.col(tokens)

    def of(n: int) -> Column:
        starts = F.when(
            F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - F.lit(n - 1))
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(
            F.lit(n).alias("n"), F.array_join(F.slice(t, i, F.lit(n)), "\u0001").alias("g")))

    return F.flatten(F.array(*[of(n) for n in range(1, max_n + 1)]))


def bleu(pairs: DataFrame, key: list[str], ref: Column, hyp: Column, max_n: int = 4) -> DataFrame:
    """Corpus BLEU-1..max_n in percent; n-grams are counted per pair, then clipped."""
    toks = pairs.select(*key, ref.alias("r"), hyp.alias("h"))
    grams = toks.select(
        *key, F.explode_outer(_ngrams("r", max_n)).alias("x"), F.lit(1).alias("in_r"), F.lit(0).alias("in_h")
    ).unionByName(toks.select(
        *key, F.explode_outer(_ngrams("h", max_n)).alias("x"), F.lit(0).alias("in_r"), F.lit(1).alias("in_h")
    ))
    counts = grams.where("x is not null").groupBy(*key, "x.n", "x.g").agg(
        F.sum("in_r").alias("r"), F.sum("in_h").alias("h")
    )
    sums = counts.agg(*[
        e for n in range(1, max_n + 1) for e in (
            F.coalesce(F.sum(F.when(F.col("n") == n, F.least("r", "h"))), F.lit(0)).alias(f"m{n}"),
            F.coalesce(F.sum(F.when(F.col("n") == n, F.col("h"))), F.lit(0)).alias(f"t{n}"),
        )],
        F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("r"))), F.lit(0)).alias("ref_len"),
        F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("h"))), F.lit(0)).alias("hyp_len"),
    )
    bp = (
        F.when(F.col("hyp_len") == 0, 0.0)
        .when(F.col("hyp_len") < F.col("ref_len"), F.exp(1 - F.col("ref_len") / F.col("hyp_len")))
        .otherwise(1.0)
    )
    p = [F.col(f"m{n}") / F.greatest(F.lit(1), F.col(f"t{n}")) for n in range(1, max_n + 1)]
    scores = []
    for n in range(1, max_n + 1):
        used = p[:n]
        low = used[0] if n == 1 else F.least(*used)
        mean_log = sum((F.log(x) for x in used[1:]), F.log(used[0])) / n
        scores.append(F.when(low == 0, 0.0).otherwise(bp * F.exp(mean_log) * 100).alias(f"bleu_{n}"))
    return sums.select(*scores)


def rouge_l(pairs: DataFrame, ref: Column, hyp: Column) -> DataFrame:
    """Mean F1 of the longest common subsequence, in percent."""
    scored = spread(pairs).select(
        F.size(ref).alias("m"), F.size(hyp).alias("n"), edit.lcs_len(ref, hyp).alias("c")
    )
    # 2PR/(P+R) with P = c/n and R = c/m
    f1 = (
        F.when((F.col("m") == 0) & (F.col("n") == 0), 1.0)
        .when(F.col("c") == 0, 0.0)
        .otherwise(2.0 * F.col("c") / (F.col("m") + F.col("n")))
    )
    return scored.agg((F.avg(f1) * 100).alias("rouge_l"), F.count(F.lit(1)).alias("pairs"))


def cycle_accuracy(pairs: DataFrame, ref: Column, back: Column) -> DataFrame:
    """Position-wise equality over the shorter of the two sequences."""
    n = F.least(F.size(ref), F.size(back))
    hits = F.size(F.filter(
        F.zip_with(F.slice(ref, F.lit(1), n), F.slice(back, F.lit(1), n), lambda a, b: a == b),
        lambda x: x))
    sums = pairs.select(n.alias("n"), hits.alias("h")).agg(
        F.sum("h").alias("matches"), F.sum("n").alias("total_tokens")
    )
    return sums.select(
        _rate(F.col("matches"), F.col("total_tokens")).alias("cycle_token_accuracy"), "total_tokens"
    )


def sequence_scores(preds: DataFrame) -> DataFrame:
    """Token accuracy, exact sequence match and perplexity from class scores."""
    per_row = preds.select(
        "seq_id", (V.argmax("logits") == F.col("target")).alias("hit"),
        (V.logsumexp("logits") - F.element_at("logits", F.col("target") + 1)).alias("nll"),
    )
    per_seq = per_row.groupBy("seq_id").agg(
        F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("n"), F.sum("nll").alias("nll")
    )
    return per_seq.agg(
        (F.sum("hits") / F.sum("n")).alias("accuracy"),
        F.avg((F.col("hits") == F.col("n")).cast("double")).alias("exact_match"),
        F.exp(F.least(F.sum("nll") / F.sum("n"), F.lit(20.0))).alias("perplexity"),
    )


def confusion(preds: DataFrame) -> DataFrame:
    """Counts, row shares and mean confidence per (target, predicted) cell."""
    p = preds.select(
        "target", V.argmax("logits").alias("predicted"), F.array_max(V.softmax("logits")).alias("conf")
    )
    cells = p.groupBy("target", "predicted").agg(
        F.count(F.lit(1)).alias("n"), F.avg("conf").alias("mean_confidence")
    )
    # one row per cell is left: classes squared
    row = Window.partitionBy("target")
    return cells.withColumn("share", F.col("n") / F.sum("n").over(row))


def calibration_error(preds: DataFrame, bins: int = 15) -> DataFrame:
    """Expected and maximum calibration error over bins (lo, hi]."""
    p = preds.select(
        F.array_max(V.softmax("logits")).alias("conf"),
        (V.argmax("logits") == F.col("target")).cast("double").alias("hit"),
    )
    per_bin = p.where(F.col("conf") > 0).groupBy(F.ceil(F.col("conf") * bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("conf").alias("c"), F.avg("hit").alias("a")
    )
    gap = F.abs(F.col("a") - F.col("c"))
    return per_bin.agg(
        (F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce")
    )

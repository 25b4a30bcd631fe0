"""Scores over paired turns and over class scores derived from vectors."""

from pyspark.sql import functions as F

from tracklore.functions import vectors as V
from tracklore.operators import metrics as M
from tracklore.operators import uncertainty as U
from tracklore.plans import inputs as I
from tracklore.plans.registry import QuerySet
from tracklore.session import table

Q = QuerySet()
P = f"WITH {I.LOGITS}"
TOK = f"""WITH {I.PAIRS},
tok AS (SELECT conv_id, turn, {I.WORDS_SQL.format(c='ref')} AS r, {I.WORDS_SQL.format(c='hyp')} AS h FROM pair)"""
REF, HYP = lambda: I.words("ref"), lambda: I.words("hyp")


def r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@Q.add("a42_wer")
def _(s, d):
    return M.error_rates(I.pairs(s, d), REF(), HYP()).withColumnRenamed("error_rate", "wer")


@Q.add("a43_cer_parts")
def _(s, d):
    return M.error_rates(I.pairs(s, d), M.characters("ref"), M.characters("hyp")).withColumnRenamed(
        "error_rate", "cer")


# DuckDB measures distance on bytes: every letter is first mapped to one byte
@Q.add("a43_cer_total", f"""WITH {I.PAIRS},
letters AS (SELECT DISTINCT unnest(string_split(lower(ref || hyp), '')) AS l FROM pair),
abc AS (SELECT list(l ORDER BY l) AS ls FROM letters),
enc AS (SELECT length(lower(ref)) AS n,
  list_reduce(list_transform(string_split(lower(ref), ''), lambda x: chr(CAST(list_position(ls, x) AS INTEGER))), lambda a, b: a || b) AS r,
  list_reduce(list_transform(string_split(lower(hyp), ''), lambda x: chr(CAST(list_position(ls, x) AS INTEGER))), lambda a, b: a || b) AS h
  FROM pair, abc)
SELECT CAST(sum(levenshtein(r, h)) AS BIGINT) AS edits, CAST(sum(n) AS BIGINT) AS ref_chars,
       sum(levenshtein(r, h)) / CAST(sum(n) AS DOUBLE) * 100.0 AS cer FROM enc""")
def _(s, d):
    return M.cer_total(I.pairs(s, d))


def _bleu_sql():
    grams = " UNION ALL ".join(
        f"SELECT conv_id, turn, {n} AS n, array_to_string(list_slice(t, i, i + {n - 1}), chr(1)) AS g, side "
        f"FROM (SELECT *, unnest(generate_series(1, len(t) - {n - 1})) AS i FROM sides WHERE len(t) >= {n})"
        for n in (1, 2, 3, 4))
    scores = ", ".join(
        f"CASE WHEN min(p) FILTER (WHERE n <= {n}) = 0 THEN 0.0 ELSE round(any_value(bp) * exp(avg(ln(p)) FILTER (WHERE n <= {n} AND p > 0)) * 100, 6) END AS bleu_{n}"
        for n in (1, 2, 3, 4))
    return f"""{TOK},
sides AS (SELECT conv_id, turn, r AS t, 'r' AS side FROM tok UNION ALL SELECT conv_id, turn, h, 'h' FROM tok),
grams AS ({grams}),
cnt AS (SELECT n, count(*) FILTER (WHERE side = 'r') AS r, count(*) FILTER (WHERE side = 'h') AS h FROM grams GROUP BY conv_id, turn, n, g),
prec AS (SELECT n, sum(LEAST(r, h)) / CAST(GREATEST(1, sum(h)) AS DOUBLE) AS p FROM cnt GROUP BY n),
len AS (SELECT sum(len(r)) AS rl, sum(len(h)) AS hl FROM tok),
b AS (SELECT CASE WHEN hl = 0 THEN 0.0 WHEN hl < rl THEN exp(1 - rl / CAST(hl AS DOUBLE)) ELSE 1.0 END AS bp FROM len)
SELECT {scores} FROM prec, b"""


@Q.add("a44_bleu", _bleu_sql())
def _(s, d):
    return r6(M.bleu(I.pairs(s, d), ["conv_id", "turn"], REF(), HYP()),
              "bleu_1", "bleu_2", "bleu_3", "bleu_4")


@Q.add("a45_rouge_l")
def _(s, d):
    return M.rouge_l(I.pairs(s, d), REF(), HYP())


@Q.add("a55_cycle_token_accuracy", f"""{TOK},
c AS (SELECT LEAST(len(r), len(h)) AS n,
        len(list_filter(generate_series(1, LEAST(len(r), len(h))), lambda i: r[i] = h[i])) AS hits FROM tok)
SELECT sum(hits) / CAST(GREATEST(1, sum(n)) AS DOUBLE) * 100 AS cycle_token_accuracy,
       CAST(sum(n) AS BIGINT) AS total_tokens FROM c""")
def _(s, d):
    return M.cycle_accuracy(I.pairs(s, d), REF(), HYP())


BEST = f"""{P},
best AS (SELECT row_id, any_value(seq_id) AS seq_id, any_value(t) AS t, any_value(target) AS target,
  arg_max(c, (p, -c)) AS predicted, max(p) AS conf, max(CASE WHEN c = target THEN p END) AS pt
  FROM prob GROUP BY row_id)"""


@Q.add("a40_confusion_matrix", f"""{BEST}
SELECT target, CAST(predicted AS INTEGER) AS predicted, count(*) AS n, round(avg(conf), 6) AS mean_confidence,
       round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY target) AS DOUBLE), 6) AS share
FROM best GROUP BY target, predicted""")
def _(s, d):
    return r6(M.confusion(I.logits(s, d)), "mean_confidence", "share")


@Q.add("a41_accuracy_exact_perplexity", f"""{BEST},
sq AS (SELECT seq_id, count(*) FILTER (WHERE predicted = target) AS hits, count(*) AS n, sum(-ln(pt)) AS nll
       FROM best GROUP BY seq_id)
SELECT round(sum(hits) / CAST(sum(n) AS DOUBLE), 6) AS accuracy,
       round(avg(CASE WHEN hits = n THEN 1.0 ELSE 0.0 END), 6) AS exact_match,
       round(exp(LEAST(sum(nll) / sum(n), 20.0)), 6) AS perplexity FROM sq""")
def _(s, d):
    return r6(M.sequence_scores(I.logits(s, d)), "accuracy", "exact_match", "perplexity")


@Q.add("a46_ece_mce", f"""{BEST},
b AS (SELECT ceil(conf * 15) AS bin, count(*) AS n,
        abs(avg(conf) - avg(CASE WHEN predicted = target THEN 1.0 ELSE 0.0 END)) AS gap FROM best GROUP BY 1)
SELECT round(sum(gap * n) / sum(n), 6) AS ece, round(max(gap), 6) AS mce FROM b""")
def _(s, d):
    return r6(M.calibration_error(I.logits(s, d)), "ece", "mce")


FR = f"""{P},
rk AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY q DESC, c) AS rn FROM
  (SELECT *, LEAST(GREATEST(p, 1e-8), 1.0) AS q FROM prob)),
fr AS (SELECT row_id, any_value(seq_id) AS seq_id, any_value(t) AS t, sum(-q * ln(q)) / ln(10) AS entropy,
  max(CASE WHEN rn = 1 THEN q END) - max(CASE WHEN rn = 2 THEN q END) AS margin,
  max(CASE WHEN rn = 1 THEN q END) AS top, max(CASE WHEN rn = 1 THEN c END) AS token,
  max(CASE WHEN rn = 2 THEN c END) AS runner_up FROM rk GROUP BY row_id),
sq0 AS (SELECT seq_id, avg(entropy) AS e, avg(margin) AS m, min(top) AS mc FROM fr GROUP BY seq_id),
sq AS (SELECT seq_id, e AS mean_entropy, m AS mean_margin, mc AS min_confidence,
  GREATEST(0.0, LEAST(1.0, (e + (1 - m) + (1 - mc)) / 3)) AS score,
  CASE WHEN e >= 1.2 / ln(10) OR m <= 0.25 THEN 'ORACLE_ANNOTATION'
       WHEN e <= 0.35 / ln(10) AND m >= 0.7 THEN 'PSEUDO_LABEL' ELSE 'NEUTRAL' END AS action FROM sq0)"""


@Q.add("a47_sequence_uncertainty", f"""{FR}
SELECT seq_id, round(mean_entropy, 6) AS mean_entropy, round(mean_margin, 6) AS mean_margin,
       round(min_confidence, 6) AS min_confidence, round(score, 6) AS score, action FROM sq""")
def _(s, d):
    return r6(U.sequence_uncertainty(I.logits(s, d), 10),
              "mean_entropy", "mean_margin", "min_confidence", "score")


@Q.add("a47_ambiguous_frames", f"""{FR}
SELECT seq_id, t, CAST(rn AS INTEGER) AS position, CAST(token AS INTEGER) AS token, CAST(runner_up AS INTEGER) AS runner_up
FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY round(entropy, 9) DESC, t) AS rn FROM fr) WHERE rn <= 5""")
def _(s, d):
    return U.ambiguous_frames(I.logits(s, d), 10)


@Q.add("a48_prioritize_pool", f"""{FR}
SELECT action, row_number() OVER (PARTITION BY action ORDER BY
  round(CASE WHEN action = 'ORACLE_ANNOTATION' THEN -score ELSE score END, 9), seq_id) AS position, seq_id
FROM sq WHERE action <> 'NEUTRAL'""")
def _(s, d):
    return U.prioritized_pool(U.sequence_uncertainty(I.logits(s, d), 10))


SCORE = f"""{BEST}, sc AS (SELECT row_id, 1 - pt AS score FROM best),
lv AS (SELECT LEAST(1.0, ceil((count(*) + 1) * (1 - 0.1::DOUBLE)) / count(*)) AS q, count(*) AS n FROM sc),
srt AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS rk FROM sc)"""


@Q.add("a49_conformal_threshold", f"""{SCORE}
SELECT round((SELECT score FROM srt WHERE rk = floor((n - 1) * q)) + ((n - 1) * q - floor((n - 1) * q)) *
  ((SELECT score FROM srt WHERE rk = ceil((n - 1) * q)) - (SELECT score FROM srt WHERE rk = floor((n - 1) * q))), 6) AS q_linear,
  round((SELECT score FROM srt WHERE rk = ceil((n - 1) * q)), 6) AS q_higher FROM lv""")
def _(s, d):
    sc = U.target_scores(I.logits(s, d)).select("score")
    lin = U.conformal_quantile(sc).withColumnRenamed("q_hat", "q_linear")
    high = U.conformal_quantile(sc, rank_of="higher").scalar()
    return r6(lin.withColumn("q_higher", high), "q_linear", "q_higher")


APS = f"""{P},
rk AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, c) AS rn FROM prob),
cum AS (SELECT *, sum(p) OVER (PARTITION BY row_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS cp FROM rk),
sc AS (SELECT row_id, cp AS score FROM cum WHERE c = target),
lv AS (SELECT LEAST(1.0, ceil((count(*) + 1) * (1 - 0.1::DOUBLE)) / count(*)) AS q, count(*) AS n FROM sc),
srt AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS rk FROM sc),
qh AS (SELECT (SELECT score FROM srt WHERE rk = ceil((n - 1) * q)) AS q_hat FROM lv)"""
MARGIN = f"""{SCORE}, rk AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, c) AS rn FROM prob),
qh AS (SELECT (SELECT score FROM srt WHERE rk = ceil((n - 1) * q)) AS q_hat FROM lv)"""


@Q.add("a50_conformal_sets_aps", f"""{APS}
SELECT row_id, CAST(count(*) FILTER (WHERE inc) AS INTEGER) AS set_size, bool_or(inc AND c = target) AS covered
FROM (SELECT *, rn = 1 OR cp - p < q_hat AS inc FROM cum, qh) GROUP BY row_id""")
def _(s, d):
    return U.conformal_sets(I.logits(s, d), "aps").drop("q")


@Q.add("a50_conformal_sets_margin", f"""{MARGIN}
SELECT row_id, CAST(count(*) FILTER (WHERE inc) AS INTEGER) AS set_size, bool_or(inc AND c = target) AS covered
FROM (SELECT *, rn = 1 OR p >= 1 - q_hat AS inc FROM rk, qh) GROUP BY row_id""")
def _(s, d):
    return U.conformal_sets(I.logits(s, d), "margin").drop("q")


@Q.add("a50_conformal_coverage", f"""{APS},
st AS (SELECT row_id, count(*) FILTER (WHERE inc) AS k, bool_or(inc AND c = target) AS cov, any_value(q_hat) AS q_hat
FROM (SELECT *, rn = 1 OR cp - p < q_hat AS inc FROM cum, qh) GROUP BY row_id)
SELECT round(max(q_hat), 6) AS q_hat, round(avg(k), 6) AS mean_set_size,
       round(avg(CASE WHEN cov THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM st""")
def _(s, d):
    return r6(U.coverage(U.conformal_sets(I.logits(s, d), "aps")),
              "q_hat", "mean_set_size", "coverage")


@Q.add("a51_weighted_conformal_quantile", f"""{BEST},
w AS (SELECT best.row_id, 1 - pt AS score, exp(z / 2) AS weight FROM best JOIN logit ON logit.row_id = best.row_id AND c = 0),
cum AS (SELECT score, sum(weight) OVER (ORDER BY score) AS cw, sum(weight) OVER () AS tw FROM w)
SELECT row_id, round(COALESCE((SELECT min(cum.score) FROM cum
  WHERE cw >= 0.9::DOUBLE * (tw + w.weight + 1e-6)), 1.0), 6) AS quantile FROM w""")
def _(s, d):
    sc = U.target_scores(I.logits(s, d)).select(
        "row_id", "score", F.exp(F.element_at("logits", 1) / 2).alias("weight"))
    return r6(U.weighted_quantiles(sc.select("score", "weight"), sc.select("row_id", "weight")),
              "quantile")


@Q.add("a52_free_energy", f"""{P},
e AS (SELECT row_id, -(max(z) + ln(sum(exp(z - mz)))) AS energy FROM
  (SELECT *, max(z) OVER (PARTITION BY row_id) AS mz FROM logit) GROUP BY row_id)
SELECT row_id, round(energy, 6) AS energy, energy > -6.0 AS is_ood FROM e""")
def _(s, d):
    return r6(U.free_energy(I.logits(s, d)), "energy")


@Q.add("a53_epistemic_mi", f"""{P},
mp AS (SELECT seq_id, c, avg(p) AS p FROM prob GROUP BY seq_id, c),
tot AS (SELECT seq_id, sum(-p * ln(GREATEST(p, 1e-8))) AS total, max(p) AS top FROM mp GROUP BY seq_id),
ro AS (SELECT seq_id, row_id, sum(-p * ln(GREATEST(p, 1e-8))) AS h, -(max(z) + ln(sum(exp(z - mz)))) AS en
  FROM (SELECT *, max(z) OVER (PARTITION BY row_id) AS mz FROM prob) GROUP BY seq_id, row_id),
ex AS (SELECT seq_id, avg(h) AS expected, avg(en) AS energy FROM ro GROUP BY seq_id),
j AS (SELECT seq_id, GREATEST(0.0, total - expected) AS mi, energy, top FROM tot JOIN ex USING (seq_id))
SELECT seq_id, round(mi, 6) AS mi, round(energy, 6) AS energy,
       round(LEAST(1.0, top * exp(-mi)), 6) AS confidence, mi > 0.45 OR energy > 2.5 AS is_ood FROM j""")
def _(s, d):
    return r6(U.epistemic(I.logits(s, d)), "mi", "energy", "confidence")


def _dists(s, d):
    v = F.col("embedding").cast("array<double>")
    e = table(s, d, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / I.CLIP).cast("bigint").alias("seq_id"),
        V.softmax(F.slice(v, 1, 10)).alias("p1"), V.softmax(F.slice(v, 11, 10)).alias("p0"))


@Q.add("a54_token_grounding", """WITH x AS (SELECT vec_id, vec_id // 25 AS seq_id,
  CAST(embedding[c+1] AS DOUBLE) AS a, CAST(embedding[c+11] AS DOUBLE) AS b
  FROM (SELECT *, unnest(generate_series(0, 9)) AS c FROM embeddings)),
p AS (SELECT vec_id, seq_id, exp(a) / sum(exp(a)) OVER (PARTITION BY vec_id) AS p1,
             exp(b) / sum(exp(b)) OVER (PARTITION BY vec_id) AS p0 FROM x),
r AS (SELECT vec_id, seq_id, exp(-GREATEST(0.0, sum(p1 * (ln(p1) - ln(GREATEST(p0, 1e-8)))))) AS risk
      FROM p GROUP BY vec_id, seq_id)
SELECT seq_id, round(avg(risk), 6) AS score, avg(risk) > 0.5 AS is_hallucinated FROM r GROUP BY seq_id""")
def _(s, d):
    return r6(U.token_grounding(_dists(s, d)), "score")


VIEW = f"""{P},
v AS (SELECT seq_id, t // 5 AS t, c, avg(p) AS p FROM prob GROUP BY ALL),
b AS (SELECT seq_id, t, CAST(arg_max(c, (p, -c)) AS INTEGER) AS token FROM v GROUP BY seq_id, t),
k AS (SELECT *, lag(token) OVER (PARTITION BY seq_id ORDER BY t) AS prev FROM b)"""


@Q.add("a62_view_ensemble", f"""{VIEW}
SELECT seq_id, list(token ORDER BY t) AS tokens FROM k
WHERE token <> 0 AND (prev IS NULL OR prev <> token) GROUP BY seq_id""")
def _(s, d):
    views = I.logits(s, d).withColumn("t", F.floor(F.col("t") / 5).cast("int"))
    return U.collapse(U.ensemble(views))


@Q.add("f20_softmax_argmax", f"""{BEST}
SELECT row_id, CAST(predicted AS INTEGER) AS predicted, round(conf, 6) AS confidence,
       conf > 0.45 AS accepted, conf > 0.8 AS committed FROM best""")
def _(s, d):
    conf = F.array_max(V.softmax("logits"))
    return I.logits(s, d).select(
        "row_id", V.argmax("logits").alias("predicted"), F.round(conf, 6).alias("confidence"),
        (conf > 0.45).alias("accepted"), (conf > 0.8).alias("committed"))

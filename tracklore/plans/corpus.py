"""Corpus queries over documents, labels, benchmark passages, parts and pages."""

from pyspark.sql import functions as F

from tracklore.functions import text as X
from tracklore.operators import corpus as C
from tracklore.operators import leaks as K
from tracklore.operators import ordered
from tracklore.plans import inputs as I
from tracklore.plans.registry import QuerySet
from tracklore.session import table

Q = QuerySet()
WD = I.WORDS_SQL.format(c="text")
TOK = f"tok AS (SELECT doc_id, lang, source, unnest({WD}) AS token FROM documents)"
FRAC = "CAST('0x' || substr(md5(CAST({c} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE"
SPLIT = f"""sp AS (SELECT *, CASE WHEN f < 0.8 THEN 'train' WHEN f < 0.9 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, {FRAC.format(c='doc_id')} AS f FROM documents))"""
QR = """qr AS (SELECT d.doc_id, d.source, d.lang AS task, CAST(l.quality AS DOUBLE) AS quality, d.n_chars AS length,
  l.quality * d.n_chars / 1000.0::DOUBLE AS weight, d.doc_id % 16 AS shard FROM documents d LEFT JOIN labels l USING (doc_id))"""


def docs(s, d):
    return table(s, d, "documents")


def toks(s, d):
    return C.explode_tokens(docs(s, d), I.words(), "doc_id", "lang", "source")


def split(s, d):
    return docs(s, d).withColumn("split", X.split_of("doc_id"))


def quality(s, d):
    j = docs(s, d).join(table(s, d, "labels"), "doc_id", "left")
    return j.select(
        "doc_id", "source", F.col("lang").alias("task"), F.col("quality").cast("double").alias("quality"),
        F.col("n_chars").alias("length"), (F.col("quality") * F.col("n_chars") / 1000.0).alias("weight"),
        (F.col("doc_id") % 16).alias("shard"))


def r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


VOC = f"""{TOK}, voc AS (SELECT token, row_number() OVER (ORDER BY token) + 3 AS id
  FROM (SELECT DISTINCT token FROM tok WHERE lang = 'en'))"""


def vocab(s, d):
    return C.build_vocab(toks(s, d).where("lang = 'en'"))


@Q.add("a6_class_counts", f"WITH {TOK} SELECT token, count(*) AS n FROM tok GROUP BY token")
def _(s, d):
    return C.class_counts(toks(s, d))


@Q.add("a7_class_weights", f"""WITH {TOK}, c AS (SELECT token, count(*) AS n FROM tok GROUP BY token)
SELECT token, n, round(LEAST(10.0, GREATEST(1.0, pow((SELECT max(n) FROM c) / CAST(n AS DOUBLE), 0.35::DOUBLE))), 6) AS weight FROM c""")
def _(s, d):
    return r6(C.class_weights(C.class_counts(toks(s, d))), "weight")


@Q.add("a8_build_vocab", f"""WITH {TOK} SELECT token, row_number() OVER (ORDER BY token) + 3 AS id FROM (SELECT DISTINCT token FROM tok)""")
def _(s, d):
    return C.build_vocab(toks(s, d))


@Q.add("a8_label_ids", """WITH f AS (SELECT source AS label, min(doc_id) AS first FROM documents GROUP BY source)
SELECT label, row_number() OVER (ORDER BY first, label) - 1 AS id FROM f""")
def _(s, d):
    return C.label_ids(docs(s, d), "source", "doc_id")


@Q.add("a9_dataset_breakdown", """SELECT source, count(*) AS samples, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source""")
def _(s, d):
    return docs(s, d).groupBy("source").agg(
        F.count(F.lit(1)).alias("samples"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes"))


@Q.add("a4_corpus_audit", f"""WITH {QR} SELECT source, count(*) AS n, round(avg(quality), 6) AS avg_quality,
round(avg(weight), 6) AS avg_weight FROM qr GROUP BY ROLLUP (source)""")
def _(s, d):
    return r6(C.corpus_audit(quality(s, d)), "avg_quality", "avg_weight")


@Q.add("a5_rejection_rate", """WITH a AS (SELECT source, count(*) AS attempted FROM documents GROUP BY source),
b AS (SELECT source, count(*) AS accepted FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY source)
SELECT source, attempted, COALESCE(accepted, 0) AS accepted,
  round(GREATEST(0, attempted - COALESCE(accepted, 0)) / CAST(GREATEST(1, attempted) AS DOUBLE) * 100, 6) AS rejected_percent
FROM a LEFT JOIN b USING (source)""")
def _(s, d):
    ok = docs(s, d).join(table(s, d, "labels").where("quality = 1"), "doc_id", "left_semi")
    return r6(C.rejection_rate(docs(s, d), ok), "rejected_percent")


@Q.add("p14_sample_weight_sanitize", f"""WITH {QR} SELECT doc_id, CASE WHEN weight IS NULL OR weight < 0 THEN 0.0
ELSE GREATEST(0.25, LEAST(1.0, quality)) END::DOUBLE AS weight FROM qr""")
def _(s, d):
    return quality(s, d).select("doc_id", C.sanitize_weight(F.col("weight"), F.col("quality")).alias("weight"))


@Q.add("a10_weight_audit", f"""WITH {QR}
SELECT source, task, count(*) AS n, min(weight) AS min_w, max(weight) AS max_w, round(avg(weight), 6) AS mean_w,
  count(*) FILTER (WHERE weight = 0) AS zeros, count(*) FILTER (WHERE weight < 0) AS negatives,
  count(*) FILTER (WHERE isnan(weight)) AS nans, count(*) FILTER (WHERE isinf(weight)) AS infs,
  round(quantile_cont(weight, 0.01), 6) AS p1, round(median(weight), 6) AS median_w, round(quantile_cont(weight, 0.99), 6) AS p99
FROM qr GROUP BY source, task""")
def _(s, d):
    return r6(C.weight_audit(quality(s, d), ["source", "task"]), "mean_w", "p1", "median_w", "p99")


@Q.add("a11_weight_correlation", f"""WITH {QR}, f AS (SELECT task, count(*) AS frequency FROM qr GROUP BY task)
SELECT source, round(corr(weight, frequency), 6) AS with_frequency, round(corr(weight, length), 6) AS with_length
FROM qr JOIN f USING (task) GROUP BY source""")
def _(s, d):
    return r6(C.weight_correlation(quality(s, d), "task"), "with_frequency", "with_length")


@Q.add("a12_truncation_audit", f"""WITH w AS (SELECT source, len({WD}) AS length FROM documents)
SELECT source, count(*) AS n, max(length) AS longest, round(avg(length), 6) AS mean_length,
  {", ".join(f"count(*) FILTER (WHERE length > {k}) AS over_{k}, round(count(*) FILTER (WHERE length > {k}) / CAST(count(*) AS DOUBLE) * 100, 6) AS percent_over_{k}" for k in (64, 256))}
FROM w GROUP BY source""")
def _(s, d):
    w = docs(s, d).select("source", F.size(I.words()).cast("bigint").alias("length"))
    return r6(C.truncation_audit(w, [64, 256]), "mean_length", "percent_over_64", "percent_over_256")


_QS = ", ".join(f"quantile_cont({c}, {q}) AS {c}_{p}" for c in ("length", "stored") for p, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)))


@Q.add("a12_length_distribution", f"""WITH w AS (SELECT source, 'words' AS field, 64 AS lim, CAST(len({WD}) AS BIGINT) AS length FROM documents
  UNION ALL SELECT source, 'n_chars', 1000, n_chars FROM documents),
x AS (SELECT *, LEAST(length, lim) AS stored FROM w)
SELECT source, 1 - CAST(grouping(source) AS INTEGER) AS grouped, field, CAST(lim AS BIGINT) AS "limit", count(*) AS n, count(*) FILTER (WHERE length > lim) AS truncated,
  max(length) AS longest, {_QS} FROM x GROUP BY GROUPING SETS ((source, field, lim), (field, lim))""")
def _(s, d):
    w = docs(s, d).select("source", F.size(I.words()).alias("words"), "n_chars")
    return C.length_distribution(w, {"words": 64, "n_chars": 1000})


@Q.add("a13_unk_by_frequency", f"""WITH {VOC}, c AS (SELECT token, count(*) AS n FROM tok GROUP BY token), j AS (SELECT c.*, id IS NULL AS u, length(CAST(n AS VARCHAR)) - 1 AS band FROM c LEFT JOIN voc USING (token))
SELECT CAST(band AS INTEGER) AS band, count(*) AS words, CAST(sum(n) AS BIGINT) AS tokens, round(count(*) FILTER (WHERE u) / CAST(count(*) AS DOUBLE) * 100, 6) AS unk_words_percent,
  round(COALESCE(sum(n) FILTER (WHERE u), 0) / CAST(sum(n) AS DOUBLE) * 100, 6) AS unk_percent FROM j GROUP BY band""")
def _(s, d):
    return r6(C.unk_by_frequency(docs(s, d), I.words(), vocab(s, d)), "unk_words_percent", "unk_percent")


@Q.add("a13_unk_rate", f"""WITH {VOC},
sq AS (SELECT doc_id, source, count(*) AS n, count(*) FILTER (WHERE id IS NULL) AS u FROM tok LEFT JOIN voc USING (token) GROUP BY doc_id, source)
SELECT source, round(sum(u) / CAST(sum(n) AS DOUBLE) * 100, 6) AS unk_percent,
  round(count(*) FILTER (WHERE u > 0) / CAST(count(*) AS DOUBLE) * 100, 6) AS sequence_percent, CAST(sum(n) AS BIGINT) AS tokens
FROM sq GROUP BY ROLLUP (source)""")
def _(s, d):
    return r6(C.unk_rate(docs(s, d), I.words(), vocab(s, d), "doc_id", "source"), "unk_percent", "sequence_percent")


@Q.add("a14_lexicon_coverage", f"""WITH {TOK}, lex AS (SELECT DISTINCT token FROM tok WHERE lang = 'fr'),
c AS (SELECT source, token, count(*) AS n FROM tok GROUP BY source, token),
j AS (SELECT c.*, lex.token IS NOT NULL AS known FROM c LEFT JOIN lex USING (token))
SELECT source, count(*) AS classes, count(*) FILTER (WHERE known) AS covered,
  round(count(*) FILTER (WHERE known) / CAST(count(*) AS DOUBLE) * 100, 6) AS percent,
  round(COALESCE(sum(n) FILTER (WHERE known), 0) / CAST(sum(n) AS DOUBLE) * 100, 6) AS weighted_percent FROM j GROUP BY ROLLUP (source)""")
def _(s, d):
    classes = toks(s, d).groupBy("source", "token").agg(F.count(F.lit(1)).alias("n"))
    return r6(C.coverage(classes, toks(s, d).where("lang = 'fr'"), "token"), "percent", "weighted_percent")


@Q.add("a14_coverage_by_frequency", f"""WITH {TOK}, lex AS (SELECT DISTINCT token FROM tok WHERE lang = 'fr'), c AS (SELECT token, count(*) AS n FROM tok GROUP BY token),
j AS (SELECT c.*, lex.token IS NOT NULL AS known, row_number() OVER (ORDER BY n DESC, c.token) AS rn FROM c LEFT JOIN lex USING (token)),
p AS (SELECT '10^' || (length(CAST(n AS VARCHAR)) - 1) AS part, known FROM j UNION ALL SELECT 'top 100', known FROM j WHERE rn <= 100)
SELECT part, count(*) AS classes, count(*) FILTER (WHERE known) AS covered, round(count(*) FILTER (WHERE known) / CAST(count(*) AS DOUBLE) * 100, 6) AS percent FROM p GROUP BY part""")
def _(s, d):
    classes = toks(s, d).groupBy("source", "token").agg(F.count(F.lit(1)).alias("n"))
    return r6(C.coverage_by_frequency(classes, toks(s, d).where("lang = 'fr'"), "token"), "percent")


GAP = "gv AS (SELECT p_partkey * p_partkey % 1009 AS id, p_name AS label, p_type AS attribute FROM part)"


def gappy(s, d):
    p = F.col("p_partkey")
    return table(s, d, "part").select((p * p % 1009).alias("id"), F.col("p_name").alias("label"),
                                      F.col("p_type").alias("attribute"))


@Q.add("a15_vocab_contiguity", f"""WITH {GAP} SELECT min(id) AS min_id, max(id) AS max_id, count(DISTINCT id) AS distinct_ids,
max(id) - min(id) + 1 - count(DISTINCT id) AS missing, count(id) - count(DISTINCT id) AS duplicates, count(*) FILTER (WHERE id < 0) AS negative FROM gv""")
def _(s, d):
    return C.vocab_contiguity(gappy(s, d))


@Q.add("o9_missing_ids", f"""WITH {GAP} SELECT i AS id FROM (SELECT unnest(generate_series((SELECT min(id) FROM gv), (SELECT max(id) FROM gv))) AS i)
WHERE i NOT IN (SELECT id FROM gv)""")
def _(s, d):
    return C.missing_ids(gappy(s, d))


@Q.add("a16_label_collisions", f"""WITH {GAP}, x AS (SELECT DISTINCT id, label FROM gv)
SELECT 'id' AS kind, CAST(id AS VARCHAR) AS "key", count(*) AS n FROM x GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'label', label, count(*) FROM x GROUP BY label HAVING count(*) > 1""")
def _(s, d):
    return C.label_collisions(gappy(s, d))


@Q.add("a20_attribute_id_stability", f"""WITH {GAP} SELECT attribute, count(DISTINCT id) AS ids FROM gv GROUP BY attribute HAVING count(DISTINCT id) > 1""")
def _(s, d):
    return C.attribute_id_stability(gappy(s, d))


@Q.add("a17_empty_target_audit", f"""SELECT source, count(*) AS flagged, count(*) FILTER (WHERE len(list_filter({WD}, lambda w: regexp_matches(w, '[a-z]'))) < 3) AS without_tokens
FROM documents GROUP BY source""")
def _(s, d):
    lexical = F.size(F.filter(I.words(), lambda w: w.rlike("[a-z]")))
    return docs(s, d).groupBy("source").agg(
        F.count(F.lit(1)).alias("flagged"), F.count_if(lexical < 3).alias("without_tokens"))


@Q.add("a18_shard_mix", f"""WITH {QR}, c AS (SELECT shard, task, count(*) AS n FROM qr GROUP BY ALL)
SELECT shard, task, round(n / CAST(sum(n) OVER (PARTITION BY shard) AS DOUBLE) * 100, 6) AS percent,
  round(n / CAST(sum(n) OVER (PARTITION BY shard) AS DOUBLE) * 100 - sum(n) OVER (PARTITION BY task) / CAST(sum(n) OVER () AS DOUBLE) * 100, 6) AS deviation FROM c""")
def _(s, d):
    return r6(C.shard_mix(quality(s, d)), "percent", "deviation")


@Q.add("a18_shard_mixes", f"""WITH {QR}, r AS (SELECT shard, source, COALESCE(task, 'none') AS task, CASE WHEN quality IS NULL THEN 'none' WHEN quality > 0 THEN 'true' ELSE 'false' END AS valid FROM qr),
v AS (SELECT shard, 'source' AS part, COALESCE(source, 'none') AS value FROM r UNION ALL SELECT shard, 'task', task FROM r UNION ALL SELECT shard, 'valid', valid FROM r),
l AS (SELECT 'shard' AS level, shard AS number, part, value FROM v UNION ALL SELECT 'worker', shard % 4, part, value FROM v),
g AS (SELECT part, value, count(*) / CAST((SELECT count(*) FROM r) AS DOUBLE) * 100 AS overall FROM v GROUP BY ALL),
c AS (SELECT level, number, part, value, count(*) AS n FROM l GROUP BY ALL), q AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY level, number, part) AS DOUBLE) * 100 AS percent FROM c)
SELECT level, number, part, value, n, round(percent, 6) AS percent, round(percent - overall, 6) AS deviation FROM q JOIN g USING (part, value)""")
def _(s, d):
    rows = quality(s, d).withColumn("valid", F.col("quality") > 0)
    return r6(C.shard_mixes(rows, ["source", "task", "valid"], 4), "percent", "deviation")


@Q.add("a19_clip_schema_audit", """WITH e AS (SELECT 'src' || label AS source, CASE vec_id % 3 WHEN 0 THEN 'isolated' ELSE 'sentence' END AS task, [CAST(x AS DOUBLE) for x in embedding] AS v, vec_id % 5 AS k FROM embeddings),
f AS (SELECT source, task, k, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 8 WHEN 3 THEN 4 ELSE 2 END AS t,
  CASE k WHEN 1 THEN 64 WHEN 2 THEN 8 WHEN 3 THEN 16 ELSE NULL END AS width, k = 4 AS ragged FROM e)
SELECT source, task, CAST(width AS INTEGER) AS width, CASE WHEN width IS NULL THEN 'none' WHEN width > 16 THEN 'cut' WHEN width < 16 THEN 'pad' ELSE 'keep' END AS action, count(*) AS n,
 count(*) FILTER (WHERE t = 0) AS no_frame, count(*) FILTER (WHERE t = 1) AS one_frame, count(*) FILTER (WHERE t < 4) AS too_short, count(*) FILTER (WHERE ragged) AS ragged,
 count(*) FILTER (WHERE k = 3) AS with_nan, count(*) FILTER (WHERE k = 2) AS with_inf FROM f GROUP BY ALL""")
def _(s, d):
    v, k = F.col("embedding").cast("array<double>"), F.col("vec_id") % 5
    cut = lambda n, w: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(v, i * w + 1, w))
    odd = lambda f, x: F.concat(F.slice(f, 2, 99), F.array(F.concat(F.slice(F.get(f, F.lit(0)), 2, 99), F.array(F.lit(float(x))))))
    frames = F.when(k == 0, F.slice(F.array(v), 1, 0)).when(k == 1, F.array(v)).when(k == 2, odd(cut(8, 8), "-inf")).when(k == 3, odd(cut(4, 16), "nan")).otherwise(
        F.array(v, F.slice(v, 1, 3)))
    clips = table(s, d, "embeddings").select(F.concat(F.lit("src"), F.col("label").cast("string")).alias("source"),
                                             F.when(F.col("vec_id") % 3 == 0, "isolated").otherwise("sentence").alias("task"), frames.alias("frames"))
    return C.clip_schema_audit(clips, 4, 16)


@Q.add("a19_feature_schema_audit", """SELECT 'src' || label AS source, len(embedding) AS width, count(*) AS n,
count(*) FILTER (WHERE len(embedding) = 0) AS empty, count(*) FILTER (WHERE len(list_filter(embedding, lambda x: isnan(x))) > 0) AS with_nan,
count(*) FILTER (WHERE len(list_filter(embedding, lambda x: isinf(x))) > 0) AS with_inf FROM embeddings GROUP BY ALL""")
def _(s, d):
    e = table(s, d, "embeddings").select(
        F.concat(F.lit("src"), F.col("label").cast("string")).alias("source"), F.col("embedding").alias("features"))
    return C.feature_schema_audit(e).withColumn("width", F.col("width").cast("bigint"))


CH = "list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), ''), lambda c: c <> '')"


@Q.add("a21_charset_range_audit", f"""WITH c AS (SELECT unnest({CH}) AS ch FROM documents)
SELECT (SELECT count(*) FROM c) + 2 * (SELECT count(*) FROM documents) AS n, CAST(0 AS BIGINT) AS out_of_range,
count(*) FILTER (WHERE ch = ' ') AS spaces, count(*) FILTER (WHERE ch BETWEEN '0' AND '9') AS digits,
count(*) FILTER (WHERE ch BETWEEN 'a' AND 'z') AS letters FROM c""")
def _(s, d):
    return C.charset_audit(docs(s, d).select(X.char_ids("text").alias("ids")))


@Q.add("a39_per_class_cap", """SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 7""")
def _(s, d):
    return C.per_class_cap(docs(s, d).select("doc_id", "source"), "source", "doc_id", 7)


@Q.add("a58_word_distribution", f"""WITH {TOK} SELECT token, count(*) AS n FROM tok WHERE lang <> 'en' GROUP BY token""")
def _(s, d):
    return C.class_counts(toks(s, d).where("lang <> 'en'"))


@Q.add("a61_curriculum_subset", """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS pos, count(*) OVER () AS n FROM documents)
SELECT doc_id, pos FROM r WHERE pos <= GREATEST(10, floor(n * 0.33))""")
def _(s, d):
    r = docs(s, d).select("doc_id", "n_chars")
    return C.curriculum_subset(r, [F.col("n_chars"), F.col("doc_id")], 1).drop("n_chars")


@Q.add("o11_deterministic_split", f"WITH {SPLIT} SELECT doc_id, split FROM sp")
def _(s, d):
    return split(s, d).select("doc_id", "split")


@Q.add("o11_md5_mod10", """WITH h AS (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS m FROM documents)
SELECT doc_id, CAST((CAST('0x' || substr(m, 1, 16) AS UBIGINT) % 10 * 6 + CAST('0x' || substr(m, 17, 16) AS UBIGINT) % 10) % 10 AS INTEGER) AS bucket FROM h""")
def _(s, d):
    return docs(s, d).select("doc_id", X.md5_mod10("doc_id").alias("bucket"))


@Q.add("o11_empty_train_rescue", f"""WITH {SPLIT}, nt AS (SELECT doc_id, split FROM sp WHERE split <> 'train'),
dn AS (SELECT COALESCE((SELECT min(doc_id) FROM nt WHERE split = 'val'), (SELECT min(doc_id) FROM nt WHERE split = 'test')) AS k)
SELECT 'none in train' AS kind, doc_id, CASE WHEN doc_id = k THEN 'train' ELSE split END AS split FROM nt, dn
UNION ALL SELECT 'some in train', doc_id, split FROM sp""")
def _(s, d):
    rows = split(s, d).select("doc_id", "split")
    moved = C.rescue_empty_train(rows.where("split <> 'train'"), "doc_id")
    return moved.withColumn("kind", F.lit("none in train")).unionByName(
        C.rescue_empty_train(rows, "doc_id").withColumn("kind", F.lit("some in train")))


@Q.add("o12_partition_by_modulo", "SELECT doc_id % 8 AS worker, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def _(s, d):
    return docs(s, d).groupBy(F.pmod("doc_id", F.lit(8)).alias("worker")).agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@Q.add("o4_natural_sort", """WITH k AS (SELECT doc_id, CAST(substr(source, 4) AS INTEGER) AS n FROM documents)
SELECT doc_id, row_number() OVER (ORDER BY n, doc_id) AS pos FROM k""")
def _(s, d):
    p = docs(s, d).select("doc_id", X.natural_key("source").alias("k"))
    return ordered.positions(p, [F.col("k"), F.col("doc_id")]).select("doc_id", "pos")


@Q.add("o5_seeded_shuffle", """SELECT doc_id, source, row_number() OVER (ORDER BY md5(doc_id || ':42:1'), doc_id) AS position FROM documents""")
def _(s, d):
    return C.shuffled(docs(s, d).select("doc_id", "source"), "doc_id", 42, 1)


@Q.add("o6_alternate_sources", """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents WHERE lang = 'en'),
b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents WHERE lang = 'fr'),
n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb)
SELECT i * 2 AS position, doc_id, 'a' AS side FROM (SELECT unnest(generate_series(0, GREATEST(na, nb) - 1)) AS i, na, nb FROM n) g JOIN a ON a.p = i % na
UNION ALL SELECT i * 2 + 1, doc_id, 'b' FROM (SELECT unnest(generate_series(0, GREATEST(na, nb) - 1)) AS i, na, nb FROM n) g JOIN b ON b.p = i % nb""")
def _(s, d):
    x = docs(s, d).select("doc_id", "lang")
    return C.alternate(x.where("lang = 'en'"), x.where("lang = 'fr'"), "doc_id")


@Q.add("j15_cross_split_leak", f"""WITH {SPLIT}, h AS (SELECT sha256(text) AS hash, count(*) FILTER (WHERE split = 'train') AS train,
count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test FROM sp GROUP BY 1)
SELECT * FROM h WHERE (train > 0)::INT + (val > 0)::INT + (test > 0)::INT > 1""")
def _(s, d):
    return C.cross_split_leaks(split(s, d), F.col("text"))


@Q.add("o8_hash_intersect", f"""WITH {SPLIT} SELECT md5(text) AS hash FROM sp WHERE split = 'train' INTERSECT SELECT md5(text) FROM sp WHERE split = 'val'""")
def _(s, d):
    return C.shared_hashes(split(s, d), F.col("text"))


def _sh(c):
    return f"list_distinct(list_transform(generate_series(1, len({c}) - 7), lambda i: array_to_string({c}[i:i+7], ' ')))"


@Q.add("j16_near_duplicate_leak", f"""WITH b AS (SELECT item_id, {WD} AS w FROM benchmark), d AS (SELECT doc_id, {WD} AS w FROM documents),
bi AS (SELECT item_id, unnest({_sh('w')}) AS g FROM b WHERE len(w) >= 8), di AS (SELECT doc_id, unnest({_sh('w')}) AS g FROM d WHERE len(w) >= 8),
sz AS (SELECT item_id, count(*) AS n FROM bi GROUP BY item_id), h AS (SELECT doc_id, item_id, count(*) AS common FROM di JOIN bi USING (g) GROUP BY ALL)
SELECT doc_id, item_id, common, round(common / CAST(n AS DOUBLE), 6) AS share FROM h JOIN sz USING (item_id) WHERE common >= 0.5 * n""")
def _(s, d):
    return r6(C.near_duplicate_leaks(docs(s, d), table(s, d, "benchmark"), I.words(), I.words()), "share")


TRACE = f"""tr AS (SELECT vec_id, label % 2 AS source, vec_id % 2 AS signer, vec_id * 37 % 400 AS s, vec_id * 37 % 400 + 60 AS e, {FRAC.format(c='vec_id')} AS f,
  [(x - m) / sd for x in emb] AS p FROM (SELECT vec_id, label, emb, list_avg(emb) AS m, sqrt(list_avg([(y - list_avg(emb)) ** 2 for y in emb])) AS sd
    FROM (SELECT vec_id, label, [CAST(z AS DOUBLE) for z in embedding] AS emb FROM embeddings))),
ts AS (SELECT *, CASE WHEN f < 0.8 THEN 'train' WHEN f < 0.9 THEN 'val' ELSE 'test' END AS split FROM tr)"""


@Q.add("j16_trajectory_leak", f"""WITH {TRACE}, pr AS (SELECT a.source, a.signer, a.vec_id AS clip, b.vec_id AS other, a.split, b.split AS other_split,
  CAST(least(a.e, b.e) - greatest(a.s, b.s) AS DOUBLE) AS overlap, list_distance(a.p, b.p) / 8 AS distance
  FROM ts a JOIN ts b ON a.source = b.source AND a.signer = b.signer AND a.split < b.split AND a.s < b.e AND b.s < a.e)
SELECT source, signer, clip, other, split, other_split, overlap, round(distance, 6) AS distance, 1 AS copies, 1 AS other_copies FROM pr WHERE distance <= 1.2""")
def _(s, d):
    start = F.col("vec_id") * 37 % 400
    clips = table(s, d, "embeddings").select(
        F.col("vec_id").alias("clip_id"), X.split_of("vec_id").alias("split"), (F.col("label") % 2).alias("source"), (F.col("vec_id") % 2).alias("signer"),
        start.alias("start"), (start + 60).alias("end"), F.col("embedding").cast("array<double>").alias("path"))
    return r6(K.trajectory_leaks(clips, 1.2, 50), "distance")


@Q.add("j2_completed_key_exclusion", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(s, d):
    return docs(s, d).select("doc_id").join(table(s, d, "labels"), "doc_id", "left_anti")


@Q.add("j3_page_view_gate", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(s, d):
    ok = table(s, d, "labels").where("quality = 1")
    return docs(s, d).select("doc_id", "source").join(ok, "doc_id", "left_semi")


@Q.add("f4_encode_gloss", f"""WITH {VOC}, p AS (SELECT doc_id, unnest({WD}) AS token, unnest(generate_series(1, len({WD}))) AS i FROM documents)
SELECT doc_id, list(COALESCE(id, 3) ORDER BY i) AS ids FROM p LEFT JOIN voc USING (token) GROUP BY doc_id""")
def _(s, d):
    return C.encode(docs(s, d), I.words(), vocab(s, d), "doc_id")


@Q.add("j4_label_lookup", """WITH v AS (SELECT label, row_number() OVER (ORDER BY label) + 3 AS id FROM (SELECT DISTINCT p_name AS label FROM part WHERE p_size <= 25)),
w AS (SELECT p_partkey, p_name, unnest(string_split(p_name, ' ')) AS word, unnest(generate_series(1, 2)) AS i FROM part WHERE p_name NOT IN (SELECT label FROM v)),
k AS (SELECT word, row_number() OVER (ORDER BY word) + 3 AS id FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS word FROM part))
SELECT p_partkey, [v.id] AS ids FROM part JOIN v ON v.label = p_name
UNION ALL SELECT p_partkey, list(COALESCE(k.id, 3) ORDER BY i) FROM w LEFT JOIN k USING (word) GROUP BY p_partkey""")
def _(s, d):
    part = table(s, d, "part")
    whole = C.build_vocab(part.where("p_size <= 25").select(F.col("p_name").alias("token")))
    single = C.build_vocab(part.select(F.substring_index("p_name", " ", 1).alias("token")))
    hit = part.join(whole, part.p_name == whole.token, "left")
    rest = C.encode(hit.where("id is null").select("p_partkey", "p_name"), F.split("p_name", " "), single, "p_partkey")
    return hit.where("id is not null").select("p_partkey", F.array("id").alias("ids")).unionByName(rest)


@Q.add("f4_decode_gloss", f"""WITH {VOC}, p AS (SELECT doc_id, unnest({WD}) AS token, unnest(generate_series(1, len({WD}))) AS i FROM documents)
SELECT doc_id, string_agg(CASE WHEN id IS NULL THEN '<UNK>' ELSE token END, ' ' ORDER BY i) AS text FROM p LEFT JOIN voc USING (token) GROUP BY doc_id""")
def _(s, d):
    v = vocab(s, d)
    return C.decode(C.encode(docs(s, d), I.words(), v, "doc_id"), v, "doc_id")


@Q.add("f9_add_tokens", f"""WITH {VOC}, f AS (SELECT DISTINCT token FROM tok WHERE lang = 'de' AND token NOT IN (SELECT token FROM voc))
SELECT token, row_number() OVER (ORDER BY token) + (SELECT max(id) FROM voc) AS id FROM f""")
def _(s, d):
    return C.add_tokens(vocab(s, d), toks(s, d).where("lang = 'de'"))


STI = f"""WITH c AS (SELECT conv_id * 100 + turn AS clip_id, len({WD}) AS length, text, turn FROM conversations)"""


@Q.add("w33_stitch_records")
def _(s, d):
    c = table(s, d, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("clip_id"), F.size(I.words()).alias("length"), "text",
        X.char_ids("role").alias("ids"), (F.col("turn") / 8).alias("weight"))
    return C.stitch(c, 3, 7, 384)


@Q.add("w41_merge_adjacent_pairs", """WITH RECURSIVE b AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS idx, p_partkey, count(*) OVER () AS n FROM part),
r AS (SELECT idx, n, list_transform(generate_series(1, CAST(p_partkey % 7 + 1 AS INTEGER)), lambda i: CAST(p_partkey % 30 + 4 + i AS BIGINT)) AS ids FROM b),
g(idx, k, off, n, acc) AS (SELECT idx, 2 + idx % 3, CAST(0 AS BIGINT), n, [CAST(1 AS BIGINT)] FROM r WHERE idx % 2 = 1
  UNION ALL SELECT g.idx, k, off + 1, g.n, CASE WHEN len(acc) + len(r.ids) + 2 <= 16 THEN
    CASE WHEN (acc || r.ids)[-1] = 41 THEN acc || r.ids ELSE acc || r.ids || [CAST(41 AS BIGINT)] END ELSE acc END
  FROM g JOIN r ON r.idx = (g.idx + off) % g.n WHERE off < k)
SELECT idx, (acc || [CAST(2 AS BIGINT)])[1:16] AS ids FROM g WHERE off = k""")
def _(s, d):
    part = table(s, d, "part").select("p_partkey")
    p = ordered.positions(part, [F.col("p_partkey")], "idx")
    k = F.col("p_partkey")
    r = p.withColumn("n", part.agg(F.count(F.lit(1))).scalar()).select(
        (F.col("idx") - 1).alias("idx"), "n", F.transform(
            F.sequence(F.lit(1), (k % 7 + 1).cast("int")), lambda i: (k % 30 + 4 + i).cast("bigint")).alias("ids"))
    return C.merge_adjacent(r, 4, 16, 41)

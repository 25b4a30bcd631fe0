"""Source, sink and quality queries; file formats are covered by the tests."""

import os
import uuid

from pyspark.sql import functions as F

from tracklore.operators import corpus as C
from tracklore.operators import ordered
from tracklore.operators import quality as K
from tracklore.plans import inputs as I
from tracklore.plans.corpus import SPLIT, split
from tracklore.plans.poses import BL, points
from tracklore.plans.registry import QuerySet
from tracklore.session import shared_dir, table
from tracklore.sources import readers as R
from tracklore.sources import writers as W

Q = QuerySet()


def made(s) -> str:
    """A new folder of the shared one, for files made from the given tables."""
    return os.path.join(shared_dir(s), "made", uuid.uuid4().hex)


def r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@Q.add("j1_clip_transcript", """WITH k AS (SELECT conv_id || '.' || turn AS id, turn, text FROM conversations),
c AS (SELECT id || CASE turn % 3 WHEN 0 THEN '-rgb_front' WHEN 1 THEN '_rgb_front' ELSE '' END AS clip_id FROM (SELECT DISTINCT id, turn FROM k)
  UNION ALL SELECT DISTINCT conv_id || '-rgb_front' FROM conversations),
t AS (SELECT id, max(text) AS text FROM k GROUP BY id)
SELECT clip_id, COALESCE(text, 'none') AS text FROM c LEFT JOIN t ON t.id = regexp_replace(clip_id, '[-_]rgb_front', '')""")
def _(s, d):
    c = table(s, d, "conversations")
    turn = F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    camera = F.when(F.col("turn") % 3 == 0, "-rgb_front").when(F.col("turn") % 3 == 1, "_rgb_front").otherwise("")
    untold = c.select(F.concat(F.col("conv_id").cast("string"), F.lit("-rgb_front")).alias("clip_id")).distinct()
    clips = c.select(F.concat(turn, camera).alias("clip_id")).distinct().unionByName(untold)
    t = c.groupBy(turn.alias("clip_id")).agg(F.max("text").alias("text"))
    return R.attach_transcripts(clips, t, "none").select("clip_id", "text")


@Q.add("s1_load_transcripts", """WITH k AS (SELECT conv_id || '.' || turn || CASE turn % 2 WHEN 0 THEN '-rgb_front' ELSE '' END AS raw, trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g')) AS text, conv_id % 2 AS f FROM conversations),
b AS (SELECT raw, text, f FROM k UNION ALL SELECT regexp_replace(raw, '[-_]rgb_front', ''), text, f FROM k WHERE contains(raw, 'rgb_front'))
SELECT raw AS clip_id, max(text) AS text FROM b WHERE text <> '' GROUP BY raw""")
def _(s, d):
    c = table(s, d, "conversations").groupBy("conv_id", "turn").agg(F.max(F.trim(F.regexp_replace("text", r"[\r\n]+", " "))).alias("text"))
    name = F.concat(F.concat_ws(".", "conv_id", "turn"), F.when(F.col("turn") % 2 == 0, "-rgb_front").otherwise(""))
    paths = [made(s), made(s)]
    told = c.select("conv_id", name.alias("sentence_name"), F.lit("x").alias("note"), F.col("text").alias("sentence"))
    for i, (path, sep) in enumerate(zip(paths, "\t,")):
        told.where(F.col("conv_id") % 2 == i).drop("conv_id").write.csv(path, header=True, sep=sep, escape='"')
    return R.transcripts(s, paths)


@Q.add("s2_load_nested_index", """SELECT lower(p_brand) AS gloss, CAST(p_partkey AS VARCHAR) AS video_id, CASE p_partkey % 3 WHEN 0 THEN 'val' ELSE 'train' END AS split,
CAST(GREATEST(0, p_size - 1) AS INTEGER) AS frame_start, CAST(p_size + 20 AS INTEGER) AS frame_end, CAST(p_partkey % 7 AS INTEGER) AS signer_id FROM part""")
def _(s, d):
    k = F.col("p_partkey")
    clip = F.struct(k.cast("string").alias("video_id"), F.when(k % 3 == 0, "val").otherwise("train").alias("split"), F.col("p_size").alias("frame_start"),
                    (F.col("p_size") + 20).alias("frame_end"), (k % 7).alias("signer_id"))
    path = made(s)
    table(s, d, "part").groupBy(F.col("p_brand").alias("gloss"), F.floor(k / 1000).alias("part")).agg(F.collect_list(clip).alias("instances")).write.json(path)
    return R.nested_index(s, path)


@Q.add("s3_load_split_csvs", f"""WITH {SPLIT} SELECT source AS participant, CAST(doc_id AS VARCHAR) AS video, lang AS gloss, split || n_chars AS lex_code, split FROM sp""")
def _(s, d):
    rows = split(s, d).select(F.concat(F.lit(" "), "source").alias("Participant ID"), F.col("doc_id").alias("Video file"), F.concat("lang", F.lit(" ")).alias("Gloss"),
                              F.concat("split", "n_chars").alias("ASL-LEX Code"), "split")
    paths = {k: made(s) for k in ("train", "val", "test")}
    for k, path in paths.items():
        rows.where(F.col("split") == k).drop("split").write.csv(path, header=True)
    return R.split_csvs(s, paths)


@Q.add("s7_write_sharded", f"""WITH {SPLIT}, n AS (SELECT split, count(*) AS rows FROM sp GROUP BY split) SELECT split, rows, rows AS listed, LEAST(rows, 50) AS largest FROM n""")
def _(s, d):
    path = made(s)
    W.write_sharded(split(s, d).select("doc_id", "split").coalesce(1), path, 50)
    back = s.read.parquet(path)
    listed = back.groupBy("split").agg(F.count_distinct("doc_id").alias("listed"))
    return W.shard_counts(back).join(listed, "split").select("split", "rows", "listed", "largest")


@Q.add("s15_media_listing", f"""SELECT event_id, row_number() OVER (ORDER BY ts DESC, CAST(event_id AS VARCHAR)) AS pos FROM events""")
def _(s, d):
    e = I.events(s, d).select("event_id", F.col("ts").alias("modificationTime"), F.col("event_id").cast("string").alias("path"))
    return ordered.positions(e, [F.desc("modificationTime"), F.col("path")]).select("event_id", "pos")


@Q.add("s17_training_metrics_csv", """SELECT CAST(doc_id AS DOUBLE) AS epoch, CAST(n_chars AS DOUBLE) / 8 AS accuracy FROM documents WHERE doc_id % 10 <> 3""")
def _(s, d):
    path = made(s)
    docs = table(s, d, "documents").select("doc_id", (F.col("n_chars") / 8).cast("string").alias("acc"))
    docs.select(F.col("doc_id").alias("epoch"), F.when(F.col("doc_id") % 10 == 3, "broken").otherwise(F.col("acc")).alias("acc")).write.csv(path, header=True)
    return R.training_metrics(s, path)


@Q.add("s4_partition_split", """SELECT doc_id, CASE WHEN contains(p, 'dev') OR contains(p, 'val') THEN 'val' WHEN contains(p, 'test') THEN 'test' ELSE 'train' END AS split
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'dev1' WHEN 1 THEN 'valid' WHEN 2 THEN 'test_b' ELSE 'x' END AS p FROM documents)""")
def _(s, d):
    k = F.col("doc_id") % 4
    p = F.when(k == 0, "DEV1").when(k == 1, "valid").when(k == 2, "test_b").otherwise("x")
    return table(s, d, "documents").select("doc_id", R.partition_split(p).alias("split"))


@Q.add("s6_hand_csv_wide", """SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS x0, round(embedding[32]::DOUBLE, 6) AS y10, round(embedding[63]::DOUBLE, 6) AS z20, 21 AS joints FROM embeddings""")
def _(s, d):
    h = I.hands(s, d).withColumn("vec_id", F.col("clip_id") * I.CLIP + F.col("frame_idx"))
    w = R.hand_wide(h, "vec_id")
    return w.select("vec_id", "x0", "y10", "z20", F.size(F.from_json("landmarks", "array<array<double>>")).alias("joints"))


@Q.add("s8_manifest", f"""WITH {SPLIT}, p AS (SELECT split, source, count(*) AS n, sum(strlen(text)) AS bytes FROM sp GROUP BY ALL)
SELECT split, CAST(sum(n) AS BIGINT) AS total, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS sources,
'{{' || string_agg('"' || source || '":' || n, ',' ORDER BY source) || '}}' AS breakdown FROM p GROUP BY split""")
def _(s, d):
    return W.manifest(split(s, d)).withColumn("bytes", F.col("bytes").cast("bigint"))


@Q.add("s8_shard_list", f"""WITH {SPLIT}, n AS (SELECT split, text, n_chars, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS place FROM sp)
SELECT split, place // 100 AS shard, count(*) AS rows, min(place) AS first, max(place) AS last,
  count(*) FILTER (WHERE NOT COALESCE(length(text) = n_chars, false)) AS broken_length, count(*) FILTER (WHERE NOT COALESCE(n_chars >= 300, false)) AS broken_long
FROM n GROUP BY ALL""")
def _(s, d):
    # rules are judged before rows are numbered: texts needn't travel
    judged = split(s, d).select("split", "doc_id", (F.char_length("text") == F.col("n_chars")).alias("length"), (F.col("n_chars") >= 300).alias("long"))
    rules = {"length": F.col("length"), "long": F.col("long")}
    return W.shard_list(W.numbered_shards(judged, "split", ["doc_id"], 100), "split", rules)


@Q.add("s9_resume_filter", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(s, d):
    return W.resume_filter(table(s, d, "documents").select("doc_id"), table(s, d, "labels").where("quality = 1"), "doc_id")


@Q.add("s10_quarantine", """WITH m AS (SELECT CASE WHEN quality IS NULL THEN 'unlabeled' WHEN quality = 0 THEN 'low quality' WHEN toxic = 1 THEN 'toxic' END AS reason, source
FROM documents LEFT JOIN labels USING (doc_id)) SELECT reason, source, count(*) AS n FROM m WHERE reason IS NOT NULL GROUP BY reason, source""")
def _(s, d):
    j = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    reason = F.when(F.col("quality").isNull(), "unlabeled").when(F.col("quality") == 0, "low quality").when(F.col("toxic") == 1, "toxic")
    _, bad = W.quarantine(j, reason)
    return bad.groupBy("reason", "source").agg(F.count(F.lit(1)).alias("n"))


@Q.add("s11_merge_micro_shards", """WITH v AS (SELECT p_name AS label, row_number() OVER (ORDER BY p_name) + 3 AS id FROM (SELECT DISTINCT p_name FROM part WHERE p_size < 9))
SELECT p_partkey, COALESCE(id, -1) AS label_idx, [p_retailprice, 0.0] AS features FROM part LEFT JOIN v ON v.label = p_name""")
def _(s, d):
    part = table(s, d, "part")
    voc = C.build_vocab(part.where("p_size < 9").select(F.col("p_name").alias("token")))
    recs = part.select("p_partkey", F.col("p_name").alias("label"), F.array("p_retailprice", F.lit(float("nan"))).alias("features"))
    return W.merge_micro_shards(recs, voc).select("p_partkey", "label_idx", "features")


@Q.add("s11_repack", """WITH v AS (SELECT p_name AS label, row_number() OVER (ORDER BY p_name) + 3 AS id FROM (SELECT DISTINCT p_name FROM part WHERE p_size < 9)),
m AS (SELECT p_partkey, p_brand, COALESCE(id, -1) AS label_idx FROM part LEFT JOIN v ON v.label = p_name)
SELECT p_brand, (row_number() OVER w - 1) // 64 AS shard, row_number() OVER w - 1 AS place, p_partkey, label_idx FROM m WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)""")
def _(s, d):
    part = table(s, d, "part")
    voc = C.build_vocab(part.where("p_size < 9").select(F.col("p_name").alias("token")))
    recs = part.select("p_partkey", "p_brand", F.col("p_name").alias("label"), F.array("p_retailprice").alias("features"))
    packed = W.numbered_shards(W.merge_micro_shards(recs, voc), "p_brand", ["p_partkey"], 64)
    return packed.select("p_brand", "shard", "place", "p_partkey", "label_idx")


@Q.add("s12_filtered_article_corpus", f"""WITH a AS (SELECT doc_id AS page_id, string_split(text, chr(10)) AS sec FROM documents WHERE n_chars > 5000),
x AS (SELECT page_id, unnest(sec) AS text, unnest(generate_series(0, len(sec) - 1)) AS section FROM a),
t AS (SELECT page_id, section, {I.WORDS_SQL.format(c="text")} AS w FROM x WHERE length(trim(text)) >= 20)
SELECT page_id, CAST(section AS INTEGER) AS section, w[1:62] AS tokens FROM t WHERE len(w) >= 4""")
def _(s, d):
    docs = table(s, d, "documents")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("n_chars").alias("views"))
    return R.article_corpus(pages, docs.select(F.col("doc_id").alias("page_id"), F.split("text", "\n").alias("sections")))


@Q.add("s13_parallel_corpus", f"""WITH {I.PAIRS}, t AS (SELECT conv_id, turn, {I.WORDS_SQL.format(c="ref")} AS w FROM pair),
v AS (SELECT token, row_number() OVER (ORDER BY token) + 3 AS id FROM (SELECT DISTINCT unnest(w) AS token FROM t)),
p AS (SELECT conv_id * 100 + turn AS key, unnest(w) AS token, unnest(generate_series(1, len(w))) AS i FROM t)
SELECT key, list_concat(list_concat([1], list(COALESCE(id, 3) ORDER BY i)), [2]) AS ids FROM p LEFT JOIN v USING (token) GROUP BY key""")
def _(s, d):
    p = I.pairs(s, d).withColumn("key", F.col("conv_id") * 100 + F.col("turn"))
    voc = C.build_vocab(C.explode_tokens(p, I.words("ref")))
    return C.encode(p, I.words("ref"), voc, "key").select("key", R.with_bounds("ids").alias("ids"))


@Q.add("s14_media_catalog", """WITH f AS (SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '[?#].*$', '') AS n FROM pages),
g AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'cat' || page_id % 5 || '_' || n ELSE 'clip' || n END AS stem FROM f)
SELECT page_id, CASE WHEN stem = 'a' THEN 'Alphabet' WHEN contains(stem, '_') THEN split_part(stem, '_', 1) ELSE 'General' END AS category,
 CASE WHEN stem = 'a' THEN 'ASL Letter: A' WHEN contains(stem, '_') THEN substr(stem, instr(stem, '_') + 1) ELSE stem END AS title FROM g""")
def _(s, d):
    n = F.regexp_replace(F.substring_index("url", "/", -1), r"[?#].*$", "")
    k = F.col("page_id") % 3
    stem = F.when(k == 0, "a").when(k == 1, F.concat(F.lit("cat"), (F.col("page_id") % 5).cast("string"), F.lit("_"), n)).otherwise(F.concat(F.lit("clip"), n))
    f = table(s, d, "pages").select("page_id", F.concat(stem, F.lit(".mp4")).alias("file"))
    return R.name_parts(f, "file").drop("file")


@Q.add("s18_source_mix_union", """SELECT 'documents' AS source, doc_id AS id, text, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'benchmark', item_id, text, NULL FROM benchmark UNION ALL SELECT 'pages', page_id, url, NULL FROM pages""")
def _(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    bench = table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    pages = table(s, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("text"))
    done = table(s, d, "labels").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"))
    return R.source_mix({"documents": docs, "benchmark": bench, "pages": pages}, done)


@Q.add("p1_convert_layout", """SELECT vec_id, CAST(kp AS INTEGER) AS kp, round(embedding[((src * 5) % 64) + 1]::DOUBLE, 6) AS x FROM (
  SELECT vec_id, embedding, unnest(generate_series(0, 59)) AS kp, unnest(list_concat(list_concat(generate_series(25, 66), [1, 2, 3, 4, 5, 6]), generate_series(67, 74))) AS src FROM embeddings)
WHERE src IS NOT NULL""")
def _(s, d):
    v = F.col("embedding").cast("array<double>")
    f = table(s, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(74)), lambda i: F.struct(
        F.get(v, (i * 5) % 64).alias("x"), F.get(v, (i * 11) % 64).alias("y"))).alias("kps"))
    out = R.to_canonical(f, 75).select("vec_id", F.posexplode_outer("kps").alias("kp", "p"))
    return out.select("vec_id", "kp", F.round("p.x", 6).alias("x"))


@Q.add("a1_sample_quality", """WITH """ + BL.split("WITH ", 1)[1] + """,
st AS (SELECT clip_id, frame_idx, avg(d) AS st FROM (SELECT clip_id, frame_idx, kp, sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2 + (z - lag(z) OVER w)**2) AS d
  FROM body WINDOW w AS (PARTITION BY clip_id, kp ORDER BY frame_idx)) GROUP BY ALL),
pr AS (SELECT clip_id, frame_idx, bool_or(valid AND kp < 21)::INT AS l, bool_or(valid AND kp BETWEEN 21 AND 41)::INT AS r, avg(valid::INT) AS c FROM body GROUP BY ALL),
q AS (SELECT clip_id, avg(c) AS conf, GREATEST(avg(l), avg(r)) AS hands, count(*) AS n FROM pr GROUP BY clip_id), j AS (SELECT clip_id, avg(st) AS st FROM st GROUP BY clip_id)
SELECT clip_id, round(LEAST(1, GREATEST(0.1, 0.35 * conf + 0.25 + 0.2 * CASE WHEN n > 2 THEN LEAST(1, GREATEST(0, 1 - st * 2)) ELSE 0.9 END + 0.1 * hands + 0.1 * (90 / 150.0))), 6) AS quality
FROM q JOIN j USING (clip_id)""")
def _(s, d):
    conf = F.size(F.filter("kps", lambda p: p["valid"])) / F.size("kps")
    return r6(K.sample_quality(I.bodies(s, d), conf, F.lit(90.0)), "quality").drop("breakdown")


@Q.add("a2_video_quality", """WITH """ + BL.split("WITH ", 1)[1] + """,
a AS (SELECT clip_id, z, abs(x) > 1e-4 OR abs(y) > 1e-4 AS seen, sqrt((x - 2 * lag(x) OVER w + lag(x, 2) OVER w)**2 + (y - 2 * lag(y) OVER w + lag(y, 2) OVER w)**2) AS j
  FROM body WINDOW w AS (PARTITION BY clip_id, kp ORDER BY frame_idx))
SELECT clip_id, round(LEAST(1, GREATEST(0.25, avg(z) FILTER (WHERE seen))), 6) AS score, round(avg(z) FILTER (WHERE seen), 6) AS detector_conf,
  round(1 - LEAST(1, max(j) / 50), 6) AS temporal FROM a GROUP BY clip_id""")
def _(s, d):
    return r6(K.video_quality(I.bodies(s, d)), "score", "detector_conf", "temporal")


@Q.add("a3_static_quality", f"""WITH {I.HANDS} SELECT clip_id, frame_idx, round(LEAST(1, GREATEST(0.25, COALESCE(avg(z) FILTER (WHERE abs(x) > 1e-4 OR abs(y) > 1e-4), 0.85))), 6) AS score
FROM hand_pts GROUP BY clip_id, frame_idx""")
def _(s, d):
    return r6(K.static_quality(I.hands(s, d)), "score")


@Q.add("f17_augment_landmarks")
def _(s, d):
    return points(K.drop_points(K.augment(I.bodies(s, d), 5), 5))


@Q.add("f18_yaw_mask_flip")
def _(s, d):
    return points(K.flip_handedness(K.mask_hand_span(K.yaw(I.bodies(s, d), 5), 5)))


@Q.add("f3_normalize_vocabulary", """SELECT lower(p_name) AS token, min(p_partkey) AS id, count(*) > 1 AS collides FROM part GROUP BY 1""")
def _(s, d):
    v = table(s, d, "part").groupBy(F.lower("p_name").alias("token")).agg(F.min("p_partkey").alias("id"), (F.count(F.lit(1)) > 1).alias("collides"))
    return v.where(F.col("id") >= 0)


@Q.add("f21_confidence_gate", f"""WITH {I.EV} SELECT event_id, CASE WHEN accuracy > 0.8 THEN 'commit' WHEN accuracy >= 0.45 THEN 'accept' ELSE 'reject' END AS gate FROM act""")
def _(s, d):
    a = F.col("accuracy")
    return I.events(s, d).select("event_id", F.when(a > 0.8, "commit").when(a >= 0.45, "accept").otherwise("reject").alias("gate"))



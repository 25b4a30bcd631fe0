"""Nearest-item, lexicon and span queries over vectors, parts and turns."""

from pyspark.sql import functions as F

from tracklore.operators import decoding as D
from tracklore.operators import similarity as S
from tracklore.operators import tracks as T
from tracklore.plans import inputs as I
from tracklore.plans.registry import QuerySet
from tracklore.session import table

Q = QuerySet()
CEN = """e AS (SELECT vec_id, label, unnest(generate_series(1, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
cen AS (SELECT label AS code, i, avg(x) AS c FROM e GROUP BY label, i)"""


def vecs(s, d):
    return table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@Q.add("j12_zero_shot_classify", f"""WITH {CEN},
nn AS (SELECT code, sqrt(sum(c * c)) AS n FROM cen GROUP BY code), vn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY vec_id),
s AS (SELECT vec_id, code, sum(x * c) / any_value(vn.n) / any_value(nn.n) AS cos FROM e JOIN cen USING (i) JOIN nn USING (code) JOIN vn USING (vec_id) GROUP BY vec_id, code),
b AS (SELECT vec_id, max(cos) AS m, arg_max(code, cos) AS predicted FROM s GROUP BY vec_id)
SELECT b.vec_id, predicted, round(m, 6) AS similarity, round(1 / sum(exp(100 * (cos - m))), 5) AS probability
FROM s JOIN b ON b.vec_id = s.vec_id GROUP BY b.vec_id, predicted, m""")
def _(s, d):
    v = vecs(s, d)
    c = S.classify(v, "vec_id", "v", S.centroids(v, "v", "label"), "label", "centre")
    return r6(c, "similarity").withColumn("probability", F.round("probability", 5))


@Q.add("j12_retrieval_accuracy", f"""WITH {CEN}, nn AS (SELECT code, sqrt(sum(c * c)) AS n FROM cen GROUP BY code),
s AS (SELECT vec_id, any_value(label) AS label, code, sum(x * c) / any_value(nn.n) AS cos FROM e JOIN cen USING (i) JOIN nn USING (code) GROUP BY vec_id, code),
b AS (SELECT vec_id, any_value(label) AS label, arg_max(code, cos) AS p FROM s GROUP BY vec_id)
SELECT round(avg(CASE WHEN p = label THEN 1.0 ELSE 0.0 END) * 100, 6) AS accuracy FROM b""")
def _(s, d):
    v = vecs(s, d)
    c = S.classify(v, "vec_id", "v", S.centroids(v, "v", "label"), "label", "centre")
    return c.join(v.select("vec_id", "label"), "vec_id").agg(
        F.round(F.avg((F.col("predicted") == F.col("label")).cast("double")) * 100, 6).alias("accuracy"))


@Q.add("j21_nearest_code", f"""WITH {CEN}, s AS (SELECT vec_id, code, sum((x - c) * (x - c)) AS dist FROM e JOIN cen USING (i) GROUP BY vec_id, code)
SELECT vec_id, arg_min(code, (dist, code)) AS code, round(min(dist), 6) AS distance FROM s GROUP BY vec_id""")
def _(s, d):
    v = vecs(s, d)
    codes = S.centroids(v, "v", "label").withColumnRenamed("label", "code")
    return r6(S.nearest_code(v, "vec_id", "v", codes, "code", "centre"), "distance")


@Q.add("j11_hard_negatives", """WITH p AS (SELECT a.vec_id, b.vec_id AS negative, 0.4::DOUBLE * list_distance(a.embedding[1:16]::DOUBLE[], b.embedding[1:16]::DOUBLE[])
 + 0.3::DOUBLE * list_distance(a.embedding[17:32]::DOUBLE[], b.embedding[17:32]::DOUBLE[]) + 0.3::DOUBLE * list_distance(a.embedding[33:64]::DOUBLE[], b.embedding[33:64]::DOUBLE[]) AS d
 FROM embeddings a JOIN embeddings b ON a.label <> b.label)
SELECT vec_id, arg_min(negative, (round(d, 9), negative)) AS negative, round(min(d), 6) AS distance FROM p GROUP BY vec_id""")
def _(s, d):
    v = vecs(s, d).select("vec_id", "label", F.slice("v", 1, 16).alias("shape"), F.slice("v", 17, 16).alias("place"),
                          F.slice("v", 33, 32).alias("move"))
    out = S.hard_negatives(v, "vec_id", "label", {"a": ("shape", 0.4), "b": ("place", 0.3), "c": ("move", 0.3)})
    return r6(out, "distance")


@Q.add("j18_nearest_hand_template")
def _(s, d):
    h = I.hands(s, d).join(table(s, d, "embeddings").select(
        F.floor(F.col("vec_id") / I.CLIP).alias("clip_id"), (F.col("vec_id") % I.CLIP).cast("int").alias("frame_idx"), "label", "vec_id"),
        ["clip_id", "frame_idx"])
    b = h.select("vec_id", "label", S.bone_directions().alias("bones"))
    return r6(S.classify(b, "vec_id", "bones", S.centroids(b, "bones", "label"), "label", "centre"), "similarity", "probability")


@Q.add("j19_exemplar_alignment")
def _(s, d):
    v = vecs(s, d)
    return S.align_exemplars(v, "vec_id", "v", S.centroids(v, "v", "label"), "label", "centre")


def exemplars(s, d, states=3):
    """For each label the mean embeddings of its first, second and third frames of three."""
    v = vecs(s, d).withColumn("state", (F.col("vec_id") % states).cast("int"))
    e = v.select("label", "state", F.posexplode("v").alias("i", "x")).groupBy("label", "state", "i").agg(F.round(F.avg("x"), 9).alias("x"))
    return e.groupBy(F.col("label").alias("token"), "state").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "x"))), lambda x: x["x"]).alias("vec"))


@Q.add("j19_token_passing", f"""WITH RECURSIVE e AS (SELECT label AS w, CAST(vec_id % 3 AS INTEGER) AS s, unnest(generate_series(1, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
m AS (SELECT w, s, i, round(avg(x), 9) AS x FROM e GROUP BY ALL), ex AS (SELECT w, s, list(x ORDER BY i) AS v, max(s) OVER (PARTITION BY w) AS z FROM m GROUP BY w, s),
fr AS (SELECT vec_id // {I.CLIP} AS clip_id, CAST(row_number() OVER (PARTITION BY vec_id // {I.CLIP} ORDER BY vec_id) - 1 AS INTEGER) AS t, embedding::DOUBLE[] AS v FROM embeddings),
r(clip_id, t, w, s, z, v, cost, hist) AS (
  SELECT c.clip_id, -1, w, s, z, ex.v, CASE WHEN s = 0 THEN 0.0::DOUBLE ELSE 'infinity'::DOUBLE END, [{{'w': w, 't': 0}}] FROM (SELECT DISTINCT clip_id FROM fr) c, ex
  UNION ALL
  SELECT clip_id, t, w, s, z, v, least(cost, adv, trn) + d, CASE WHEN cost <= adv AND cost <= trn THEN hist WHEN adv <= trn THEN adv_h ELSE list_append(trn_h, {{'w': w, 't': t}}) END
  FROM (SELECT r.clip_id, r.t + 1 AS t, r.w, r.s, r.z, r.v, r.cost, r.hist, list_distance(fr.v, r.v) AS d,
      COALESCE(lag(r.cost) OVER word, 'infinity'::DOUBLE) AS adv, lag(r.hist) OVER word AS adv_h,
      CASE WHEN r.s = 0 THEN min(CASE WHEN r.s = r.z THEN r.cost END) OVER clip + 0.01::DOUBLE ELSE 'infinity'::DOUBLE END AS trn,
      first_value(r.hist) OVER (PARTITION BY r.clip_id ORDER BY CASE WHEN r.s = r.z THEN 0 ELSE 1 END, r.cost, r.w) AS trn_h
    FROM r JOIN fr ON fr.clip_id = r.clip_id AND fr.t = r.t + 1 WINDOW word AS (PARTITION BY r.clip_id, r.w ORDER BY r.s), clip AS (PARTITION BY r.clip_id))),
best AS (SELECT clip_id, t, cost, hist FROM r WHERE s = z QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY t DESC, cost, w) = 1)
SELECT clip_id, k - 1 AS number, hist[k].w AS token, hist[k].t AS first, COALESCE(hist[k + 1].t - 1, t) AS last, round(cost, 6) AS cost
FROM best, LATERAL (SELECT unnest(generate_series(1, len(hist))) AS k) WHERE t >= 0 AND cost < 'infinity'::DOUBLE""")
def _(s, d):
    v = vecs(s, d).withColumn("clip_id", F.floor(F.col("vec_id") / I.CLIP))
    return r6(D.token_spans(v, "clip_id", "vec_id", "v", exemplars(s, d), penalty=0.01), "cost")


LEX = "SELECT p_partkey, p_brand AS h, p_type AS t, p_size AS l FROM part"


@Q.add("j9_minimal_pairs", f"""WITH x AS ({LEX}) SELECT a.p_partkey, (SELECT count(*) FROM x b WHERE b.h = a.h AND b.t = a.t AND b.l <> a.l) AS pairs FROM x a""")
def _(s, d):
    lex = table(s, d, "part").select("p_partkey", F.col("p_brand").alias("handshape"), F.col("p_type").alias("signtype"),
                                     F.col("p_size").alias("location"))
    return S.minimal_pair_counts(lex, "p_partkey")


@Q.add("j10_lexicon_match", f"""WITH w AS (SELECT DISTINCT unnest({I.WORDS_SQL.format(c="text")}) AS word FROM documents),
x AS (SELECT split_part(p_name, ' ', 1) || CASE WHEN p_size % 2 = 0 THEN '_' || p_size ELSE '' END AS lemma, p_partkey AS entry FROM part
      UNION ALL SELECT split_part(text, ' ', 1) || '_1', item_id FROM benchmark),
a AS (SELECT lower(lemma) AS word, min(entry) AS e1 FROM x GROUP BY 1), b AS (SELECT regexp_replace(lower(lemma), '[0-9_\\-]', '', 'g') AS bare, min(entry) AS e2 FROM x GROUP BY 1)
SELECT w.word, COALESCE(e1, e2) AS entry FROM w LEFT JOIN a ON a.word = w.word LEFT JOIN b ON b.bare = regexp_replace(w.word, '[0-9_\\-]', '', 'g')""")
def _(s, d):
    from tracklore.operators import corpus as C

    words = C.explode_tokens(table(s, d, "documents"), I.words()).select(F.col("token").alias("word")).distinct()
    size = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("_"), F.col("p_size").cast("string"))).otherwise("")
    lex = table(s, d, "part").select(F.concat(F.substring_index("p_name", " ", 1), size).alias("lemma"), F.col("p_partkey").alias("entry"))
    more = table(s, d, "benchmark").select(F.concat(F.substring_index("text", " ", 1), F.lit("_1")).alias("lemma"), F.col("item_id").alias("entry"))
    return S.lexicon_match(words, lex.unionByName(more))


@Q.add("j13_weave_spelled_spans", f"""WITH {I.FRAMES}, g AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) AS isl FROM frames WHERE x >= 0),
sp AS (SELECT clip_id, min(frame_idx) AS s, max(frame_idx) + 1 AS e FROM g GROUP BY clip_id, isl HAVING count(*) >= 4),
tk AS (SELECT clip_id, frame_idx, 'w' || frame_idx AS word FROM frames WHERE frame_idx % 4 = 0),
al AS (SELECT clip_id, frame_idx, 0 AS kind, word FROM tk WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.clip_id = tk.clip_id AND tk.frame_idx >= s AND tk.frame_idx < e)
  UNION ALL SELECT clip_id, (s + e) // 2, 1, 'spelled' || (e - s) FROM sp)
SELECT clip_id, string_agg(word, ' ' ORDER BY frame_idx, kind, word) AS sentence FROM al GROUP BY clip_id""")
def _(s, d):
    f = I.frames(s, d)
    spans = T.spans(f, F.col("x") >= 0).withColumn("word", F.concat(F.lit("spelled"), (F.col("end") - F.col("start")).cast("string")))
    tokens = f.where(F.col("frame_idx") % 4 == 0).select(
        "clip_id", "frame_idx", F.concat(F.lit("w"), F.col("frame_idx").cast("string")).alias("token"))
    return S.weave(tokens, spans)

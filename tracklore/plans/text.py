"""Label, token and spelling queries over documents, turns, parts and pages."""

from pyspark.sql import functions as F

from tracklore.functions import edit
from tracklore.functions import text as X
from tracklore.operators import corpus as C
from tracklore.operators import decoding as D
from tracklore.operators import spelling as S
from tracklore.plans import inputs as I
from tracklore.plans.registry import QuerySet
from tracklore.session import table

Q = QuerySet()
WD = I.WORDS_SQL.format(c="text")
ASCII = "list_filter(list_transform({w}, lambda w: regexp_replace(w, '[^a-z]', '', 'g')), lambda w: length(w) > 1)"


def ascii_words(text="text"):
    return F.filter(F.transform(I.words(text), lambda w: F.regexp_replace(w, "[^a-z]", "")), lambda w: F.length(w) > 1)


def unigrams(s, d):
    t = C.explode_tokens(table(s, d, "benchmark"), ascii_words())
    return t.groupBy(F.col("token").alias("word")).agg(F.count(F.lit(1)).alias("freq"))


def bigrams(s, d):
    w = table(s, d, "benchmark").select(ascii_words().alias("w"))
    p = w.select(F.explode_outer(F.arrays_zip(F.slice("w", F.lit(1), F.greatest(F.lit(0), F.size("w") - 1)).alias("w1"),
                                              F.slice("w", F.lit(2), F.size("w")).alias("w2"))).alias("p"))
    return p.where("p.w2 is not null").groupBy("p.w1", "p.w2").agg(F.count(F.lit(1)).alias("freq"))


def spoken(s, d):
    c = table(s, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("key"), ascii_words().alias("w"))
    return c.select("key", F.posexplode_outer("w").alias("pos", "word")).where("word is not null")


UNI = f"""uni AS (SELECT word, count(*) AS freq FROM (SELECT unnest({ASCII.format(w=WD)}) AS word FROM benchmark) GROUP BY word)"""
SPOKEN = f"""spoken AS (SELECT conv_id * 100 + turn AS key, unnest({ASCII.format(w=WD)}) AS word FROM conversations)"""
GL = """trim(regexp_replace(translate(lower({c}), '_-', '  '), '[ \\t\\n\\r]+', ' ', 'g'))"""


@Q.add("f1_normalize_gloss", f"""SELECT p_partkey, {GL.format(c="p_brand || '_' || p_type || ' - ' || p_name")} AS gloss FROM part""")
def _(s, d):
    return table(s, d, "part").select("p_partkey", X.normalize_gloss(F.concat(
        F.col("p_brand"), F.lit("_"), F.col("p_type"), F.lit(" - "), F.col("p_name"))).alias("gloss"))


LABELS = """lb AS (SELECT p_partkey, p_name, CASE p_size % 5 WHEN 0 THEN '2:' || p_name || '??' WHEN 1 THEN 'bad*' || p_name || ' # note'
  WHEN 2 THEN replace(p_name, ' ', '!') WHEN 3 THEN '  ' ELSE p_name END AS proc FROM part)"""


@Q.add("f2_clean_spelled_label", f"WITH {LABELS} SELECT p_partkey, p_name AS label FROM lb")
def _(s, d):
    n, k = F.col("p_name"), F.col("p_size") % 5
    proc = (F.when(k == 0, F.concat(F.lit("2:"), n, F.lit("??"))).when(k == 1, F.concat(F.lit("bad*"), n, F.lit(" # note")))
            .when(k == 2, F.replace(n, F.lit(" "), F.lit("!"))).when(k == 3, F.lit("  ")).otherwise(n))
    return table(s, d, "part").select("p_partkey", X.clean_spelled_label(proc, "p_name").alias("label"))


ENG = """list_filter(string_split_regex(regexp_replace(lower(trim(text)), '([.?!,;:—\\-()\\[\\]"''])', ' \\1 ', 'g'), '[ \\t\\n\\r]+'), lambda w: w <> '')"""


@Q.add("f5_encode_english", f"""WITH voc AS (SELECT w, row_number() OVER (ORDER BY w) + 3 AS id FROM (SELECT DISTINCT unnest({ENG}) AS w FROM benchmark)),
p AS (SELECT item_id, unnest({ENG}) AS w, unnest(generate_series(1, len({ENG}))) AS i FROM benchmark),
e AS (SELECT item_id, list(COALESCE(id, 3) ORDER BY i) AS ids FROM p LEFT JOIN voc USING (w) GROUP BY item_id)
SELECT item_id, list_resize(ids[1:40], 40, 0) AS ids FROM e""")
def _(s, d):
    b = table(s, d, "benchmark")
    voc = C.build_vocab(C.explode_tokens(b, X.english_tokens("text")))
    enc = C.encode(b, X.english_tokens("text"), voc, "item_id")
    return enc.select("item_id", F.concat(F.slice("ids", 1, 40), F.array_repeat(
        F.lit(0).cast("bigint"), F.greatest(F.lit(0), 40 - F.size("ids")))).alias("ids"))


CHARS = """list_transform(list_filter(string_split(regexp_replace(lower(p_name), '[^a-z0-9 ]', '', 'g'), ''), lambda c: c <> ''),
  lambda c: CASE WHEN c = ' ' THEN 4 WHEN c BETWEEN 'a' AND 'z' THEN ascii(c) - 92 ELSE ascii(c) - 17 END)"""


@Q.add("f6_encode_chars", f"SELECT p_partkey, list_concat(list_concat([1], {CHARS}), [2]) AS ids FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", X.char_ids("p_name").alias("ids"))


@Q.add("f7_pad_keep_last", f"""WITH e AS (SELECT p_partkey, list_concat(list_concat([1], {CHARS}), [2]) AS ids FROM part)
SELECT p_partkey, CASE WHEN len(ids) > 10 THEN list_concat(ids[1:9], ids[-1:]) ELSE list_resize(ids, 10, 0) END AS ids FROM e""")
def _(s, d):
    return table(s, d, "part").select("p_partkey", X.pad_keep_last(X.char_ids("p_name"), 10).alias("ids"))


@Q.add("f8_oov_subword", """WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, unnest(generate_series(1, 2)) AS i FROM part),
v AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part WHERE p_size <= 10)
SELECT p_partkey, list_reduce(list(CASE WHEN v.w IS NOT NULL THEN [w.w] ELSE list_transform(string_split(upper(w.w), ''), lambda c: 'CHAR_' || c) END ORDER BY i),
  lambda a, b: list_concat(a, b)) AS pieces FROM w LEFT JOIN v ON v.w = w.w GROUP BY p_partkey""")
def _(s, d):
    part = table(s, d, "part")
    voc = part.where("p_size <= 10").select(F.substring_index("p_name", " ", 1).alias("w")).distinct().withColumn("known", F.lit(True))
    w = part.select("p_partkey", F.posexplode_outer(F.split("p_name", " ")).alias("i", "w")).join(voc, "w", "left")
    chars = F.transform(F.filter(F.split(F.upper("w"), ""), lambda c: c != ""), lambda c: F.concat(F.lit("CHAR_"), c))
    return w.groupBy("p_partkey").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(
        "i", F.when(F.col("known"), F.array("w")).otherwise(chars).alias("p")))), lambda x: x["p"])).alias("pieces"))


@Q.add("p2_p3_routing", """WITH r AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'ChicagoFS' WHEN 1 THEN 'how2sign_a' WHEN 2 THEN 'ASL_Citizen' WHEN 3 THEN 'wlasl'
  WHEN 4 THEN 'alphabet_x' WHEN 5 THEN 'digits' ELSE source END AS src, CASE doc_id % 3 WHEN 0 THEN 'sentence_level' WHEN 1 THEN 'isolated_gloss' ELSE 'fingerspelling_sequence' END AS task FROM documents)
SELECT doc_id, CASE WHEN lower(src) LIKE '%chicago%' THEN 1 WHEN lower(src) LIKE '%how2sign%' THEN 2 WHEN lower(src) LIKE '%citizen%' THEN 3 WHEN lower(src) LIKE '%wlasl%' THEN 4
  WHEN lower(src) LIKE '%alphabet%' THEN 5 WHEN lower(src) LIKE '%number%' OR lower(src) LIKE '%digit%' THEN 6 ELSE 0 END AS source_id,
  CASE WHEN task = 'fingerspelling_sequence' OR lower(src) LIKE '%chicago%' THEN 1 WHEN task = 'sentence_level' OR starts_with(lower(src), 'how2sign') THEN 2 ELSE 0 END AS task_id FROM r""")
def _(s, d):
    k = F.col("doc_id") % 8
    src = F.col("source")
    for i, n in enumerate(("ChicagoFS", "how2sign_a", "ASL_Citizen", "wlasl", "alphabet_x", "digits")):
        src = F.when(k == i, n).otherwise(src)
    t = F.col("doc_id") % 3
    task = F.when(t == 0, "sentence_level").when(t == 1, "isolated_gloss").otherwise("fingerspelling_sequence")
    r = table(s, d, "documents").select("doc_id", src.alias("src"), task.alias("task"))
    return r.select("doc_id", X.route_source("src").alias("source_id"), X.route_task("task", "src").alias("task_id"))


@Q.add("p4_drop_placeholder_labels", """SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'unknown' WHEN n_chars % 3 = 1 THEN lang ELSE '' END AS label FROM documents WHERE n_chars % 3 = 1""")
def _(s, d):
    n = F.col("n_chars") % 3
    label = F.when(n == 0, "unknown").when(n == 1, F.col("lang")).otherwise("")
    return table(s, d, "documents").select("doc_id", label.alias("label")).where(~F.lower(F.trim("label")).isin(*X.PLACEHOLDERS))


@Q.add("p5_supervision_flags", f"""SELECT doc_id, len({WD}) > 0 AND label IS NOT NULL AS has_valid_gloss, regexp_matches(lower(text), '[a-z0-9]') AS has_valid_chars,
lang = 'en' AND len({WD}) > 1 AS has_valid_english, len({WD}) <= 1 AS is_isolated FROM (SELECT d.*, l.quality AS label FROM documents d LEFT JOIN labels l USING (doc_id))""")
def _(s, d):
    j = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").withColumn("n", F.size(I.words()))
    return j.select("doc_id", ((F.col("n") > 0) & F.col("quality").isNotNull()).alias("has_valid_gloss"),
                    F.lower("text").rlike("[a-z0-9]").alias("has_valid_chars"),
                    ((F.col("lang") == "en") & (F.col("n") > 1)).alias("has_valid_english"), (F.col("n") <= 1).alias("is_isolated"))


NEG = ", ".join("'" + w.replace("'", "''") + "'" for w in X.NEGATIONS)


@Q.add("p6_negation_flag", f"SELECT doc_id, list_has_any({WD}, [{NEG}]) AS is_negated FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", X.has_negation("text").alias("is_negated"))


@Q.add("p9_catalog_search", """SELECT p_partkey, p_name, p_type FROM part WHERE lower(p_type) = 'small' AND (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring'))""")
def _(s, d):
    q = "ring"
    return table(s, d, "part").where((F.lower("p_type") == "small") & (
        F.lower("p_name").contains(q) | F.lower("p_brand").contains(q))).select("p_partkey", "p_name", "p_type")


@Q.add("p10_video_filter", """SELECT doc_id FROM documents WHERE lower(source) = 'src1' AND contains(lower(text), 'the')""")
def _(s, d):
    return table(s, d, "documents").where((F.lower("source") == "src1") & F.lower("text").contains("the")).select("doc_id")


@Q.add("p11_range_validate", """SELECT event_id, CASE WHEN value < 0 OR value > 100 THEN 'completion out of range' WHEN value / 20 > 5 THEN 'rating out of range' END AS reason
FROM events WHERE value < 0 OR value > 100 OR value / 20 > 5""")
def _(s, d):
    reason = F.when(~F.col("value").between(0, 100), "completion out of range").when(
        ~(F.col("value") / 20).between(0, 5), "rating out of range")
    return table(s, d, "events").select("event_id", reason.alias("reason")).where("reason is not null")


@Q.add("p13_pause_predicate", f"""WITH {I.FRAMES}, v AS (SELECT clip_id, frame_idx, abs(x - lag(x) OVER (PARTITION BY clip_id ORDER BY frame_idx)) AS sp FROM frames)
SELECT clip_id, frame_idx, COALESCE(sp, 0) < 0.08 AS is_pause FROM v""")
def _(s, d):
    from tracklore.operators import tracks as T

    k = T.simple_kinematics(I.frames(s, d))
    return k.select("clip_id", "frame_idx", (F.when(F.col("frame_idx") == 0, 0.0).otherwise(F.abs("vx")) < 0.08).alias("is_pause"))


@Q.add("p15_instructor_filter", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '00012')")
def _(s, d):
    return table(s, d, "customer").where(F.lower("c_name").contains("00012")).select("c_custkey")


@Q.add("f14_punctuate_capitalize", """SELECT p_partkey, upper(substr(p_name, 1, 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) || ' ' ||
CASE WHEN split_part(p_name, ' ', 2) = 'ring' THEN 'Ring' ELSE split_part(p_name, ' ', 2) END || '.' AS sentence FROM part""")
def _(s, d):
    return table(s, d, "part").select("p_partkey", X.sentence_case(F.split("p_name", " "), F.array(F.lit("ring"))).alias("sentence"))


@Q.add("f16_corrupt_tokens")
def _(s, d):
    return table(s, d, "part").select("p_partkey", X.corrupt_tokens(X.char_ids("p_name"), F.col("p_partkey"), 11).alias("ids"))


@Q.add("f28_mask_tokens", f"""WITH e AS (SELECT p_partkey, list_concat(list_concat([1], {CHARS}), [2]) AS ids FROM part)
SELECT p_partkey, CASE WHEN len(list_filter(ids, lambda x: x NOT IN (0, 1, 2))) > 3 THEN list_transform(ids, lambda x, i: CASE WHEN x NOT IN (0, 1, 2)
  AND CAST('0x' || substr(md5(p_partkey || ':' || (i - 1) || ':11'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE < 0.15 THEN 3 ELSE x END) ELSE ids END AS ids FROM e""")
def _(s, d):
    return table(s, d, "part").select("p_partkey", X.mask_tokens(X.char_ids("p_name"), F.col("p_partkey"), 11).alias("ids"))


@Q.add("f19_speed_bounds", """WITH e AS (SELECT item_id, 0.5 * (1 - cos(LEAST(1.0, item_id / 39.0::DOUBLE) * pi())) AS c FROM benchmark)
SELECT item_id, round(1 - c * 0.4, 6) AS s_min, round(1 + c * 0.6, 6) AS s_max FROM e""")
def _(s, d):
    curve = 0.5 * (1 - F.cos(F.least(F.lit(1.0), F.col("item_id") / 39.0) * F.pi()))
    return table(s, d, "benchmark").select("item_id", F.round(1 - curve * 0.4, 6).alias("s_min"), F.round(1 + curve * 0.6, 6).alias("s_max"))


@Q.add("f23_calendar", """SELECT event_id, CAST(date_trunc('day', ts) AS VARCHAR)[1:10] AS day, CAST(CAST(ts AS DATE) + 7 AS VARCHAR) AS week_end FROM events""")
def _(s, d):
    return table(s, d, "events").select("event_id", F.date_trunc("day", "ts").cast("date").cast("string").alias("day"),
                                        F.date_add(F.to_date("ts"), 7).cast("string").alias("week_end"))


@Q.add("f24_progress_json", f"""WITH {I.EV} SELECT user_id, CAST(sum(points) AS BIGINT) AS xp, count(*) AS n FROM act GROUP BY user_id""")
def _(s, d):
    g = I.events(s, d).groupBy("user_id").agg(F.sum("points").cast("bigint").alias("xp"), F.count(F.lit(1)).alias("n"))
    j = g.select("user_id", F.to_json(F.struct("xp", "n")).alias("j"))
    return j.select("user_id", F.from_json("j", "xp bigint, n bigint").alias("p")).select("user_id", "p.*")


@Q.add("f25_float_text", "SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6)) AS v FROM embeddings")
def _(s, d):
    e = table(s, d, "embeddings").select("vec_id", X.floats_to_text(F.col("embedding").cast("array<double>")).alias("t"))
    return e.select("vec_id", F.transform(X.text_to_floats("t"), lambda x: F.round(x, 6)).alias("v"))


@Q.add("f26_client_ip", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || (user_id % 40) WHEN event_id % 3 = 1 THEN '192.168.0.' || (user_id % 40) ELSE '127.0.0.1' END AS ip FROM events""")
def _(s, d):
    n, u = F.col("event_id") % 3, (F.col("user_id") % 40).cast("string")
    fwd = F.when(n == 0, F.concat(F.lit("10.0.0."), u, F.lit(", 8.8.8.8"))).otherwise("not an address")
    real = F.when(n == 1, F.concat(F.lit("192.168.0."), u))
    return table(s, d, "events").select("event_id", X.client_ip(fwd, real, F.lit("127.0.0.1")).alias("ip"))


@Q.add("j17_spelling_candidates", f"""WITH {UNI}, {SPOKEN}, q AS (SELECT DISTINCT word FROM spoken),
c AS (SELECT q.word, uni.word AS term, freq, levenshtein(q.word, uni.word) AS distance FROM q, uni WHERE abs(length(q.word) - length(uni.word)) <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, freq DESC, term) AS rank FROM c WHERE distance <= 2)
SELECT word, term, freq, CAST(distance AS INTEGER) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 12""")
def _(s, d):
    return S.candidates(spoken(s, d), unigrams(s, d))


@Q.add("f10_weighted_edit_distance")
def _(s, d):
    c = S.candidates(spoken(s, d), unigrams(s, d))
    return c.select("word", "term", F.round(edit.spelling_distance("word", "term"), 6).alias("cost"))


@Q.add("f11_correct_word")
def _(s, d):
    from pyspark.sql import Window

    before = F.lag("word").over(Window.partitionBy("key").orderBy("pos"))
    rows = spoken(s, d).select((F.col("key") * 100000 + F.col("pos")).alias("key"), "word", before.alias("prev"))
    return S.correct_words(rows, unigrams(s, d), bigrams(s, d), ["anna", "john"])


@Q.add("f12_correct_phrase")
def _(s, d):
    return S.correct_phrases(spoken(s, d), unigrams(s, d), bigrams(s, d), "key", ["anna", "john"])


BG = f"""bg AS (SELECT w1, w2, count(*) AS freq FROM (SELECT unnest(w[1:len(w)-1]) AS w1, unnest(w[2:len(w)]) AS w2
  FROM (SELECT {ASCII.format(w=WD)} AS w FROM benchmark)) GROUP BY w1, w2)"""


@Q.add("j14_bigram_context", f"""WITH {BG}, s AS (SELECT conv_id * 100 + turn AS key, {ASCII.format(w=WD)} AS w FROM conversations),
p AS (SELECT key, unnest(generate_series(1, len(w) - 1)) AS pos, unnest(w[1:len(w)-1]) AS w1, unnest(w[2:len(w)]) AS w2 FROM s WHERE len(w) > 1)
SELECT key, CAST(pos AS INTEGER) AS pos, round(COALESCE(-log10(GREATEST(10, freq)) * 0.25, 0), 6) AS score FROM p LEFT JOIN bg USING (w1, w2)""")
def _(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("pos")
    p = spoken(s, d).withColumn("w1", F.lag("word").over(w)).where("w1 is not null").withColumnRenamed("word", "w2")
    score = F.coalesce(-F.log10(F.greatest(F.lit(10), F.col("freq"))) * 0.25, F.lit(0.0))
    return p.join(bigrams(s, d), ["w1", "w2"], "left").select("key", "pos", F.round(score, 6).alias("score"))


@Q.add("o2_prefix_completion", f"""WITH {UNI}, {SPOKEN}, p AS (SELECT DISTINCT substr(word, 1, 2) AS prefix FROM spoken)
SELECT prefix, CAST(rank AS INTEGER) AS rank, word, freq FROM (SELECT prefix, word, freq, row_number() OVER (PARTITION BY prefix ORDER BY freq DESC, word) AS rank
FROM p JOIN uni ON starts_with(uni.word, prefix)) WHERE rank <= 5""")
def _(s, d):
    p = spoken(s, d).select(F.substring("word", 1, 2).alias("prefix")).distinct()
    return S.complete(p, unigrams(s, d))


@Q.add("o3_prefix_existence", f"""WITH {UNI}, {SPOKEN}, p AS (SELECT DISTINCT substr(word, 1, 4) AS prefix FROM spoken)
SELECT prefix, prefix IN (SELECT word FROM uni) AS is_word FROM p WHERE EXISTS (SELECT 1 FROM uni WHERE starts_with(uni.word, prefix))""")
def _(s, d):
    return S.known_prefixes(spoken(s, d).select(F.substring("word", 1, 4).alias("prefix")), unigrams(s, d))


@Q.add("o10_session_lexicon_union", f"""SELECT conv_id, list_sort(list_distinct(list_concat(['anna', 'john'], list_distinct(flatten(list({WD})))))) AS lexicon FROM conversations GROUP BY conv_id""")
def _(s, d):
    w = C.explode_tokens(table(s, d, "conversations"), I.words(), "conv_id").distinct()
    return w.groupBy("conv_id").agg(F.array_sort(F.array_union(
        F.array(F.lit("anna"), F.lit("john")), F.collect_set("token"))).alias("lexicon"))


@Q.add("f13_segment_unspaced", "SELECT p_partkey AS key, p_name AS text FROM part")
def _(s, d):
    part = table(s, d, "part")
    words = C.explode_tokens(part, F.split("p_name", " ")).groupBy(F.col("token").alias("word")).agg(F.count(F.lit(1)).alias("freq"))
    t = part.select(F.col("p_partkey").alias("key"), F.replace("p_name", F.lit(" "), F.lit("")).alias("text"))
    return D.segment(t, words).select("key", "text")


@Q.add("f15_dictionary_translate", """WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part),
x AS (SELECT p_partkey, p_name = 'red ring' AS ph, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_size % 2 = 0 AS q FROM part),
o AS (SELECT p_partkey, q, CASE WHEN ph THEN 'nhẫn đỏ' ELSE 'v' || a || ' ' || CASE WHEN b IN (SELECT w FROM w) THEN 'v' || b ELSE b END END AS o FROM x)
SELECT p_partkey, upper(substr(o, 1, 1)) || substr(o, 2) || CASE WHEN q THEN '?' ELSE '.' END AS translated FROM o""")
def _(s, d):
    part = table(s, d, "part")
    first = F.substring_index("p_name", " ", 1)
    words = part.select(first.alias("word")).distinct().withColumn("translation", F.concat(F.lit("v"), F.col("word")))
    phrases = part.where("p_name = 'red ring'").select(F.col("p_name").alias("phrase"), F.lit("nhẫn đỏ").alias("translation")).distinct()
    sent = part.withColumn("t", F.concat("p_name", F.when(F.col("p_size") % 2 == 0, "?").otherwise("!")))
    return S.translate(sent, "p_partkey", "t", words, phrases)

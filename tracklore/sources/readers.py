"""Readers for transcripts, indexes, keypoint arrays, media and logs.

Every reader names its schema; only header names are looked at while planning.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklore.functions.vectors import let
from tracklore.operators import ordered
from tracklore.sources.ranges import json_objects

ID_NAMES = ("sentence_name", "clip_id", "video_id", "id", "name", "filename")
TEXT_NAMES = ("sentence", "text", "transcript", "translation", "label", "gloss")
# fixed values: where the canonical 60 points sit in other layouts
LAYOUTS = {
    543: [*range(468, 489), *range(522, 543), 500, 501, 512, 513, 502, 503,
          1, 4, 152, 0, 33, 263, 61, 291, 10, 109, 338, 9],
    133: [*range(91, 133), 5, 6, 11, 12, 7, 8, 23, 31, 37, 39, 41, 46, 52, 55, 74, 77, 85, 88],
    75: [*range(25, 67), 1, 2, 3, 4, 5, 6, *range(67, 75)],
    60: [*range(60)],
}


def resolve_column(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """First column whose name equals a candidate, else one that contains it."""
    lower = {c.lower().strip(): c for c in columns}
    for n in names:
        if n in lower:
            return lower[n]
    return next((c for n in names for k, c in lower.items() if n in k), None)


def _file_order(file: str, paths: Sequence[str]) -> int:
    """Which of the given paths a file belongs to: the same place, or a folder above it."""
    place = lambda p: "/" + re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", p).strip("/")
    mine = place(unquote(file))
    exact = [i for i, p in enumerate(paths) if mine == place(p) and (":/" not in p or p.split(":/")[0] == file.split(":/")[0])]
    above = [i for i, p in enumerate(paths) if mine.startswith(place(p) + "/")]
    return (exact or above or [len(paths)])[-1]


def _columns(header: str) -> tuple[str, int, int, int]:
    """Separator, places of id and text, and number of columns of a header."""
    sep = max("\t,;|", key=header.count)
    names = next(csv.reader([header], delimiter=sep))
    unique = [n if n not in names[:i] else f"{n} {i}" for i, n in enumerate(names)]
    key = resolve_column(unique, ID_NAMES) or unique[0]
    text = resolve_column([c for c in unique if c != key], TEXT_NAMES) or unique[-1]
    return sep, unique.index(key), unique.index(text), len(unique)


def transcripts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """clip_id and text of delimited files; later files win over earlier ones, later lines over earlier ones.

    The delimiter is the one of , ; tab | that splits the header most.  A header
    without a known name for the id or the text gives its first or last column.  Each row
    answers to its id and to the id without a front-camera suffix.
    All files are one scan: one job gives the first line of every file that has one, and a line is cut by the header of its file.
    Lines equal to the header of their file are headers.
    """
    empty = spark.createDataFrame([], "clip_id string, text string")
    if not paths:
        return empty
    lines = spark.read.text(list(paths)).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row_no")).where(F.trim("line") != "")
    heads = lines.where("block = 0").groupBy("file").agg(F.min_by("line", "row_no").alias("header")).collect()
    if not heads:
        return empty
    known = [(h.file, h.header, _file_order(h.file, paths), *_columns(h.header)) for h in heads]
    files = spark.createDataFrame(known, "file string, header string, file_no int, sep string, key int, place int, width int")
    schema = ", ".join(f"c{i} string" for i in range(max(k[-1] for k in known)))

    def cells(sep: str) -> Column:
        row = F.from_csv("line", schema, {"sep": sep, "quote": '"', "escape": '"'})
        return let(row, lambda r: F.array(*[r[f"c{i}"] for i in range(max(k[-1] for k in known))]))

    cut = F.lit(None)
    for sep in sorted({k[3] for k in known}):
        cut = F.when(F.col("sep") == sep, cells(sep)).otherwise(cut)
    rows = lines.join(files, "file").where("line <> header").withColumn("cells", cut).select(
        "file_no", "file", "block", "row_no", F.trim(F.get("cells", "key")).alias("raw"), F.trim(F.get("cells", "place")).alias("text"))
    clean = F.regexp_replace("raw", r"[-_]rgb_front", "")
    both = rows.where((F.col("raw") != "") & (F.col("text") != "")).withColumn(
        "clip_id", F.explode(F.array_distinct(F.array("raw", clean))))
    return both.groupBy("clip_id").agg(F.max_by("text", F.struct("file_no", "file", "block", "row_no")).alias("text"))


def attach_transcripts(clips: DataFrame, texts: DataFrame, default: str = "") -> DataFrame:
    """Text by clip id, else by the id without its camera suffix, else a default."""
    c = clips.withColumn("__clean", F.regexp_replace("clip_id", r"[-_]rgb_front", ""))
    j = c.join(texts.withColumnRenamed("text", "__t1"), "clip_id", "left")
    j = j.join(texts.select(F.col("clip_id").alias("__clean"), F.col("text").alias("__t2")), "__clean", "left")
    return j.withColumn("text", F.coalesce("__t1", "__t2", F.lit(default))).drop("__clean", "__t1", "__t2")


NESTED = T.StructType([
    T.StructField("gloss", T.StringType()),
    T.StructField("instances", T.ArrayType(T.StructType([
        T.StructField("video_id", T.StringType()), T.StructField("split", T.StringType()),
        T.StructField("frame_start", T.IntegerType()), T.StructField("frame_end", T.IntegerType()),
        T.StructField("signer_id", T.IntegerType())])))])


def nested_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per instance; the 1-based first frame becomes 0-based. The file is read by byte ranges."""
    rows = json_objects(spark, [path]).select(F.from_json("json", NESTED).alias("r"))
    return rows.select("r.gloss", F.explode("r.instances").alias("i")).select(
        F.lower("gloss").alias("gloss"), "i.video_id", "i.split", F.greatest(F.lit(0), F.col("i.frame_start") - 1).alias("frame_start"),
        "i.frame_end", "i.signer_id")


def split_csvs(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One file per split; carries lexicon code and participant."""
    schema = "participant string, video string, gloss string, lex_code string"
    parts = [spark.read.csv(p, header=True, schema=schema).select(
        *[F.trim(c).alias(c) for c in ("participant", "video", "gloss", "lex_code")], F.lit(s).alias("split"))
        for s, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def partition_split(v: Column | str) -> Column:
    v = F.lower(F.col(v) if isinstance(v, str) else v)
    return F.when(v.contains("dev") | v.contains("val"), "val").when(v.contains("test"), "test").otherwise("train")


def partitioned_index(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, schema="filename string, label string, partition string")
    return rows.where(F.trim("label") != "").withColumn("split", partition_split("partition"))


def to_canonical(frames: DataFrame, points: int) -> DataFrame:
    """Pick the 60 canonical points; a missing third channel becomes 0.85."""
    idx = F.array(*[F.lit(i) for i in LAYOUTS[points]])
    fields = {f.name for f in frames.schema["kps"].dataType.elementType.fields}
    z = (lambda p: p["z"]) if "z" in fields else (lambda p: F.lit(0.85))
    pick = lambda i: F.get("kps", i)
    return frames.withColumn("kps", F.transform(idx, lambda i: F.struct(
        pick(i)["x"].alias("x"), pick(i)["y"].alias("y"), z(pick(i)).alias("z"))))


ARRAYS = "path string, clip_id string, frame_idx int, points int, kps array<struct<x:double,y:double,z:double>>, reason string"


def keypoint_arrays(spark: SparkSession, path: str) -> DataFrame:
    """.npy files as frames; wrong rank or point count comes back with a reason."""
    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, blob in zip(pdf["path"], pdf["content"]):
                clip = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    a = np.load(io.BytesIO(blob), allow_pickle=False)
                except ValueError as exc:
                    yield pd.DataFrame([(p, clip, None, None, None, f"unreadable: {exc}")])
                    continue
                if a.ndim == 2 and a.shape[1] % 3 == 0:
                    a = a.reshape(len(a), -1, 3)
                if a.ndim != 3 or a.shape[1] not in LAYOUTS or a.shape[2] < 2:
                    yield pd.DataFrame([(p, clip, None, None, None, f"bad shape {a.shape}")])
                    continue
                if a.shape[2] == 2:
                    a = np.concatenate([a, np.full((*a.shape[:2], 1), 0.85)], axis=2)
                a = np.nan_to_num(a[..., :3].astype(float))
                a = a[:, LAYOUTS[a.shape[1]]]
                yield pd.DataFrame([(p, clip, t, 60, [dict(zip("xyz", map(float, k))) for k in frame], None)
                                    for t, frame in enumerate(a)])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInPandas(load, ARRAYS)


def media_catalog(spark: SparkSession, path: str, glob: str = "*.mp4") -> DataFrame:
    """Title and category from file names; the part before the first '_' is the category."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "modificationTime", "length")
    return name_parts(files.withColumn("file", F.substring_index("path", "/", -1)), "file")


def name_parts(files: DataFrame, file: str) -> DataFrame:
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    letter = stem.rlike("^[A-Za-z]$")
    has = F.instr(stem, "_") > 0
    return files.withColumn("category", F.when(letter, "Alphabet").when(has, F.substring_index(stem, "_", 1)).otherwise("General")).withColumn(
        "title", F.when(letter, F.concat(F.lit("ASL Letter: "), F.upper(stem))).when(
            has, F.substr(stem, F.instr(stem, "_") + 1)).otherwise(stem))


def media_listing(files: DataFrame) -> DataFrame:
    return files.orderBy(F.desc("modificationTime"), "path")


AUDIT = "EventType string, UserId string, Email string, IpAddress string, Status string, Timestamp timestamp, Details string"


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).json(path)


def audit_log_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(AUDIT).json(path).withWatermark("Timestamp", "1 day")


def training_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric rows; malformed lines are dropped, 'acc' is also read as 'accuracy'."""
    header = spark.read.text(path).limit(1).collect()[0][0].split(",")
    schema = ", ".join(f"`{h.strip()}` double" for h in header)
    rows = spark.read.csv(path, header=True, schema=schema, mode="DROPMALFORMED")
    return rows.withColumnRenamed("acc", "accuracy")


def parallel_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Gloss and text pairs of a delimited file, empty ones dropped."""
    rows = spark.read.csv(path, header=True)
    g, t = resolve_column(rows.columns, ("gloss", "asl", "source")), resolve_column(rows.columns, ("text", "english", "target"))
    pairs = rows.select(F.trim(F.col(f"`{g}`")).alias("gloss"), F.trim(F.col(f"`{t}`")).alias("text"))
    return pairs.where((F.col("gloss") != "") & (F.col("text") != ""))


def with_bounds(ids: Column | str) -> Column:
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.concat(F.array(F.lit(1).cast("bigint")), ids, F.array(F.lit(2).cast("bigint")))


def article_corpus(pages: DataFrame, articles: DataFrame, views: int = 5000, chars: int = 20, words: int = 4,
                   max_len: int = 64, cap: int | None = None) -> DataFrame:
    """Sections of well-read pages, long enough, as at most max_len - 2 tokens.

    ``cap`` is the optional corpus size of the feature; by default all rows stay.
    """
    ok = articles.join(pages.where(F.col("views") > views), "page_id", "left_semi")
    s = ok.select("page_id", F.posexplode("sections").alias("section", "text")).where(F.char_length(F.trim("text")) >= chars)
    tok = s.withColumn("tokens", F.filter(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda w: w != ""))
    out = tok.where(F.size("tokens") >= words).select("page_id", "section", F.slice("tokens", 1, max_len - 2).alias("tokens"))
    return out if cap is None else out.orderBy("page_id", "section").limit(cap)


def source_mix(parts: dict[str, DataFrame], done: DataFrame | None = None) -> DataFrame:
    """Corpora in one record schema, each row with its source; finished ids skipped."""
    out = None
    for name, df in parts.items():
        one = df.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out if done is None else out.join(done, ["source", "id"], "left_anti")


def hand_wide(hands: DataFrame, key: str) -> DataFrame:
    """63 columns, three per joint rounded to six places, and the triples as JSON."""
    cols = [F.round(F.get("kps", F.lit(i))[c], 6).alias(f"{c}{i}") for i in range(21) for c in "xyz"]
    triples = F.to_json(F.transform("kps", lambda p: F.array(*[F.round(p[c], 6) for c in "xyz"])))
    return hands.select(key, *cols, triples.alias("landmarks"))


def number_rows(files: DataFrame, name: str = "id") -> DataFrame:
    """Sequential ids along the file names."""
    return ordered.positions(files, [F.col("file")], name)

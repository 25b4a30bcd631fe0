"""A training corpus in five stages: quality rules, near duplicates, decontamination, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
`documents`. Rows are told apart by a hash of doc_id and text, so rows that share a doc_id are judged each by its
own text; exactly repeated rows are one document, told by two such hashes, so that no other text is taken for one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.llm import decontamination, packing, pseudonyms, quality_rules, set_join, store

KEY = "demonstration key"  # a real run passes its own secret
ORACLE_SQL = None  # shingle components, token ids and keyed pseudonyms have no SQL; see tests/llm/test_pipeline.py


def _named(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_uid", F.xxhash64("doc_id", "text"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects."""
    return quality_rules.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents, the one with the smallest doc_id (a null doc_id comes last).

    Documents are linked by a Jaccard similarity of 0.8 or more of their 5-word shingles; op3's 4 words and 0.85 are its own.
    """
    rows = _named(docs)
    linked = set_join.linked(rows.select(F.col("_uid").alias("doc_id"), "text"), k=5, percent=80).select(F.col("doc_id").alias("_uid"), F.col("component_id").alias("_group"))
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_uid")
    first = rows.select("_uid", "doc_id").join(linked.distinct(), "_uid").groupBy("_group").agg(F.min(order)["_uid"].alias("_uid"))
    return rows.join(store.kept(first.select("_uid"), "representatives"), "_uid").withColumn(
        "_more", F.xxhash64(F.lit(1), "text", "doc_id")).dropDuplicates(["_uid", "_more"]).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    rows = _named(docs)
    judged = decontamination.decontaminate(rows.select(F.col("_uid").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = store.kept(judged.where("contaminated").select(F.col("doc_id").alias("_uid")), "contaminated")
    return rows.join(bad, "_uid", "left_anti").select(*docs.columns)


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal numbers, dates and addresses replaced; n_chars, where it is a column, follows the text."""
    names = docs.columns
    out = pseudonyms.pseudonymised(docs, KEY).toDF(*names, "_found").drop("_found")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their ids and their places in sequences."""
    return packing.packed(spark, docs, with_ids=True)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("pseudonyms", pseudonymised),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

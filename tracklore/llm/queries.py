"""Registered queries of the operators and of the pipeline, with their SQL where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.plans.registry import QuerySet
from tracklore.session import shared_dir

from . import decontamination, discriminant, license_scan, merkle, packing, pseudonyms, quality_rules, set_join, spelling_groups, sql, substring_dedup, token_files, toxicity, warc

Q = QuerySet()
PUBLIC_KEY = "demonstration key"  # a real run passes its own secret


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@Q.add("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(spark, read(spark, sf_dir, "documents"))


@Q.add("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(spark, read(spark, sf_dir, "documents"))


@Q.add("op4_quality_discriminant")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discriminant.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@Q.add("op5_pseudonyms")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.report(read(spark, sf_dir, "documents"), PUBLIC_KEY)


@Q.add("op7_warc_archives", sql.WARC)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archives(spark, read(spark, sf_dir, "pages"))


@Q.add("op8_quality_rules", sql.quality(quality_rules.RULES, quality_rules.mask(quality_rules.BASE), quality_rules.mask(quality_rules.POLICIES["v2"])))
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(read(spark, sf_dir, "documents"))


@Q.add("op9_license_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


@Q.add("op10_decontamination", sql.DECONTAMINATION)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@Q.add("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(read(spark, sf_dir, "documents")).withColumn("repeated", F.col("n_removed") > 0)


@Q.add("op3_set_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.linked(read(spark, sf_dir, "documents"))


@Q.add("op11_spelling_groups", sql.SPELLING)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.groups(read(spark, sf_dir, "documents"))


@Q.add("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@Q.add("op13_merkle_manifest", sql.merkle())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(read(spark, sf_dir, "documents"))


@Q.add("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)

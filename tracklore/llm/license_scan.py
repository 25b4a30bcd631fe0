"""Operator 9: license scans by diagonal voting, in DataFrame functions only.

Every word 2-gram of a document is hashed and joined with the positions of the same gram in the templates (fixed texts
below, so the broadcast side is bounded). A hit votes for the diagonal `place in document - place in template`; votes
are summed before the shuffle, neighbouring diagonals of one template are merged (a word more or less), and a span
with enough votes is verified against the document's words. Phrases must match in full and count as base places;
notices count when most of their words stand in the span.

Defined results: null and empty texts have no words, no places, empty label strings and score 0. Rows of equal
doc_id are joined to the spans of all of them and verified against their own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklore.functions.vectors import let

from . import store

#: Fixed values of the contract: words of a phrase and the label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what separates words
#: Openings of common public license notices, in words of the same definition.
NOTICES = {
    "mit": ["released under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "apache": ["licensed under the apache license version 2 0",
               "you may not use this file except in compliance with the license you may obtain a copy of the license at"],
    "gpl": ["this work is licensed under the gnu general public license version 3",
            "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"],
    "lgpl": ["under the terms of the gnu lesser general public license as published by the free software foundation"],
    "agpl": ["under the terms of the gnu affero general public license as published by the free software foundation"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc": ["this work is licensed under a creative commons attribution 4 0 international license"],
}
SHIFT = 2  # diagonals that far apart are one
VOTES = 0.5  # share of a notice's grams that must vote for a span to be verified
LEAST = 0.75  # share of a notice's words that must stand in the span


def words(text: Column) -> Column:
    """Words of a text in lower case (letters beyond A-Z are never told apart by these templates)."""
    none = F.array().cast("array<string>")

    def trimmed(w: Column) -> Column:  # a separator at either end leaves an empty word there
        first, last = (F.when(F.element_at(w, i) == "", 1).otherwise(0) for i in (1, -1))
        return F.when(F.size(w) > first + last, F.slice(w, first + 1, F.size(w) - first - last)).otherwise(none)

    return let(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), trimmed)


def grams(rows: DataFrame, key: str, w: str, place: str) -> DataFrame:
    """key, place, gram: the rolling hash of each pair of neighbouring words (the last word stands alone and is left out)."""
    n = F.size(w)
    pairs = F.arrays_zip(F.slice(w, 1, n - 1).alias("a"), F.slice(w, 2, n - 1).alias("b"), F.sequence(F.lit(0), n - 2).alias("p"))
    return rows.where(n >= 2).select(key, F.inline(pairs).alias("a", "b", place)).select(key, place, F.xxhash64("a", "b").alias("gram"))


def templates(spark: SparkSession) -> DataFrame:
    """template, label, phrase (exact or not), text."""
    rows = [(i, label, True, text) for i, (text, label) in enumerate(PHRASES.items())]
    rows += [(len(rows) + i, label, False, text) for i, (label, text) in enumerate((k, t) for k, ts in NOTICES.items() for t in ts)]
    return spark.createDataFrame(rows, "template int, label string, phrase boolean, text string").withColumn("words", F.split("text", " "))


def row_name() -> Column:
    """Rows are told apart by doc_id and text, so rows without a doc_id are no group; spans are verified on the words of each row."""
    return F.xxhash64("doc_id", "text")


def spans(docs: DataFrame) -> DataFrame:
    """Merged candidate spans: scan_doc, template, label, phrase, at (place of the template's first word), last (place behind), words."""
    known = templates(docs.sparkSession)
    marks = F.broadcast(grams(known, "template", "words", "spot"))
    n_grams = F.size("words") - 1
    given = docs.select(row_name().alias("scan_doc"), words(F.col("text")).alias("w"))
    hits = grams(given, "scan_doc", "w", "pos").join(marks, "gram")
    votes = hits.groupBy("scan_doc", "template", (F.col("pos") - F.col("spot")).alias("diagonal")).agg(
        F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    votes = votes.join(F.broadcast(known.select("template", "label", "phrase", "words")), "template")
    votes = store.kept(votes.where(F.when(F.col("phrase"), F.col("n") >= n_grams).otherwise(F.col("n") > 1)), "votes")  # read twice
    exact = votes.where("phrase").select(
        "scan_doc", "label", "phrase", "words", F.col("diagonal").alias("at"), (F.col("diagonal") + F.size("words")).alias("end"))
    line = Window.partitionBy("scan_doc", "template").orderBy("diagonal")
    loose = votes.where("not phrase").withColumn("new", (F.col("diagonal") - F.lag("diagonal", 1, -1_000_000).over(line) > SHIFT).cast("int"))
    loose = loose.withColumn("run", F.sum("new").over(line)).groupBy("scan_doc", "template", "run").agg(
        F.sum("n").alias("n"), F.min("first").alias("at"), (F.max("last") + 2).alias("end"), *(F.first(c).alias(c) for c in ("label", "phrase", "words")))
    loose = loose.where(F.col("n") >= VOTES * n_grams).select("scan_doc", "label", "phrase", "words", "at", "end")
    return exact.unionByName(loose)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    docs = docs.select("doc_id", "text")
    per_doc = spans(docs).groupBy("scan_doc").agg(F.collect_list(F.struct("label", "phrase", "words", "at", "end")).alias("spans"))
    # few or many documents with spans: texts are always joined by the same plan
    joined = docs.join(per_doc.hint("merge"), row_name() == F.col("scan_doc"), "left").select("doc_id", words(F.col("text")).alias("w"), "spans")

    def share(s: Column) -> Column:
        there = F.slice(F.col("w"), s["at"] + 1, s["end"] - s["at"])
        exact = F.when(there == s["words"], 1.0).otherwise(0.0)
        kinds = F.size(F.array_distinct(s["words"]))
        return F.when(s["phrase"], exact).otherwise(F.size(F.array_intersect(s["words"], there)) / kinds)

    empty = F.array().cast("array<struct<label:string,phrase:boolean,at:int,share:double>>")
    verified = F.filter(
        F.transform("spans", lambda s: F.struct(s["label"].alias("label"), s["phrase"].alias("phrase"), s["at"].alias("at"), share(s).alias("share"))),
        lambda s: s["share"] >= F.when(s["phrase"], 1.0).otherwise(LEAST))
    found = joined.select("doc_id", F.size("w").cast("long").alias("n_words"), F.coalesce(F.when(F.col("spans").isNotNull(), verified), empty).alias("v"))
    base = F.filter("v", lambda s: s["phrase"])
    names = lambda v: F.array_join(F.array_sort(F.array_distinct(F.transform(v, lambda s: s["label"]))), ",")
    starts = F.array_sort(F.transform(base, lambda s: s["at"].cast("long")))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("v")).alias("labels"), F.coalesce(F.array_max(F.transform("v", lambda s: s["share"])), F.lit(0.0)).alias("score"))

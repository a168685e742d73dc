"""License scan by diagonal voting.

Every text becomes words; all its rolling word k-gram hashes (k = 2, as the shortest phrases have two words) are
joined to the positions of the same k-grams in the templates. A hit at text position i and template position j votes
for the diagonal i - j; votes are a set of template positions, so that merging them is idempotent and the same hit
never counts twice, and templates may have any length. Neighbouring diagonals (within `DRIFT` inserted or missing words) are merged, and a span is
verified by the share of the template's k-grams that it holds, each compared word by word. Phrases need all of their
k-grams on one diagonal, which is the exact test.

The template table is a constant of this module, so its broadcast is bounded; hits are aggregated on the map side
before they are dealt out by document and template, and the texts themselves are never shuffled.

Defined results: a null or empty text has no words and no labels, score 0; texts of any length are scanned whole;
equal rows of a document are separate rows with equal results; an empty table gives an empty table; of the input
only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetspark.llm.common import as_documents

#: Base phrases: label and words.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: Longer notices that the method looks for itself.
NOTICES = {
    "apache": "licensed under the apache license version 2 0",
    "agpl": "gnu affero general public license version 3",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-sa": "creative commons attribution share alike 4 0 international license",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "lgpl": "gnu lesser general public license as published by the free software foundation",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "warranty": "the software is provided as is without warranty of any kind express or implied",
}
K = 2
#: Words that a verified span may have more or fewer than its template before a diagonal is another one.
DRIFT = 2
#: Share of a notice's k-grams that a span must hold.
COVER = 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """lower(), but for the two letters that it would turn into ASCII letters; those become private-use ones."""
    return F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ue000")), F.lit("\u0130"), F.lit("\ue001")))


def words(text: Column) -> Column:
    """ASCII letters and digits and all other characters from U+0080 on, in maximal runs, A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def templates(spark: SparkSession, notices: dict[str, str] = NOTICES) -> DataFrame:
    """A row for each k-gram of each template."""
    rows = []
    for exact, table in ((True, PHRASES), (False, notices)):
        for label, phrase in table.items():
            w = phrase.split()
            rows += [(label, exact, len(w) - K + 1, j, w[j], w[j + 1]) for j in range(len(w) - K + 1)]
    out = spark.createDataFrame(rows, "label string, exact boolean, grams int, j int, t0 string, t1 string")
    return out.withColumn("hash", F.xxhash64("t0", "t1"))


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES) -> DataFrame:
    """A row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    notices gives labels and their words, lower-cased, one space apart; whole licence texts may be among them.
    """
    docs = as_documents(docs, ["doc_id", "text"]).withColumn("mark", F.xxhash64("text"))
    texts = docs.withColumn("words", words(F.col("text"))).drop("text")
    grams = texts.where(F.size("words") >= K).select("doc_id", "mark", "words", F.explode(F.sequence(F.lit(0), F.size("words") - K)).alias("i"))
    grams = grams.select("doc_id", "mark", "i", F.get("words", F.col("i")).alias("w0"), F.get("words", F.col("i") + 1).alias("w1"))
    table = F.broadcast(templates(docs.sparkSession, notices))
    hits = grams.join(table, (F.xxhash64("w0", "w1") == F.col("hash")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")))
    diagonals = hits.groupBy("doc_id", "mark", "label", "exact", "grams", (F.col("i") - F.col("j")).alias("diagonal")).agg(F.collect_set("j").alias("votes"))
    merged = F.array_distinct(F.flatten(F.collect_list("votes").over(Window.partitionBy("doc_id", "mark", "label").orderBy("diagonal").rangeBetween(0, DRIFT))))
    cover = F.size(F.when(F.col("exact"), F.col("votes")).otherwise(F.col("merged"))) / F.col("grams")
    spans = diagonals.withColumn("merged", merged).withColumn("cover", cover)
    held = F.when(F.col("exact"), F.col("cover") == 1).otherwise(F.col("cover") >= COVER)
    base = held & F.col("exact")
    found = spans.groupBy("doc_id", "mark").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(held, F.col("label")))), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    counted = texts.select("doc_id", "mark", F.size("words").cast("long").alias("n_words"))
    same = (counted["doc_id"].eqNullSafe(found["doc_id"])) & (counted["mark"] == found["mark"])
    return counted.join(found, same, "left").select(
        counted["doc_id"], "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )

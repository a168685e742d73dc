"""From raw documents to token ids: quality, line dedup, near-duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet in the
shared folder and reads it again as the next one's documents, so that a lost executor costs at most one stage's work.
All but the last return the columns of documents; n_chars follows the text where a stage changes it.

Defined results, for every stage: an empty table gives an empty table; equal rows are treated alike, but that the near
copies among them are reduced to one; columns besides doc_id, text, lang, source and n_chars pass through, whatever
their names and types, but for the last stage. Nulls and ties are stated with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetspark.llm import decontamination, language_model, line_dedup, pieces, simhash
from facetspark.llm.common import drop_staged, read, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limits; those without a word go, a null lang is a language
    of its own, a null doc_id stays, and a doc_id goes with all its rows."""
    return language_model.keep_good(docs, read(spark, sf_dir, "labels"))


def line_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sites, but for each line's first place (the least doc_id, then
    position); a null source is no site, a null text stays null, and a null doc_id keeps its lines."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: a similarity of 0.8 or more on shingles of five words. The least doc_id
    stays, a null one only if there is no other; documents without words are one group."""
    return simhash.first_of_group(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of every benchmark item's shingles; a null text or doc_id stays, an item without
    words leaks into none, and a doc_id goes with all its rows."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the number of tokens, a row for each document; a null or empty text has no ids."""
    return pieces.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", contamination),
    ("sentencepiece_encoding", encoding),
]
#: Stages with a language model and a codec are beyond SQL; tests hold the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
        if before is not None:
            drop_staged(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""Quality rules: a threshold table compiled into one projection, evaluated without user functions.

`RULES` names each rule, the SQL of its measure and the bounds that it must keep within; `compile_rules` turns the
table into columns. Nothing is shuffled.

Measures: words are maximal runs of other characters than ASCII white space; lines end at \\n. A line counts as a
repeat if it has a word and equals an earlier line. n_repeat_words counts the words that lie in 3-word windows found
twice or more in the text: window hashes (64 bits, each word hashed by itself) are sorted, and only texts with equal
hashes go on to sort them with their positions, so that the cost stays n log n for texts of any length and repetition.

Defined results: a null text counts as one without words; it fails the base rule (fewer than 50 words), as an empty
one does. Equal rows stay separate rows; an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetspark.llm.common import as_documents, once

SPACE = r"[\x20\x09-\x0D]+"
#: Common words of the languages at hand, by which running prose is told from lists and noise.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with by this be from at or an have not "
    "le la les de des du et en un une que qui dans pour par sur est au aux ce il pas avec "
    "der die das und den von zu mit ist im dem nicht ein eine auf fur für es sich als auch "
    "el los las y del que en un una por con para es se no al lo como más su"
).split()
#: Name, measure (SQL over the measured columns), least and greatest value kept (None: no bound).
RULES = (
    ("word_length", "word_chars / n_words", 2.0, 14.0),
    ("symbol_ratio", "n_symbols / n_words", None, 0.1),
    ("exclaimed_ratio", "n_exclaimed / n_words", None, 0.2),
    ("stop_word_ratio", "n_stop_words / n_words", 0.02, None),
    ("repeat_line_ratio", "n_dup_lines / greatest(n_lines, 1)", None, 0.6),
    ("letter_ratio", "n_lettered / n_words", 0.7, None),
)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules use."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = as_documents(docs, ["doc_id", "text"]).select("doc_id", text.alias("text"), once(F.array_remove(F.split(text, SPACE), "")).alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    grams = F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("grams", once(grams))
    placed = F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h: bigint, i: int>>"))
    out = out.withColumn("placed", once(placed))
    equal = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    out = out.withColumn("again", once(F.sort_array(F.transform(F.filter("placed", lambda x, i: equal(F.get("placed", i - 1), x) | equal(F.get("placed", i + 1), x)), lambda x: x["i"]))))
    n_repeat = F.aggregate(F.transform("again", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("again", i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    many = lambda c: F.size(c).cast("long")
    return out.select(
        "doc_id",
        many("words").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (many("lines") - many(F.array_distinct("lines"))).alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
        many("lines").alias("n_lines"),
        F.regexp_count("text", F.lit(r"!(?=[\x20\x09-\x0D]|$)")).cast("long").alias("n_exclaimed"),
        F.regexp_count(F.lower("text"), F.lit(r"(?<![^\x20\x09-\x0D])(?:" + "|".join(sorted(set(STOP_WORDS))) + r")(?![^\x20\x09-\x0D.,;:])")).cast("long").alias("n_stop_words"),
        F.regexp_count("text", F.lit(r"[A-Za-z\x{80}-\x{10FFFF}][^\x20\x09-\x0D]*")).cast("long").alias("n_lettered"),
    )


def compile_rules(rules=RULES) -> tuple[Column, Column]:
    """The verdict and the comma-joined names of the rules that fail."""
    fails = []
    for name, value, low, high in rules:
        bounds = [b for b in (None if low is None else F.expr(f"{value} < {low}D"), None if high is None else F.expr(f"{value} > {high}D")) if b is not None]
        fails.append((name, reduce(lambda a, b: a | b, bounds)))
    failed = F.concat_ws(",", *[F.when(bad, F.lit(name)) for name, bad in fails])
    return ~reduce(lambda a, b: a | b, [bad for _, bad in fails]), failed


def apply_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """A row for each document: doc_id, n_words, the base measures, base_failed, kept, failed_rules."""
    good, failed = compile_rules(rules)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = measure(docs).withColumn("base_failed", base)
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), False).otherwise(good).alias("kept"),
        F.when(F.col("base_failed"), F.lit("base")).otherwise(failed).alias("failed_rules"),
    )

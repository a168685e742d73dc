"""Benchmark decontamination by size-partitioned MinHash containment search; DataFrame functions only.

Sets are the distinct shingles of five words; an item leaks into a document that holds at least 0.8 of its shingles.

Search. Test items are partitioned by their number of shingles n, in powers of two. An item's sketch is the set of
its m least shingle hashes (bottom-m MinHash), m = n - ceil(0.8 n) + 1: a document that holds 0.8 of the item's
shingles can miss m - 1 of them at most, so it must hold one of the sketch. The search therefore loses no leak,
however long the document is, where fixed-length signatures would drown a short item in a long text. Every size
partition has its own least number of shingles, by which documents that are too short for it are left out. In one pass
over the text, a document's shingle hashes up to the greatest one in any sketch are looked up in the sketches.

Verification. Documents found this way, and no others, are joined with their items once more and the shingles are
compared as words: exact containment.

Skew. The sketches are broadcast only if they are few (`BROADCAST_ROWS`, otherwise the join is shuffled, hot hashes
being dealt anew by Spark's handling of skewed joins); hits are made distinct on the map side before any shuffle, and
pairs of a document and an item are leaks or near-leaks, which grow with what leaks and not with its square.

Defined results: words are lower-cased runs of ASCII letters and digits and all characters from U+0080 on; fewer than
five words make one shingle of all of them; a null or empty text or item has no shingle, so it neither leaks nor holds
anything; equal rows of a document give the pair once; benchmark rows with the same item_id and text count once;
empty tables give no pairs; of the inputs only doc_id, text and item_id, text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetspark.llm.common import as_documents, checked_broadcast, column, stage

SHINGLE = 5
CONTAINED = 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of sketches, or of pairs, that are broadcast; beyond it joins are shuffled.
BROADCAST_ROWS = 1_000_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _shingles(df: DataFrame, *keys: str) -> DataFrame:
    """keys, n (shingles, repeats included), words and i, a row for each shingle of df(keys, words)."""
    last = F.greatest(F.size("words") - SHINGLE, F.lit(0))
    return df.where(F.size("words") > 0).select(*keys, "words", (last + 1).alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("i"))


def _hash() -> Column:
    return F.xxhash64(*[F.get("words", F.col("i") + j) for j in range(SHINGLE)])


def _shingle() -> Column:
    """The shingle as words; beyond the end of a short text there are none."""
    return F.concat_ws(" ", *[F.get("words", F.col("i") + j) for j in range(SHINGLE)])


def sketches(items: DataFrame, contained: float = CONTAINED) -> tuple[DataFrame, DataFrame]:
    """The shingles of all items, and the hashes of the sketches: item_id, size (partition), least (shingles), hash."""
    every = _shingles(as_documents(items, ["item_id", "text"]).withColumn("words", _words(F.col("text"))).drop("text"), "item_id")
    every = every.select("item_id", _hash().alias("hash"), _shingle().alias("shingle")).distinct()
    grouped = every.groupBy("item_id").agg(F.sort_array(F.collect_set("hash")).alias("hashes")).withColumn("n", F.size("hashes"))
    need = F.ceil(F.lit(contained) * F.col("n") - 1e-9).cast("int")
    cut = grouped.withColumn("need", need).withColumn("size", F.floor(F.log2("n")).cast("int"))
    return every, cut.select("item_id", "size", "need", F.explode(F.slice("hashes", 1, F.col("n") - F.col("need") + 1)).alias("hash"))


def leaks(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """A row for each document and item that leaks into it: doc_id, item_id, n_shared, n_item, containment."""
    every, sketch = sketches(items, contained)
    sketch = stage(sketch, "sketches")
    shingles = stage(every, "benchmark-shingles")
    # A partition's sketches have no hash beyond its bound, and a document with fewer shingles than its least need holds
    # none of its items; there are as many partitions as items have powers of two of shingles.
    bounds = sketch.groupBy("size").agg(F.max("hash").alias("bound"), F.min("need").alias("least")).collect()
    may = F.lit(False)
    for b in bounds:
        may |= (F.col("n") >= b["least"]) & (F.col("hash") <= b["bound"])
    least = min([b["least"] for b in bounds], default=1)
    texts = as_documents(docs, ["doc_id", "text"])
    words = texts.withColumn("words", _words(F.col("text"))).drop("text")
    rolled = _shingles(words, "doc_id").where(F.col("n") >= least).withColumn("hash", _hash()).where(may).select("doc_id", "n", "hash")
    wanted = checked_broadcast(sketch.groupBy("hash", "size").agg(F.min("need").alias("need")), BROADCAST_ROWS)
    found = rolled.join(wanted, "hash").where("n >= need").select("doc_id", "hash").distinct()
    pairs = stage(found.join(sketch.select("hash", "item_id"), "hash").select("doc_id", "item_id").distinct(), "candidate-pairs")
    suspects = checked_broadcast(pairs.select("doc_id").distinct(), BROADCAST_ROWS)
    again = _shingles(texts.join(suspects, "doc_id", "left_semi").withColumn("words", _words(F.col("text"))).drop("text"), "doc_id")
    table = checked_broadcast(shingles, BROADCAST_ROWS)
    held = again.withColumn("hash", _hash()).join(table, "hash").where(_shingle() == F.col("shingle")).select("doc_id", "item_id", "shingle")
    shared = held.groupBy("doc_id", "item_id").agg(F.count_distinct("shingle").alias("n_shared"))
    sizes = shingles.groupBy("item_id").agg(F.count("*").alias("n_item"))
    share = F.col("n_shared") / F.col("n_item")
    return shared.join(F.broadcast(sizes) if _few(sizes) else sizes, "item_id").where(F.col("n_shared") >= F.ceil(F.lit(contained) * F.col("n_item") - 1e-9)).select("doc_id", "item_id", "n_shared", "n_item", share.alias("containment"))


def _few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def clean(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """The documents that no item leaks into, with all their columns; a doc_id goes with all its rows, a null one stays."""
    leaked = stage(leaks(docs, items, contained).select("doc_id").distinct(), "leaked")
    return docs.join(checked_broadcast(leaked, BROADCAST_ROWS), column(docs, "doc_id") == leaked["doc_id"], "left_anti")

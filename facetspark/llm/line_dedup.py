"""Line dedup by distinct-site spread; DataFrame functions only.

A line that stands on many sites (sources) is boilerplate. One pass builds, for each line hash, a HyperLogLog sketch
of its sites; sketches merge by aggregation, on the map side first, so that a line with a third of all rows costs no
task more than any other. Lines whose estimate is clear of the threshold are decided by it; those within a band around
it get exact distinct counts in a second pass over them alone. Of a boilerplate line, the first place (the least
doc_id, then position) stays and all others go, so no content is lost.

Lines end at \\n and are compared without the spaces, tabs and carriage returns around them. The count of sites alone
decides, for short lines and for scripts without spaces as for all others; only blank lines are never removed. Hashes
have 96 bits.

Defined results: a null source is no site; a null text stays null, an empty one stays empty; a null doc_id comes after
all others, so that a line's first place is in a document with an id wherever there is one; equal rows (of one doc_id,
null or not, and text) are treated alike, and a kept first place is kept in all of them; texts of any length are one
row's work, linear in their lines; an empty table gives an empty table. Columns other than doc_id, text and source pass
through unread, whatever their names; counts replace input columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetspark.llm.common import as_documents, checked_broadcast, column, drop_staged, fresh, once, stage

MIN_SITES = 10
LG_K = 12
#: Relative half-width of the band in which lines get exact counts: over 15 standard errors of the sketch.
BAND = 0.25


def _lines(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, mark, pos, key, check and the columns of more, a row for each line that may be removed."""
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("mark"), *more, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    bare = rows.withColumn("line", F.expr("trim(BOTH ' \t\r' FROM line)")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return bare.select("doc_id", "mark", "pos", *more, F.xxhash64("line").alias("key"), F.hash("line").alias("check"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """key, check and first (no_id, doc_id, mark, pos) of the lines that stand on min_sites sites or more."""
    lines = _lines(docs, "source")
    grouped = lines.groupBy("key", "check").agg(
        F.count("source").alias("n"), F.hll_sketch_agg("source", LG_K).alias("sites"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark", "pos")).alias("first"),
    )
    spread = stage(grouped.where(F.col("n") >= min_sites).select("key", "check", "first", F.hll_sketch_estimate("sites").alias("estimate")).where(F.col("estimate") >= min_sites * (1 - band) - 1), "line-spread")
    sure = spread.where(F.col("estimate") > min_sites * (1 + band) + 1)
    near = spread.where(F.col("estimate") <= min_sites * (1 + band) + 1)
    exact = lines.join(checked_broadcast(near.select("key", "check")), ["key", "check"]).groupBy("key", "check").agg(F.count_distinct("source").alias("n_sites"))
    counted = near.join(exact.where(F.col("n_sites") >= min_sites).select("key", "check"), ["key", "check"], "left_semi")
    out = stage(sure.unionByName(counted).select("key", "check", "first"), "boilerplate")
    drop_staged(spread)
    return out


def _without(lines: Column, drops: Column) -> Column:
    """lines without those at the sorted positions drops: the slices between them."""
    before = lambda j: F.when(j == 0, F.lit(-1)).otherwise(F.get(drops, j - 1))
    at = lambda j: F.coalesce(F.get(drops, j), F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(drops)), lambda j: F.slice(lines, before(j) + 2, at(j) - before(j) - 1)))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, counts: bool = False) -> DataFrame:
    """docs with all their columns, text without repeated boilerplate; counts adds n_lines and n_removed."""
    read = as_documents(docs, ["doc_id", "text", "source"])
    table = checked_broadcast(boilerplate(read, min_sites, band))
    hits = _lines(read).join(table, ["key", "check"])
    elsewhere = ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("mark") != F.col("first.mark")) | (F.col("pos") != F.col("first.pos"))
    of, mark, at, split = (fresh(docs, name) for name in ("of_document", "of_text", "drop_at", "split_lines"))
    drops = hits.where(elsewhere).groupBy(F.col("doc_id").alias(of), F.col("mark").alias(mark)).agg(F.sort_array(F.collect_set("pos")).alias(at))
    joined = docs.join(drops, docs["doc_id"].eqNullSafe(drops[of]) & (F.xxhash64(docs["text"]) == drops[mark]), "left")
    joined = joined.withColumn(split, once(F.split("text", "\n")))
    text = F.when(F.col(at).isNull(), F.col("text")).otherwise(F.array_join(_without(F.col(split), F.col(at)), "\n"))
    more = [F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(at), F.lit(0)).cast("long").alias("n_removed")] if counts else []
    own = [c for c in docs.columns if not (counts and c.lower() in ("n_lines", "n_removed"))]
    return joined.select(*[text.alias("text") if c == "text" else column(docs, c) for c in own], *more)

"""Columns of the descriptor matrix in long form md(mol_id, type, cnt): masks, correlation filter, TF-IDF, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetspark.operators.graph import written
from facetspark.operators.numbering import numbered

#: Bytes of types, a name and a number each, that may be broadcast.
TYPE_BYTES = 32 << 20


def nonzero_columns(md: DataFrame, value: str = "cnt") -> DataFrame:
    """Rows of the columns that have a positive entry."""
    good = md.groupBy("type").agg(F.max(F.col(value) > 0).alias("any")).where("any").select("type")
    return md.join(good, "type", "left_semi")


def variance_corr_filter(md: DataFrame, value: str = "value", var_tol: float = 1e-9, corr_tol: float = 0.99) -> DataFrame:
    """The types that stay: sample variance at least var_tol, and no signed correlation above corr_tol with any column of
    a lesser type. md holds every cell, zeros included. (A column is compared while all lesser ones are still there, so
    the order of removal doesn't matter.) Sums of products are aggregated by pair of columns on the map side."""
    s = md.groupBy("type").agg(F.var_samp(value).alias("var"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sigma"))
    varied = s.where(F.col("var") >= var_tol)
    z = md.join(varied, "type").select("mol_id", "type", ((F.col(value) - F.col("mean")) / F.col("sigma")).alias("z"))
    a = z.select("mol_id", F.col("type").alias("t1"), F.col("z").alias("z1"))
    b = z.select("mol_id", F.col("type").alias("t2"), F.col("z").alias("z2"))
    high = a.join(b, "mol_id").where("t1 < t2").groupBy("t1", "t2").agg(F.avg(F.col("z1") * F.col("z2")).alias("corr")).where(F.col("corr") > corr_tol)
    # A column without variance is compared by none: its correlation is undefined.
    return varied.select("type").join(high.select(F.col("t2").alias("type")).distinct(), "type", "left_anti")


def tfidf(md: DataFrame, n_objects: int) -> DataFrame:
    """mol_id, type, weight: cnt * (ln((1 + n) / (1 + df)) + 1), not normalised. md has each cell once.

    df is counted on the map side; types of at most TYPE_BYTES are broadcast, so that no cell is shuffled;
    otherwise cells go by type, unsorted: a task holds its share of the types.
    """
    df = md.where("cnt > 0").groupBy("type").agg(F.count("*").alias("df"))
    idf = written(df.select("type", (F.log((1.0 + n_objects) / (1.0 + F.col("df"))) + 1.0).alias("idf")))
    size = idf.agg(F.coalesce(F.sum(16 + F.octet_length(F.col("type").cast("string"))), F.lit(0))).first()[0]
    return md.join(F.broadcast(idf) if size <= TYPE_BYTES else idf.hint("shuffle_hash"), "type").select("mol_id", "type", (F.col("cnt") * F.col("idf")).alias("weight"))


def f_scores(md: DataFrame, labels: DataFrame, value: str = "value") -> DataFrame:
    """type, f: the one-way ANOVA F of each column over the classes; md holds every cell."""
    joined = md.join(labels.select("mol_id", "y"), "mol_id")
    by = joined.groupBy("type", "y").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))
    w = Window.partitionBy("type")
    total = by.withColumn("all_n", F.sum("n").over(w)).withColumn("all_mean", F.sum(F.col("n") * F.col("mean")).over(w) / F.col("all_n"))
    s = total.groupBy("type").agg(F.sum(F.col("n") * (F.col("mean") - F.col("all_mean")) * (F.col("mean") - F.col("all_mean"))).alias("between"), F.sum(F.col("n") * F.col("var")).alias("within"), F.count("*").alias("k"), F.max("all_n").alias("n"))
    return s.select("type", F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))).alias("f"))


def best_columns(scores: DataFrame, k: int, score: str = "f") -> DataFrame:
    """The k best columns, ties by type: the feature is the limit."""
    return scores.orderBy(F.desc_nulls_last(score), "type").limit(k)


def slack_columns(md: DataFrame, objects: DataFrame, value: float, constant: bool = False, first: int | None = None) -> DataFrame:
    """md(mol_id, type, value) with a column for each object appended: value on its own row (or on all rows)."""
    start = first if first is not None else (md.agg(F.max("type")).first()[0] or 0) + 1
    own = numbered(objects.select("mol_id").distinct(), ["mol_id"], "type", start).withColumn("type", F.col("type").cast("int"))
    if constant:
        own = own.select("type").join(objects.select("mol_id").distinct(), F.lit(True))
    return md.select("mol_id", "type", "value").unionByName(own.select("mol_id", "type", F.lit(float(value)).alias("value")))

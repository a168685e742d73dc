"""Pairs and triples of an object's points, their types, and count histograms: the descriptor matrix in long form.

All joins are local to the object (and level), which is their equi-key; histograms aggregate on the map side. A third
of all points may belong to one object: pairs are joined on (object, salt), the salt dealing the first points of pairs
over `SALTS` tasks and the second ones to each of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetspark.functions.expressions import bin_of, distance, mixed_radix

SALTS = 8


def number_points(df: DataFrame, obj: str, order: Sequence[str]) -> DataFrame:
    """Adds p, the point's number within its object from 0, by a total order."""
    return df.withColumn("p", F.row_number().over(Window.partitionBy(obj).orderBy(*order)) - 1)


def pairs(points: DataFrame, keys: Sequence[str] = ("mol_id",), carry: Sequence[str] = ("type",), coords: Sequence[str] = ("x", "y", "z"), salts: int = 1) -> DataFrame:
    """Unordered pairs p1 < p2 of points with equal keys: keys, p1, p2, each carried column as c1, c2, and dist."""
    own = points.select(*keys, "p", *carry, *coords)
    a = own.select(*keys, *[F.col(c).alias(f"{c}1") for c in ("p", *carry, *coords)])
    b = own.select(*keys, *[F.col(c).alias(f"{c}2") for c in ("p", *carry, *coords)])
    on = list(keys)
    if salts > 1:
        a = a.withColumn("_salt", F.pmod("p1", F.lit(salts)).cast("int"))
        b = b.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on += ["_salt"]
    both = a.join(b, on).where("p1 < p2")
    return both.select(*keys, "p1", "p2", *[f"{c}{i}" for c in carry for i in (1, 2)], distance([F.col(f"{c}1") for c in coords], [F.col(f"{c}2") for c in coords]).alias("dist"))


def level_windows(points: DataFrame, levels: int, overlap: int = 1) -> DataFrame:
    """Points repeated for each pair level that they belong to: a pair level is overlap + 1 neighbouring point levels."""
    last = levels - 1 - overlap
    span = F.sequence(F.greatest(F.col("level") - overlap, F.lit(0)), F.least(F.col("level"), F.lit(last)))
    return points.where(F.col("level") < levels).select("*", F.explode(span).alias("pair_level"))


def pair_code(t1: Column, t2: Column, types: int, bins: Column, n_bins: int, level: Column | None = None, levels: int = 1) -> Column:
    """Mixed-radix code of (level, lesser type, greater type, distance bin)."""
    head = [(level, levels)] if level is not None else []
    return mixed_radix([*head, (F.least(t1, t2), types), (F.greatest(t1, t2), types), (bins, n_bins)])


def pair_histogram(points: DataFrame, types: int, thresholds: Sequence[float], keys: Sequence[str] = ("mol_id",), salts: int = 1) -> DataFrame:
    """keys, type (the pair code) and cnt."""
    found = pairs(points, keys, salts=salts).withColumn("bin", bin_of(F.col("dist"), thresholds))
    code = pair_code(F.col("type1"), F.col("type2"), types, F.col("bin"), len(thresholds) + 1)
    return found.groupBy(*keys, code.alias("type")).agg(F.count("*").alias("cnt"))


def triples(points: DataFrame, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """mol_id, p1 < p2 < p3, types and the three sides."""
    ab = pairs(points, coords=coords)
    third = ab.select("mol_id", F.col("p1").alias("p2"), F.col("p2").alias("p3"), F.col("type2").alias("type3"), F.col("dist").alias("d23"))
    rest = ab.select("mol_id", "p1", F.col("p2").alias("p3"), F.col("dist").alias("d13"))
    two = ab.withColumnRenamed("dist", "d12").join(third, ["mol_id", "p2"])
    return two.join(rest, ["mol_id", "p1", "p3"]).select("mol_id", "p1", "p2", "p3", "type1", "type2", "type3", "d12", "d13", "d23")


def triple_histogram(points: DataFrame, thresholds: Sequence[float], coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """mol_id, type, cnt: the code of the three sides' bins in ascending order."""
    n = len(thresholds) + 1
    bins = F.sort_array(F.array(*[bin_of(F.col(d), thresholds) for d in ("d12", "d13", "d23")]))
    coded = triples(points, coords).withColumn("_bins", bins)
    code = mixed_radix([(F.get("_bins", F.lit(i)), n) for i in range(3)])
    return coded.groupBy("mol_id", code.alias("type")).agg(F.count("*").alias("cnt"))


def top_types(md: DataFrame, k: int) -> DataFrame:
    """The k types with the greatest total counts, ties by type: a report."""
    return md.groupBy("type").agg(F.sum("cnt").alias("total"), F.count("*").alias("n_objects")).orderBy(F.desc("total"), "type").limit(k)


def to_matrix(md: DataFrame, types: Sequence[int]) -> DataFrame:
    """Dense rows for export: mol_id and a column for each type."""
    return md.groupBy("mol_id").pivot("type", list(types)).agg(F.first("cnt")).na.fill(0)


def all_distances(points: DataFrame, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    return pairs(points, carry=(), coords=coords)


def below_level_limit(found: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows of found(level, dist) below their level's limit; limits(level, high) has a row for each of a few levels."""
    return found.join(F.broadcast(limits), "level").where("dist < high").drop("high")

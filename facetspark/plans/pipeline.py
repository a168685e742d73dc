"""The descriptor pipeline end to end: surfaces' points to a labelled descriptor matrix.

Stages with a global barrier in between, each written to the shared folder before the next reads it: extrema of the scale space become points, their values' quantiles become
types, pairs by level get cascading distance thresholds, and histograms become the matrix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetspark.functions.expressions import bin_of, mixed_radix
from facetspark.operators.detect import finder
from facetspark.operators.graph import written
from facetspark.operators.pairs import pairs
from facetspark.operators.stats import cascade_thresholds, quantile_thresholds
from facetspark.sources.config import Options


def singular_points(vertices: DataFrame, edges: DataFrame, near: DataFrame, sigmas: list[float], options: Options) -> DataFrame:
    """points(mol_id, level, v, kind, value) with their coordinates."""
    how = {"sigmas": sigmas, "kind": options.detector, "channels": options.channels_combining} if options.use_levels else {}
    found = finder(options.use_levels, **how).find(vertices, edges, near)
    return found.join(vertices.select("mol_id", "v", "x", F.col("value").alias("property")), ["mol_id", "v"])


def classify(points: DataFrame, k: int) -> tuple[DataFrame, int]:
    """Types of points: the kind of extremum and the quantile class of the property; and how many there are."""
    cuts = quantile_thresholds(points, "property", k)
    kind = F.when(F.col("kind") == 1, 1).otherwise(0)
    return points.withColumn("type", mixed_radix([(kind, 2), (bin_of(F.col("property"), cuts), len(cuts) + 1)])), 2 * (len(cuts) + 1)


def descriptor_matrix(points: DataFrame, types: int, bins: int) -> DataFrame:
    """mol_id, type, cnt: pairs of points of a level, by types, level and distance class."""
    numbered = points.withColumn("p", F.col("v"))
    found = written(pairs(numbered, ("mol_id", "level"), coords=("x",)))
    cuts = cascade_thresholds(found, "level", "dist", bins)
    table = F.create_map(*[x for lev, ts in cuts.items() for x in (F.lit(lev), F.array(*[F.lit(float(t)) for t in ts]) if ts else F.array().cast("array<double>"))]) if cuts else F.create_map().cast("map<int,array<double>>")
    coded = found.withColumn("bin", bin_of(F.col("dist"), table[F.col("level")]))
    code = mixed_radix([(F.col("level"), 1), (F.least("type1", "type2"), types), (F.greatest("type1", "type2"), types), (F.col("bin"), bins + 1)])
    return coded.groupBy("mol_id", code.alias("type")).agg(F.count("*").alias("cnt"))


def run(vertices: DataFrame, edges: DataFrame, near: DataFrame, sigmas: list[float], options: Options | None = None) -> DataFrame:
    """The matrix in long form from vertices(mol_id, v, x, value), edges both ways and near(mol_id, v, u, d)."""
    options = options or Options()
    points, types = classify(written(singular_points(vertices, edges, near, sigmas, options)), options.charge_thresholds)
    return descriptor_matrix(points, types, options.distance_bins)

"""Neighbourhoods: radius joins by grid cells, rings, local extrema in space and scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetspark.functions.expressions import distance
from facetspark.operators import tiles


def within_radius(points: DataFrame, radius: float, coords: Sequence[str] = ("x", "y", "z"), itself: bool = False, sides: int | None = None) -> DataFrame:
    """mol_id, v, u, d for points of an object at distance radius or less, both ways.

    Points are dealt to cells of side radius along the first `sides` coordinates (all, if None); one side looks into the
    3^sides cells around its own, so that the join has an equi-key and compares neighbours only. Objects of a few points
    want few sides, as every one triples the rows of one side of the join; large ones want all.
    """
    cells = [F.floor(F.col(c) / radius).cast("bigint") for c in coords[:sides]]
    a = points.select("mol_id", F.col("v"), *[F.col(c).alias(f"a_{c}") for c in coords], *[k.alias(f"k{i}") for i, k in enumerate(cells)])
    b = points.select("mol_id", F.col("v").alias("u"), *[F.col(c).alias(f"b_{c}") for c in coords], *[k.alias(f"k{i}") for i, k in enumerate(cells)])
    for i in range(len(cells)):
        b = b.withColumn("_step", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn(f"k{i}", F.col(f"k{i}") + F.col("_step")).drop("_step")
    found = a.join(b, ["mol_id", *[f"k{i}" for i in range(len(cells))]])
    found = found.select("mol_id", "v", "u", distance([F.col(f"a_{c}") for c in coords], [F.col(f"b_{c}") for c in coords]).alias("d"))
    return found.where((F.col("d") <= radius) & (F.lit(itself) | (F.col("v") != F.col("u"))))


def vectors_within(vectors: DataFrame, radius: float) -> DataFrame:
    """key, v, u, d for pairs v < u of vectors(key, v, vec) with equal keys at distance radius or less.

    For arrays of many dimensions, where cells don't help: all pairs of a key, by tiles.
    """
    return tiles.within(vectors, radius)


def plus_adjacent(near: DataFrame, edges: DataFrame) -> DataFrame:
    """near(mol_id, v, u) with every vertex's ring, edges(mol_id, src, dst) being given both ways."""
    ring = edges.select("mol_id", F.col("src").alias("v"), F.col("dst").alias("u"))
    return near.select("mol_id", "v", "u").union(ring).distinct()


def ring_extremes(values: DataFrame, edges: DataFrame, keys: Sequence[str] = ("mol_id",)) -> DataFrame:
    """values(keys, v, value) with the greatest and least value of each vertex's neighbours."""
    other = values.select(*keys, F.col("v").alias("dst"), F.col("value").alias("near"))
    ring = edges.join(other, [*[k for k in keys if k in edges.columns], "dst"]).groupBy(*keys, F.col("src").alias("v")).agg(F.max("near").alias("most"), F.min("near").alias("least"))
    return values.join(ring, [*keys, "v"], "left")


def local_extrema(values: DataFrame, edges: DataFrame, keys: Sequence[str] = ("mol_id",)) -> DataFrame:
    """Vertices strictly above (kind 1) or below (kind -1) all neighbours; a vertex without neighbours is neither."""
    out = ring_extremes(values, edges, keys)
    kind = F.when(F.col("value") > F.col("most"), 1).when(F.col("value") < F.col("least"), -1)
    return out.withColumn("kind", kind).where("kind is not null").select(*keys, "v", "value", "kind")


def scale_extrema(values: DataFrame, edges: DataFrame) -> DataFrame:
    """Extrema of values(mol_id, v, level, value) over the ring at their own level and the same vertex one level up and
    down; the first and the last level have none."""
    w = Window.partitionBy("mol_id", "v").orderBy("level")
    scaled = values.withColumn("finer", F.lag("value").over(w)).withColumn("coarser", F.lead("value").over(w))
    out = ring_extremes(scaled, edges, ("mol_id", "level"))
    above = (F.col("value") > F.col("most")) & (F.col("value") > F.greatest("finer", "coarser"))
    below = (F.col("value") < F.col("least")) & (F.col("value") < F.least("finer", "coarser"))
    inner = F.col("finer").isNotNull() & F.col("coarser").isNotNull()
    return out.where(inner).withColumn("kind", F.when(above, 1).when(below, -1)).where("kind is not null").select("mol_id", "level", "v", "value", "kind")


def scale_sign(values: DataFrame) -> DataFrame:
    """1 if (v - previous)(v - next) over levels is 0 or more, else -1; end levels have none."""
    w = Window.partitionBy("mol_id", "v").orderBy("level")
    product_ = (F.col("value") - F.lag("value").over(w)) * (F.col("value") - F.lead("value").over(w))
    return values.withColumn("sign", F.when(product_ >= 0, 1).when(product_ < 0, -1)).where("sign is not null").select("mol_id", "v", "level", "sign")


def surface_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """mol_id, v and the sign of the difference of two surfaces' values."""
    return a.join(b.withColumnRenamed("value", "other"), ["mol_id", "v"]).select("mol_id", "v", F.signum(F.col("value") - F.col("other")).cast("int").alias("sign"))


def grid_window_extrema(grid: DataFrame, radius: int) -> DataFrame:
    """Cells of grid(y, x, value) that are not below (1) or not above (-1) any present cell of their (2r+1)^2 window; a
    cell that is both counts as 1."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    near = grid.select(F.explode(steps).alias("dy"), "y", "x", "value").select("y", "x", "value", "dy", F.explode(steps).alias("dx"))
    spread = near.select((F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), F.col("value").alias("near"))
    around = spread.groupBy("y", "x").agg(F.max("near").alias("most"), F.min("near").alias("least"))
    out = grid.join(around, ["y", "x"]).withColumn("kind", F.when(F.col("value") >= F.col("most"), 1).when(F.col("value") <= F.col("least"), -1))
    return out.where("kind is not null").select("y", "x", "value", "kind")


def grid_hessian(grid: DataFrame) -> DataFrame:
    """Second differences, their determinant, the Gaussian curvature and the Sobel norm at inner cells of grid(y, x, value)."""
    steps = F.sequence(F.lit(-1), F.lit(1))
    around = grid.select("y", "x", "value", F.explode(steps).alias("dy")).select("*", F.explode(steps).alias("dx"))
    moved = around.select((F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), (-F.col("dy")).alias("dy"), (-F.col("dx")).alias("dx"), "value")
    at = {(i, j): F.max(F.when((F.col("dy") == i) & (F.col("dx") == j), F.col("value"))).alias(f"n{i + 1}{j + 1}") for i in (-1, 0, 1) for j in (-1, 0, 1)}
    n = {k: F.col(f"n{k[0] + 1}{k[1] + 1}") for k in at}
    cells = moved.groupBy("y", "x").agg(*at.values()).join(grid.select("y", "x"), ["y", "x"], "left_semi").na.drop()
    gx, gy = (n[0, 1] - n[0, -1]) / 2, (n[1, 0] - n[-1, 0]) / 2
    xx, yy = n[0, 1] - 2 * n[0, 0] + n[0, -1], n[1, 0] - 2 * n[0, 0] + n[-1, 0]
    xy = (n[1, 1] - n[1, -1] - n[-1, 1] + n[-1, -1]) / 4
    sx = n[-1, 1] + 2 * n[0, 1] + n[1, 1] - n[-1, -1] - 2 * n[0, -1] - n[1, -1]
    sy = n[1, -1] + 2 * n[1, 0] + n[1, 1] - n[-1, -1] - 2 * n[-1, 0] - n[-1, 1]
    det = xx * yy - xy * xy
    unit = 1 + gx * gx + gy * gy
    return cells.select("y", "x", det.alias("det"), (det / (unit * unit)).alias("gauss"), F.sqrt(sx * sx + sy * sy).alias("sobel"))


def vector_extrema(vectors: DataFrame, projectors: DataFrame, edges: DataFrame) -> DataFrame:
    """Extrema of vectors(mol_id, v, level, vec) on each vertex's own direction, projectors(mol_id, v, level, mean,
    direction): at least (1) or at most (-1) all of the ring and the vertex itself, at the level and those beside it."""
    onto = lambda x: F.aggregate(F.zip_with(F.zip_with(x, F.col("mean"), lambda a, m: a - m), F.col("direction"), lambda a, d: a * d), F.lit(0.0), lambda s, y: s + y)
    own = vectors.join(projectors, ["mol_id", "v", "level"]).withColumn("value", onto(F.col("vec")))
    ring = edges.select("mol_id", F.col("src").alias("v"), F.col("dst").alias("u")).union(vectors.select("mol_id", "v", F.col("v").alias("u")).distinct())
    steps = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    around = projectors.join(ring, ["mol_id", "v"]).withColumn("step", steps).where("u <> v or step <> 0").withColumn("at", F.col("level") + F.col("step"))
    other = vectors.select("mol_id", F.col("v").alias("u"), F.col("level").alias("at"), F.col("vec").alias("near"))
    seen = around.join(other, ["mol_id", "u", "at"]).groupBy("mol_id", "v", "level").agg(F.max(onto(F.col("near"))).alias("most"), F.min(onto(F.col("near"))).alias("least"), F.count_distinct("step").alias("n"))
    out = own.join(seen, ["mol_id", "v", "level"]).where("n = 3")
    return out.withColumn("kind", F.when(F.col("value") >= F.col("most"), 1).when(F.col("value") <= F.col("least"), -1)).where("kind is not null").select("mol_id", "level", "v", "value", "kind")

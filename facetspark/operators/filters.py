"""Kernel filters over neighbourhoods and scale spaces: one join of neighbour pairs, all kernels and levels in one aggregate.

near(keys..., v, u, d, w) lists each vertex's neighbours u (itself included where the kernel wants it) with distance d
and weight w; values(keys..., v, value) holds the field. A kernel is a function of columns d, w, value to one aggregate,
so that new ones need no new operator.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Kernel = Callable[[Column, Column, Column], Column]


def gaussian(sigma: float) -> Kernel:
    """Weighted Gaussian mean over the ball of 3 sigma."""

    def kernel(d: Column, w: Column, value: Column) -> Column:
        g = F.when(d <= 3 * sigma, w * F.exp(-d * d / (2 * sigma * sigma)))
        return F.try_divide(F.sum(g * value), F.sum(g))

    return kernel


def average(radius: float) -> Kernel:
    return lambda d, w, value: F.avg(F.when(d <= radius, value))


def laplacian_of_gaussian(sigma: float) -> Kernel:
    """Sum of value times the Laplacian's coefficient, over the sum of the coefficients' sizes."""

    def kernel(d: Column, w: Column, value: Column) -> Column:
        q = d * d / (2 * sigma * sigma)
        c = F.when(d <= 3 * sigma, w * (q - 1) * F.exp(-q))
        return F.try_divide(F.sum(c * value), F.sum(F.abs(c)))

    return kernel


def laplace_beltrami(t: float, centre: str = "own") -> Kernel:
    """Heat-kernel weighted mean difference to the vertex's own value, a column of near."""

    def kernel(d: Column, w: Column, value: Column) -> Column:
        g = w * F.exp(-d * d / (4 * t))
        return F.try_divide(F.sum(g * (value - F.col(centre))), F.sum(g)) / t

    return kernel


def apply_kernels(near: DataFrame, values: DataFrame, kernels: dict[str, Kernel], keys: Sequence[str] = ("mol_id",)) -> DataFrame:
    """keys, v and a column for each kernel."""
    field = values.select(*keys, F.col("v").alias("u"), "value")
    joined = near.join(field, [*keys, "u"])
    w = F.col("w") if "w" in near.columns else F.lit(1.0)
    return joined.groupBy(*keys, "v").agg(*[k(F.col("d"), w, F.col("value")).alias(name) for name, k in kernels.items()])


def sigmas(sigma0: float, step: float, n: int, additive: bool = False, offset: float = 0.0) -> list[float]:
    """sigma0 * step^k (or sigma0 + step * k) + offset."""
    return [(sigma0 + step * k if additive else sigma0 * step**k) + offset for k in range(n)]


def sigma_multiplier(low: float, high: float, n: int) -> float:
    return (high / low) ** (1 / (n - 1)) if n > 1 else 1.0


def scale_space(near: DataFrame, values: DataFrame, levels: Sequence[float], keys: Sequence[str] = ("mol_id",)) -> DataFrame:
    """keys, v, level, value: the Gaussian blur at every sigma, in one pass over the pairs."""
    wide = apply_kernels(near, values, {f"s{i}": gaussian(s) for i, s in enumerate(levels)}, keys)
    stacked = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"s{i}").alias("value")) for i in range(len(levels))]))
    return wide.select(*keys, "v", stacked.alias("x")).select(*keys, "v", "x.level", "x.value")


def recursive_scale_space(near: DataFrame, values: DataFrame, small: float, steps: int, keys: Sequence[str] = ("mol_id",)) -> DataFrame:
    """The small blur applied over and over: level k has had k + 1 of them."""
    out, now = None, values
    for k in range(steps):
        now = apply_kernels(near, now, {"value": gaussian(small)}, keys)
        level = now.withColumn("level", F.lit(k))
        out = level if out is None else out.unionByName(level)
    return out


def difference_of_gaussians(near: DataFrame, values: DataFrame, sigma: float, delta: float = 0.1, coefficient: float = 1.0, keys: Sequence[str] = ("mol_id",)) -> DataFrame:
    """coefficient * (blur at sigma + delta less blur at sigma)."""
    wide = apply_kernels(near, values, {"g1": gaussian(sigma + delta), "g0": gaussian(sigma)}, keys)
    return wide.select(*keys, "v", (coefficient * (F.col("g1") - F.col("g0"))).alias("response"))


def weighted_median(near: DataFrame, values: DataFrame, radius: float, keys: Sequence[str] = ("mol_id",), upper: bool = False) -> DataFrame:
    """keys, v, median: the least value at which the running weight reaches half; upper takes position n div 2, unweighted."""
    field = values.select(*keys, F.col("v").alias("u"), "value")
    joined = near.where(F.col("d") <= radius).join(field, [*keys, "u"]).withColumn("_w", F.col("w") if "w" in near.columns else F.lit(1.0))
    own = Window.partitionBy(*keys, "v")
    if upper:
        ranked = joined.withColumn("_i", F.row_number().over(own.orderBy("value", "u"))).withColumn("_n", F.count("*").over(own))
        return ranked.where(F.col("_i") == F.floor(F.col("_n") / 2) + 1).select(*keys, "v", F.col("value").alias("median"))
    running = F.sum("_w").over(own.orderBy("value", "u"))
    ranked = joined.withColumn("_run", running).withColumn("_all", F.sum("_w").over(own))
    return ranked.where(2 * F.col("_run") >= F.col("_all")).groupBy(*keys, "v").agg(F.min("value").alias("median"))


def simple_laplacian(values: DataFrame, edges: DataFrame, keys: Sequence[str] = ("mol_id",)) -> DataFrame:
    """Mean difference of a vertex to its neighbours."""
    a = values.withColumnRenamed("v", "src").withColumnRenamed("value", "own")
    b = values.withColumnRenamed("v", "dst").withColumnRenamed("value", "other")
    return edges.join(a, [*keys, "src"]).join(b, [*keys, "dst"]).groupBy(*keys, F.col("src").alias("v")).agg(F.avg(F.col("own") - F.col("other")).alias("laplacian"))


def mesh_weights(triangle_distance: DataFrame, triangles: DataFrame, radius: float) -> DataFrame:
    """near for mesh filters: each triangle within radius of a vertex gives each corner its area as weight.

    triangle_distance(mol_id, v, t, d) and triangles(mol_id, t, a, b, c, area).
    """
    hit = triangle_distance.where(F.col("d") <= radius).select("mol_id", "v", "t").join(triangles.select("mol_id", "t", "area", F.explode(F.array("a", "b", "c")).alias("u")), ["mol_id", "t"])
    return hit.groupBy("mol_id", "v", "u").agg(F.sum("area").alias("w"))


def connected_mesh_weights(triangle_distance: DataFrame, triangles: DataFrame, radius: float) -> DataFrame:
    """mesh_weights() of those triangles within radius that are connected, by shared edges of triangles within it, to one
    that the vertex is a corner of: the far side of a thin fold plays no part."""
    from facetspark.operators.graph import reachable

    hit = triangle_distance.where(F.col("d") <= radius).select("mol_id", "v", "t")
    corners = triangles.select("mol_id", "t", F.explode(F.array("a", "b", "c")).alias("u"))
    sides = triangles.select("mol_id", "t", F.explode(F.array(*[F.struct(F.least(x, y).alias("i"), F.greatest(x, y).alias("j")) for x, y in ("ab", "bc", "ac")])).alias("side"))
    beside = sides.join(sides.withColumnRenamed("t", "t2"), ["mol_id", "side"]).where("t <> t2").select("mol_id", "t", "t2").distinct()
    edges = hit.join(beside, ["mol_id", "t"]).join(hit.withColumnRenamed("t", "t2"), ["mol_id", "v", "t2"]).select("mol_id", F.col("v").alias("of"), F.col("t").alias("src"), F.col("t2").alias("dst"))
    seeds = hit.join(corners, ["mol_id", "t"]).where("u = v").select("mol_id", F.col("v").alias("of"), F.col("t").alias("v"))
    kept = reachable(seeds, edges, ["mol_id", "of"]).select("mol_id", F.col("of").alias("v"), F.col("v").alias("t"), F.lit(0.0).alias("d"))
    return mesh_weights(kept, triangles, radius)


def smooth_coordinates(near: DataFrame, vertices: DataFrame, sigma: float, columns: Sequence[str] = ("x", "y", "z"), unit: bool = False, keys: Sequence[str] = ("mol_id",)) -> DataFrame:
    """keys, v and the columns, each blurred at sigma, all in one aggregate; unit puts the result back on the unit sphere."""
    field = vertices.select(*keys, F.col("v").alias("u"), *columns)
    joined = near.join(field, [*keys, "u"])
    w = F.col("w") if "w" in near.columns else F.lit(1.0)
    out = joined.groupBy(*keys, "v").agg(*[gaussian(sigma)(F.col("d"), w, F.col(c)).alias(c) for c in columns])
    if unit:
        norm = F.sqrt(sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0)))
        out = out.withColumn("_norm", norm).withColumns({c: F.try_divide(F.col(c), F.col("_norm")) for c in columns}).drop("_norm")
    return out


def spherical_scale_space(near: DataFrame, vertices: DataFrame, small: float, steps: int, columns: Sequence[str] = ("x", "y", "z"), keys: Sequence[str] = ("mol_id",)) -> DataFrame:
    """Unit vectors blurred over and over: level k has had k + 1 small blurs, each put back on the sphere."""
    out, now = None, vertices
    for k in range(steps):
        now = smooth_coordinates(near, now, small, columns, True, keys)
        level = now.withColumn("level", F.lit(k))
        out = level if out is None else out.unionByName(level)
    return out

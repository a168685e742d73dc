"""Tangent frames of surfaces, carried from seeds over edge tables (mol_id, src, dst), both directions present.

A frame is its first axis u, a unit vector across the vertex's normal n; the second is n x u and follows it, as rotations
keep cross products. Both loops go layer by layer (a vertex's layer is its number of edges from the nearest seed): each
takes only what the layer before gives, so that results don't depend on an order of visits. A layer is a job over the
last layer's rows, written to the shared checkpoint folder.

Defined results: vertices that no edges lead to from a seed are absent; rows with a null in an identifier are, too; a
null position or normal gives a null axis, which passes nothing on, as does a sum of no length. Seeds are unique by
(mol_id, v).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetspark.operators.graph import written

#: Exponent of a link's weight.
SHARPNESS = 10.0
AXIS = ("ux", "uy", "uz")
#: Normals of a link's source and target.
NORMAL, OTHER = ("nx", "ny", "nz"), ("mx", "my", "mz")


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)]


def unit(a: Sequence[Column]) -> list[Column]:
    """a by its length; nulls if it has none."""
    length = F.sqrt(dot(a, a))
    return [F.when(length > 0, c / length) for c in a]


def _columns(names: Sequence[str], prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in names]


def _named(values: Sequence[Column], names: Sequence[str]) -> list[Column]:
    return [c.alias(name) for c, name in zip(values, names)]


def transported(u: Sequence[Column], n: Sequence[Column], m: Sequence[Column]) -> list[Column]:
    """u, across the unit normal n, turned as the shortest rotation turns n into m; normals that are opposite leave it."""
    k, c = cross(n, m), dot(n, m)
    once = cross(k, u)
    twice = cross(k, once)
    return [F.when(1 + c > 1e-12, u[i] + once[i] + twice[i] / (1 + c)).when(c.isNotNull(), u[i]) for i in range(3)]


def links(surface: DataFrame, edges: DataFrame, sharpness: float = SHARPNESS) -> DataFrame:
    """mol_id, src, dst, the unit normals of both ends (nx.., mx..) and weight, over surface(mol_id, v, x, y, z, nx, ny, nz).

    The weight is (1 - t) ** sharpness, t the share of the edge's direction that lies along the axis about which the
    normals turn, held between 0 and 1; normals that are parallel or opposite have no such axis, and weight 1.
    """
    a, b = _ends(surface)
    both = edges.select("mol_id", "src", "dst").join(a, ["mol_id", "src"]).join(b, ["mol_id", "dst"])
    return both.select("mol_id", "src", "dst", *NORMAL, *OTHER, _weight(sharpness).alias("weight"))


def _ends(surface: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positions and unit normals of links' sources (x.., nx..) and targets (to_x.., mx..)."""
    own = surface.select("mol_id", "v", "x", "y", "z", *_named(unit(_columns(NORMAL)), NORMAL))
    to = own.select("mol_id", F.col("v").alias("dst"), *[F.col(c).alias(f"to_{c}") for c in "xyz"], *[F.col(c).alias(d) for c, d in zip(NORMAL, OTHER)])
    return own.withColumnRenamed("v", "src"), to


def _weight(sharpness: float) -> Column:
    along = unit([F.col(f"to_{c}") - F.col(c) for c in "xyz"])
    turn = F.coalesce(dot(unit(cross(_columns(NORMAL), _columns(OTHER))), along), F.lit(0.0))
    return F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - turn)), F.lit(sharpness))


def propagate(surface: DataFrame, edges: DataFrame, seeds: DataFrame, sharpness: float = SHARPNESS, max_rounds: int = 1000) -> DataFrame:
    """mol_id, v, layer, ux, uy, uz: the axis of each seed(mol_id, v, ux, uy, uz), brought across its normal, carried over the surface.

    A vertex gets the sum, brought to unit length, of the axes of all neighbours of the layer before, each transported to
    its normal and weighted by links(). Raises RuntimeError if max_rounds layers aren't enough.
    """
    n, m = _columns(NORMAL), _columns(OTHER)
    # A link is made when its source is in the last layer, once in all, and never written.
    ways, (source, target) = edges.select("mol_id", "src", "dst"), _ends(surface)
    start = seeds.select("mol_id", "v", *AXIS).join(surface.select("mol_id", "v", "nx", "ny", "nz"), ["mol_id", "v"])
    normal = unit(n)
    share = dot(_columns(AXIS), normal)
    across = unit([F.col(c) - share * k for c, k in zip(AXIS, normal)])
    reached = front = written(start.select("mol_id", "v", F.lit(0).alias("layer"), *_named(across, AXIS)))
    for layer in range(1, max_rounds + 1):
        near = front.drop("layer").withColumnRenamed("v", "src").join(ways, ["mol_id", "src"])
        near = near.join(reached.select("mol_id", F.col("v").alias("dst")), ["mol_id", "dst"], "left_anti")
        near = near.join(source, ["mol_id", "src"]).join(target, ["mol_id", "dst"]).withColumn("weight", _weight(sharpness))
        brought = [F.sum(F.col("weight") * c) for c in transported(_columns(AXIS), n, m)]
        sums = near.groupBy("mol_id", F.col("dst").alias("v")).agg(*_named(brought, AXIS))
        front = written(sums.select("mol_id", "v", F.lit(layer).alias("layer"), *_named(unit(_columns(AXIS)), AXIS)))
        if front.isEmpty():
            return reached
        reached = reached.union(front)
    raise RuntimeError(f"not all reached after {max_rounds} layers")


def aligned(frames: DataFrame, edges: DataFrame, seeds: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """mol_id, v, layer, ux, uy, uz over frames(mol_id, v, ux, uy, uz): axes known but for their sign, reversed where they
    point against the sum of the aligned axes of the layer before; seeds(mol_id, v) keep theirs."""
    reached = front = written(frames.join(seeds.select("mol_id", "v"), ["mol_id", "v"], "left_semi").select("mol_id", "v", F.lit(0).alias("layer"), *AXIS))
    own = frames.select("mol_id", "v", *AXIS)
    for layer in range(1, max_rounds + 1):
        near = front.drop("layer").withColumnRenamed("v", "src").join(edges.select("mol_id", "src", "dst"), ["mol_id", "src"])
        near = near.join(reached.select("mol_id", F.col("v").alias("dst")), ["mol_id", "dst"], "left_anti")
        sums = near.groupBy("mol_id", F.col("dst").alias("v")).agg(*[F.sum(c).alias(f"near_{c}") for c in AXIS])
        sign = F.when(dot(_columns(AXIS), _columns(AXIS, "near_")) < 0, -1.0).otherwise(1.0)
        front = written(own.join(sums, ["mol_id", "v"]).select("mol_id", "v", F.lit(layer).alias("layer"), *_named([sign * F.col(c) for c in AXIS], AXIS)))
        if front.isEmpty():
            return reached
        reached = reached.union(front)
    raise RuntimeError(f"not all reached after {max_rounds} layers")

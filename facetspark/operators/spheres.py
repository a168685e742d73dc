"""Fields of unit vectors over a surface: normal coordinates, Hessians, heat flow; covariant differentials of vector fields.

A neighbour's place in the tangent plane of a vertex comes from geometry.local_coordinates (p, q); its value's place on
the sphere around the vertex's own value comes from here (a, b): the angle between the two values, along the direction
in which the neighbour's lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetspark.functions.expressions import bounded, dot
from facetspark.operators.geometry import gradient, hessian

AXES = "xyz"


def sphere_frame(f: list[Column]) -> tuple[list[Column], list[Column]]:
    """Two unit vectors across a unit vector: along its meridian, away from the pole, and along its parallel."""
    theta, phi = F.atan2(f[1], f[0]), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), f[2])))
    return [F.cos(theta) * F.cos(phi), F.sin(theta) * F.cos(phi), -F.sin(phi)], [-F.sin(theta), F.cos(theta), F.lit(0.0)]


def normal_coordinates(near: DataFrame, field: DataFrame) -> DataFrame:
    """mol_id, v, u, a, b: where the value of u lies around that of v, over near(mol_id, v, u) and field(mol_id, v, x, y, z)."""
    own = field.select("mol_id", "v", *[F.col(c).alias(f"own_{c}") for c in AXES])
    other = field.select("mol_id", F.col("v").alias("u"), *[F.col(c).alias(f"near_{c}") for c in AXES])
    joined = near.select("mol_id", "v", "u").join(own, ["mol_id", "v"]).join(other, ["mol_id", "u"])
    f, g = ([F.col(f"{name}_{c}") for c in AXES] for name in ("own", "near"))
    along, across = sphere_frame(f)
    p, q = dot(along, g), dot(across, g)
    angle, size = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(f, g)))), F.sqrt(p * p + q * q)
    share = lambda x, opposite: F.when(size > 0, angle * x / size).when(angle > 1, angle * opposite).otherwise(0.0)
    return joined.select("mol_id", "v", "u", share(p, 1.0).alias("a"), share(q, 0.0).alias("b"))


def spherical_hessians(local: DataFrame, field: DataFrame) -> DataFrame:
    """mol_id, v, axis ("a" or "b"), hpp, hpq, hqq: Hessians of the normal coordinates over local(mol_id, v, u, p, q)."""
    steps = local.select("mol_id", "v", "u", "p", "q").join(normal_coordinates(local, field), ["mol_id", "v", "u"])
    axes = F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("df")) for c in "ab"]))
    keyed = steps.select("mol_id", "v", "p", "q", axes.alias("at")).select(F.struct("mol_id", "at.axis").alias("mol_id"), "v", "p", "q", "at.df")
    return hessian(keyed, gradient(keyed)).select("mol_id.mol_id", "v", "mol_id.axis", "hpp", "hpq", "hqq")


def heat_step(local: DataFrame, field: DataFrame, dt: float) -> DataFrame:
    """field(mol_id, v, x, y, z) after a step dt of the heat equation on the sphere: every value moves by dt times the
    Laplacians of its normal coordinates, along the great circle in that direction; where these can't be fitted, it stays."""
    trace = spherical_hessians(local, field).withColumn("t", F.lit(dt) * (F.col("hpp") + F.col("hqq")))
    move = trace.groupBy("mol_id", "v").agg(*[F.max(F.when(F.col("axis") == c, F.col("t"))).alias(f"move_{c}") for c in "ab"])
    f = [F.col(c) for c in AXES]
    along, across = sphere_frame(f)
    a, b = F.coalesce("move_a", F.lit(0.0)), F.coalesce("move_b", F.lit(0.0))
    size = F.sqrt(a * a + b * b)
    unit = lambda x: F.when(size > 0, x / size).otherwise(0.0)
    moved = [F.sin(size) * (unit(a) * p + unit(b) * q) + F.cos(size) * c for p, q, c in zip(along, across, f)]
    return field.select("mol_id", "v", *AXES).join(move, ["mol_id", "v"], "left").select("mol_id", "v", *[x.alias(c) for x, c in zip(moved, AXES)])


def heat_flow(local: DataFrame, field: DataFrame, dt: float, steps: int) -> DataFrame:
    """mol_id, v, level, x, y, z: the field after each of the steps."""
    out, now = None, field
    for level in range(steps):
        now = heat_step(local, now, dt)
        part = now.withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
    return out


def covariant_differential(local: DataFrame, projected: DataFrame) -> DataFrame:
    """mol_id, v, gpp, gpq, gqq: the symmetric part of a vector field's differential, each entry bounded to +-1000.

    local(mol_id, v, u, p, q, h) are places in v's frame, projected(mol_id, v, u, dp, dq) the differences of the vectors
    at u and v in the same frame. Places in the tangent plane are drawn out to the length of the step, and differences
    count by length.
    """
    length = F.sqrt(F.col("p") * F.col("p") + F.col("q") * F.col("q") + F.col("h") * F.col("h"))
    flat = F.sqrt(F.col("p") * F.col("p") + F.col("q") * F.col("q"))
    steps = local.join(projected, ["mol_id", "v", "u"]).withColumn("length", length).withColumn("flat", flat).where("flat > 0")
    drawn = steps.select("mol_id", "v", *[(F.col(c) * F.col("length") / F.col("flat")).alias(c) for c in "pq"], *[(F.col(c) / F.col("length")).alias(c) for c in ("dp", "dq")])
    one = lambda c: gradient(drawn.select("mol_id", "v", "p", "q", F.col(c).alias("df")))
    both = one("dp").select("mol_id", "v", F.col("gp").alias("pp"), F.col("gq").alias("pq")).join(one("dq").select("mol_id", "v", F.col("gp").alias("qp"), F.col("gq").alias("qq")), ["mol_id", "v"])
    return both.select("mol_id", "v", bounded(F.col("pp")).alias("gpp"), ((bounded(F.col("pq")) + bounded(F.col("qp"))) / 2).alias("gpq"), bounded(F.col("qq")).alias("gqq"))


def vector_steps(frames: DataFrame, near: DataFrame, field: DataFrame) -> DataFrame:
    """mol_id, v, u, dp, dq: differences of the vectors of field(mol_id, v, x, y, z) in v's frame, from
    geometry.tangent_frames."""
    own = frames.select("mol_id", "v", *[f"{k}{c}" for k in "uw" for c in AXES])
    a = field.select("mol_id", "v", *[F.col(c).alias(f"own_{c}") for c in AXES])
    b = field.select("mol_id", F.col("v").alias("u"), *[F.col(c).alias(f"near_{c}") for c in AXES])
    joined = near.select("mol_id", "v", "u").join(own, ["mol_id", "v"]).join(a, ["mol_id", "v"]).join(b, ["mol_id", "u"])
    step = [F.col(f"near_{c}") - F.col(f"own_{c}") for c in AXES]
    return joined.select("mol_id", "v", "u", *[dot(step, [F.col(f"{k}{c}") for c in AXES]).alias(name) for k, name in (("u", "dp"), ("w", "dq"))])

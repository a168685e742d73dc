"""Potentials and forces of atoms at points: sums over an object's atoms, aggregated by point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetspark.functions.expressions import distance

#: The probe radius, and what keeps distances from 0 in potentials and in forces.
PROBE = 1.53
NEAR_POTENTIAL = 1e-13
NEAR_FORCE = 1e-8


def _reach(points: DataFrame, atoms: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    a = atoms.select("mol_id", *[F.col(c).alias(f"q{c}") for c in "xyz"], *carry)
    out = points.join(a, "mol_id")
    return out.withColumn("d", distance([F.col(c) for c in "xyz"], [F.col(f"q{c}") for c in "xyz"]))


def potential(points: DataFrame, atoms: DataFrame) -> DataFrame:
    """mol_id, v, potential: sum of charge / d."""
    return _reach(points.select("mol_id", "v", "x", "y", "z"), atoms, ("charge",)).groupBy("mol_id", "v").agg(F.sum(F.col("charge") / (F.col("d") + NEAR_POTENTIAL)).alias("potential"))


def force(points: DataFrame, atoms: DataFrame) -> DataFrame:
    """mol_id, v, fx, fy, fz: sum of charge times unit direction over d squared."""
    r = _reach(points.select("mol_id", "v", "x", "y", "z"), atoms, ("charge",))
    d = F.col("d") + NEAR_FORCE
    return r.groupBy("mol_id", "v").agg(*[F.sum(F.col("charge") * ((F.col(c) - F.col(f"q{c}")) / d) / (d * d)).alias(f"f{c}") for c in "xyz"])


def _lj(d: Column, probe: float) -> tuple[Column, Column]:
    s6 = F.pow((F.col("radius") + probe) / 2 / d, 6)
    return s6 * s6, s6


def lennard_jones(points: DataFrame, atoms: DataFrame, probe: float = PROBE) -> DataFrame:
    """mol_id, v, lj: sum of (s / d)^12 - (s / d)^6 with s the mean of the atom's radius and the probe's."""
    s12, s6 = _lj(F.col("d") + NEAR_POTENTIAL, probe)
    return _reach(points.select("mol_id", "v", "x", "y", "z"), atoms, ("radius",)).groupBy("mol_id", "v").agg(F.sum(s12 - s6).alias("lj"))


def lennard_jones_force(points: DataFrame, atoms: DataFrame, probe: float = PROBE) -> DataFrame:
    """mol_id, v, gx, gy, gz: minus the potential's derivative along each axis."""
    r, d = _reach(points.select("mol_id", "v", "x", "y", "z"), atoms, ("radius",)), F.col("d") + NEAR_FORCE
    s12, s6 = _lj(d, probe)
    return r.groupBy("mol_id", "v").agg(*[F.sum((12 * s12 - 6 * s6) / d * ((F.col(c) - F.col(f"q{c}")) / d)).alias(f"g{c}") for c in "xyz"])


def surface_potentials(vertices: DataFrame, atoms: DataFrame, probe: float = PROBE) -> DataFrame:
    """mol_id, v, elec (electric force along the normal) and lj, at the points a probe's radius above the surface."""
    above = vertices.select("mol_id", "v", *[(F.col(c) + probe * F.col(f"n{c}")).alias(c) for c in "xyz"], "nx", "ny", "nz")
    f = force(above, atoms).join(above.select("mol_id", "v", "nx", "ny", "nz"), ["mol_id", "v"])
    elec = f.select("mol_id", "v", sum((F.col(f"f{c}") * F.col(f"n{c}") for c in "xyz"), F.lit(0.0)).alias("elec"))
    return elec.join(lennard_jones(above, atoms, probe), ["mol_id", "v"])

"""Differential geometry of vertex neighbourhoods: curvature, gradients, Hessians, local principal components.

Closed forms are sums of products by vertex; fits with more unknowns are one numpy task for each object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetspark.functions.expressions import bounded, dot, tangent_basis


def tangent_frames(vertices: DataFrame) -> DataFrame:
    """vertices with ux, uy, uz and wx, wy, wz, two unit tangents."""
    u, w = tangent_basis([F.col("nx"), F.col("ny"), F.col("nz")])
    return vertices.withColumns({f"u{c}": x for c, x in zip("xyz", u)}).withColumns({f"w{c}": x for c, x in zip("xyz", w)})


def local_coordinates(vertices: DataFrame, near: DataFrame) -> DataFrame:
    """mol_id, v, u, and the neighbour's coordinates p, q (tangent) and h (along the normal) in v's frame."""
    own = tangent_frames(vertices).withColumnsRenamed({"x": "x0", "y": "y0", "z": "z0"})
    other = vertices.select("mol_id", F.col("v").alias("u"), "x", "y", "z")
    joined = near.select("mol_id", "v", "u").join(own, ["mol_id", "v"]).join(other, ["mol_id", "u"])
    step = [F.col(c) - F.col(f"{c}0") for c in "xyz"]
    axis = lambda k: dot(step, [F.col(f"{k}{c}") for c in "xyz"])
    return joined.select("mol_id", "v", "u", axis("u").alias("p"), axis("w").alias("q"), axis("n").alias("h"))


def _solve3(a: list[list], b: list) -> tuple:
    """Cramer's rule for a 3 x 3 system of columns; NULL where singular."""
    det = lambda m: m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    whole = det(a)
    safe = F.when(F.abs(whole) > 1e-12, whole)
    return tuple(det([[b[i] if j == k else a[i][j] for j in range(3)] for i in range(3)]) / safe for k in range(3))


def paraboloid_curvature(local: DataFrame) -> DataFrame:
    """mol_id, v, gauss, mean from h = (a p^2 + 2 b p q + c q^2) / 2 by normal equations: ac - b^2 and a + c; 0 where the fit is undetermined."""
    terms = [F.col("p") * F.col("p") / 2, F.col("p") * F.col("q"), F.col("q") * F.col("q") / 2]
    sums = {f"m{i}{j}": F.sum(terms[i] * terms[j]) for i in range(3) for j in range(i, 3)} | {f"r{i}": F.sum(terms[i] * F.col("h")) for i in range(3)}
    s = local.groupBy("mol_id", "v").agg(*[e.alias(k) for k, e in sums.items()])
    m = [[F.col(f"m{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    a, b, c = _solve3(m, [F.col(f"r{i}") for i in range(3)])
    return s.select("mol_id", "v", F.coalesce(a * c - b * b, F.lit(0.0)).alias("gauss"), F.coalesce(a + c, F.lit(0.0)).alias("mean"))


def cubic_curvature(local: DataFrame, normals: DataFrame) -> DataFrame:
    """mol_id, v, gauss, mean by a cubic height fit with three equations a neighbour (height and the two slopes of its
    normal), pseudo-inverted. normals(mol_id, v, u, a, b, c): the neighbour's normal in v's frame."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for v, n in g.groupby("v"):
            p, q, h, zero = n["p"].to_numpy(), n["q"].to_numpy(), n["h"].to_numpy(), np.zeros(len(n))
            height = np.stack([p * p / 2, p * q, q * q / 2, p**3, p * p * q, p * q * q, q**3], 1)
            dp = np.stack([p, q, zero, 3 * p * p, 2 * p * q, q * q, zero], 1)
            dq = np.stack([zero, p, q, zero, p * p, 2 * p * q, 3 * q * q], 1)
            c = n["c"].to_numpy()
            c = np.where(np.abs(c) < 1e-9, 1e-9, c)
            x = np.linalg.pinv(np.concatenate([height, dp, dq]), rcond=1e-10) @ np.concatenate([h, -n["a"].to_numpy() / c, -n["b"].to_numpy() / c])
            rows.append((g["mol_id"].iloc[0], v, x[0] * x[2] - x[1] ** 2, x[0] + x[2]))
        return pd.DataFrame(rows, columns=["mol_id", "v", "gauss", "mean"])

    joined = local.join(normals, ["mol_id", "v", "u"]).select(F.col("mol_id").cast("long"), F.col("v").cast("long"), "p", "q", "h", "a", "b", "c")
    return joined.groupBy("mol_id").applyInPandas(one, "mol_id long, v long, gauss double, mean double")


def gradient(local: DataFrame) -> DataFrame:
    """mol_id, v, gp, gq: least squares of df = gp p + gq q over local(mol_id, v, p, q, df); NULL where undetermined."""
    s = local.groupBy("mol_id", "v").agg(F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("p") * F.col("q")).alias("pq"), F.sum(F.col("q") * F.col("q")).alias("qq"), F.sum(F.col("p") * F.col("df")).alias("pf"), F.sum(F.col("q") * F.col("df")).alias("qf"))
    det = F.col("pp") * F.col("qq") - F.col("pq") * F.col("pq")
    safe = F.when(F.abs(det) > 1e-12, det)
    return s.select("mol_id", "v", ((F.col("qq") * F.col("pf") - F.col("pq") * F.col("qf")) / safe).alias("gp"), ((F.col("pp") * F.col("qf") - F.col("pq") * F.col("pf")) / safe).alias("gq"))


def hessian(local: DataFrame, gradients: DataFrame) -> DataFrame:
    """mol_id, v, hpp, hpq, hqq from the Taylor residual df - g.(p, q), each bounded to +-1000; NULL where undetermined."""
    r = local.join(gradients, ["mol_id", "v"]).withColumn("h", F.col("df") - F.col("gp") * F.col("p") - F.col("gq") * F.col("q"))
    terms = [F.col("p") * F.col("p") / 2, F.col("p") * F.col("q"), F.col("q") * F.col("q") / 2]
    s = r.groupBy("mol_id", "v").agg(*[F.sum(terms[i] * terms[j]).alias(f"m{i}{j}") for i in range(3) for j in range(i, 3)], *[F.sum(terms[i] * F.col("h")).alias(f"r{i}") for i in range(3)])
    m = [[F.col(f"m{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    a, b, c = _solve3(m, [F.col(f"r{i}") for i in range(3)])
    return s.select("mol_id", "v", bounded(a).alias("hpp"), bounded(b).alias("hpq"), bounded(c).alias("hqq"))


def combine_channels(hessians: DataFrame) -> DataFrame:
    """hessians(mol_id, v, level, prop, hpp, hpq, hqq) to mol_id, v, level and three responses over the properties: the
    sum of determinants, the root of the determinant of summed squares, the root of summed squared traces."""
    pp, pq, qq = F.col("hpp"), F.col("hpq"), F.col("hqq")
    s = hessians.groupBy("mol_id", "v", "level").agg(F.sum(pp * qq - pq * pq).alias("scalar"), F.sum(pp * pp + pq * pq).alias("a"), F.sum(pq * (pp + qq)).alias("b"), F.sum(qq * qq + pq * pq).alias("c"), F.sum((pp + qq) * (pp + qq)).alias("t"))
    return s.select("mol_id", "v", "level", "scalar", F.sqrt(F.greatest(F.col("a") * F.col("c") - F.col("b") * F.col("b"), F.lit(0.0))).alias("manifold_det"), F.sqrt("t").alias("manifold_trace"))


def local_pca(near: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """mol_id, v, direction, projection: the first principal direction of the neighbours' columns (its largest entry by
    size positive) and the vertex's own projection on it, centred.

    Means and covariances are aggregates; the eigenvectors of a batch of vertices are taken at once.
    """
    k = len(columns)
    other = values.select("mol_id", F.col("v").alias("u"), *columns)
    s = near.select("mol_id", "v", "u").join(other, ["mol_id", "u"]).groupBy("mol_id", "v").agg(
        F.array(*[F.avg(c) for c in columns]).alias("mean"), F.array(*[F.covar_pop(a, b) for a in columns for b in columns]).alias("cov"),
    )
    return _projected(s.join(values.select("mol_id", "v", F.array(*[F.col(c).cast("double") for c in columns]).alias("x")), ["mol_id", "v"]), k)


def object_pca(values: DataFrame, columns: list[str]) -> DataFrame:
    """local_pca() where all of an object's vertices are each one's neighbours: moments of objects, no pair is formed."""
    whole = Window.partitionBy("mol_id")
    mean, cov = F.array(*[F.avg(c).over(whole) for c in columns]), F.array(*[F.covar_pop(a, b).over(whole) for a in columns for b in columns])
    own = values.where("mol_id is not null and v is not null").select("mol_id", "v", mean.alias("mean"), cov.alias("cov"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    return _projected(own, len(columns))


def _projected(own: DataFrame, k: int) -> DataFrame:
    """mol_id, v, direction, projection of own(mol_id, v, mean, cov, x)."""

    def directions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in frames:
            if len(g):
                _, vectors = np.linalg.eigh(np.stack(g["cov"].to_numpy()).reshape(-1, k, k))
                d = vectors[:, :, -1]
                d = d * np.sign(np.take_along_axis(d, np.abs(d).argmax(axis=1)[:, None], 1))
                projection = ((np.stack(g["x"].to_numpy()) - np.stack(g["mean"].to_numpy())) * d).sum(axis=1)
                yield pd.DataFrame({"mol_id": g["mol_id"], "v": g["v"], "direction": list(d), "projection": projection})

    keyed = own.select(F.col("mol_id").cast("long"), F.col("v").cast("long"), "mean", "cov", "x")
    return keyed.mapInPandas(directions, "mol_id long, v long, direction array<double>, projection double")


def hessian_responses(local: DataFrame, scales: DataFrame, sigmas: list[float]) -> DataFrame:
    """mol_id, v, level, and the three combined responses, over local(mol_id, v, u, p, q) and scales(mol_id, v, level,
    prop, value), whose values count times their level's sigma. All levels and properties go through one fit."""
    scaled = scales.withColumn("value", F.col("value") * F.element_at(F.array(*[F.lit(float(s)) for s in sigmas]), F.col("level") + 1))
    a = scaled.select("mol_id", "v", "level", "prop", F.col("value").alias("own"))
    b = scaled.select("mol_id", F.col("v").alias("u"), "level", "prop", F.col("value").alias("near"))
    steps = local.select("mol_id", "v", "u", "p", "q").join(b, ["mol_id", "u"]).join(a, ["mol_id", "v", "level", "prop"])
    keyed = steps.select(F.struct("mol_id", "level", "prop").alias("mol_id"), "v", "p", "q", (F.col("near") - F.col("own")).alias("df"))
    h = hessian(keyed, gradient(keyed)).select("mol_id.mol_id", "v", "mol_id.level", "mol_id.prop", "hpp", "hpq", "hqq")
    return combine_channels(h)

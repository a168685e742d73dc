"""Projections of vertices' columns on directions that their neighbourhoods give.

Moments of a neighbourhood are aggregates; the eigenvectors of a batch of vertices are taken at once, so that a task holds
a batch of small matrices, whatever a neighbourhood's size. Directions are given in the columns' own space, where they
don't depend on the signs of eigenvectors, but for the principal one, whose largest entry by size is positive.

Defined results: near holds the vertex itself if it is to count; a vertex without neighbours is absent; neighbours with a
null column are left out; a direction of no length is null, and so is what is projected on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetspark.functions import expressions as X
from facetspark.operators.geometry import gradient, hessian

_OUT = "mol_id long, v long, mean array<double>, direction array<double>"


def _moments(near: DataFrame, values: DataFrame, columns: list[Column], central: bool) -> DataFrame:
    """mol_id, v, mean, second (moments about the mean, or about zero, row by row) and x, the vertex's own columns."""
    x = [f"x{i}" for i in range(len(columns))]
    other = values.select("mol_id", F.col("v").alias("u"), *[c.cast("double").alias(n) for c, n in zip(columns, x)]).dropna(subset=x)
    second = [F.covar_pop(a, b) if central else F.avg(F.col(a) * F.col(b)) for a in x for b in x]
    s = near.select("mol_id", "v", "u").join(other, ["mol_id", "u"]).groupBy("mol_id", "v").agg(F.array(*[F.avg(c) for c in x]).alias("mean"), F.array(*second).alias("second"))
    own = values.select("mol_id", "v", F.array(*[c.cast("double") for c in columns]).alias("x"))
    return s.join(own, ["mol_id", "v"]).select(F.col("mol_id").cast("long"), F.col("v").cast("long"), "mean", "second", "x")


def _directions(moments: DataFrame, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """of(mean, eigenvectors with the largest first, own columns), a vertex to a row, gives directions of any length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in frames:
            if len(g):
                mean, x = (np.stack([np.array(r, float) for r in g[c]]) for c in ("mean", "x"))
                k = mean.shape[1]
                _, vectors = np.linalg.eigh(np.stack(g["second"].to_numpy()).reshape(-1, k, k))
                d = of(mean, vectors[:, :, ::-1], x)
                length = np.linalg.norm(d, axis=1)
                unit = [None if not n > 0 else list(row / n) for row, n in zip(d, length)]
                yield pd.DataFrame({"mol_id": g["mol_id"], "v": g["v"], "mean": list(mean), "direction": unit})

    return moments.mapInPandas(run, _OUT)


def shape_directions(near: DataFrame, values: DataFrame, coordinates: list[str], properties: list[str], kept: int = 4, coordinate_scale: float = 1000.0) -> DataFrame:
    """mol_id, v, mean, direction: where the vertex's properties lead beyond what its coordinates explain.

    Within the kept principal axes of (scaled coordinates, properties), each property's own deviation from the mean is
    freed, one after another, of the coordinates' unit directions; the direction is the sum of what is left.
    """
    scaled = [F.col(c) * coordinate_scale for c in coordinates] + [F.col(p) for p in properties]
    m = len(coordinates)

    def of(mean: np.ndarray, vectors: np.ndarray, x: np.ndarray) -> np.ndarray:
        axes = vectors[:, :, :kept]
        total = np.zeros((len(x), axes.shape[2]))
        for j in range(m, x.shape[1]):
            part = axes[:, j, :] * (x[:, j] - mean[:, j])[:, None]
            for i in range(m):
                base = axes[:, i, :]
                length = np.linalg.norm(base, axis=1, keepdims=True)
                base = base / np.where(length > 0, length, 1.0)
                part = part - (part * base).sum(axis=1, keepdims=True) * base
            total += part
        return np.einsum("nij,nj->ni", axes, total)

    return _directions(_moments(near, values, scaled, True), of)


def principal_directions(near: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """mol_id, v, mean, direction: the principal direction about zero, which weighs the columns' own size."""

    def of(mean: np.ndarray, vectors: np.ndarray, x: np.ndarray) -> np.ndarray:
        d = vectors[:, :, 0]
        return d * np.sign(np.take_along_axis(d, np.abs(d).argmax(axis=1)[:, None], 1))

    return _directions(_moments(near, values, [F.col(c) for c in columns], False), of)


def project(directions: DataFrame, values: DataFrame, columns: list[str], central: bool = False) -> DataFrame:
    """mol_id, v, value: the vertex's columns along its direction, less the mean's share if central. values may be those
    of any level of a scale space; the directions stay those they were taken from."""
    d = directions.join(values.select("mol_id", "v", *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]), ["mol_id", "v"])
    parts = [(F.col(f"x{i}") - (F.col("mean")[i] if central else 0.0)) * F.col("direction")[i] for i in range(len(columns))]
    return d.select("mol_id", "v", sum(parts[1:], parts[0]).alias("value"))


def response_hessians(local: DataFrame, response: DataFrame) -> DataFrame:
    """mol_id, v, level, hpp, hpq, hqq, ratio: the Hessian of response(mol_id, v, level, value), a projected field, over
    local(mol_id, v, u, p, q), and the ratio of its eigenvalues. All levels go through one fit."""
    a = response.select("mol_id", "v", "level", F.col("value").alias("own"))
    b = response.select("mol_id", F.col("v").alias("u"), "level", F.col("value").alias("near"))
    steps = local.select("mol_id", "v", "u", "p", "q").join(b, ["mol_id", "u"]).join(a, ["mol_id", "v", "level"])
    keyed = steps.select(F.struct("mol_id", "level").alias("mol_id"), "v", "p", "q", (F.col("near") - F.col("own")).alias("df"))
    h = hessian(keyed, gradient(keyed))
    return h.select("mol_id.mol_id", "v", "mol_id.level", "hpp", "hpq", "hqq", X.eigen_ratio(F.col("hpp"), F.col("hpq"), F.col("hqq"), F.lit(0.0), 0.0).alias("ratio"))

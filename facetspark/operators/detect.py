"""Detection of singular points: responses, extrema, ridge and strength filters, greedy merging of levels."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import chain, product
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetspark.functions.expressions import combination, detector
from facetspark.operators.filters import apply_kernels, difference_of_gaussians, gaussian, laplacian_of_gaussian
from facetspark.operators.geometry import hessian_responses
from facetspark.operators.neighbours import local_extrema, scale_extrema
from facetspark.operators.stats import standardise


#: Points of an object up to which greedy_points works on many objects together.
SMALL = 32


class Finder(Protocol):
    """What finds singular points of surfaces; plug-ins implement find()."""

    def find(self, vertices: DataFrame, edges: DataFrame, near: DataFrame) -> DataFrame:
        """points(mol_id, level, v, kind, value)."""


def ridge_filter(points: DataFrame, ratios: DataFrame, near: DataFrame, threshold: float) -> DataFrame:
    """points(mol_id, v) without those that have a vertex u in near(mol_id, v, u), itself included, of ratio >= threshold."""
    high = ratios.where(F.col("ratio") >= threshold).select("mol_id", F.col("v").alias("u"))
    itself = high.select("mol_id", F.col("u").alias("v"))
    bad = near.select("mol_id", "v", "u").join(high, ["mol_id", "u"]).select("mol_id", "v").union(itself).distinct()
    return points.join(bad, ["mol_id", "v"], "left_anti")


def strength_filter(points: DataFrame, responses: DataFrame, near: DataFrame, weak: float = 0.15, strong: float = 0.35) -> DataFrame:
    """points(mol_id, v, value) with a response of at least weak by size; below strong, all neighbours must have it too."""
    faint = responses.where(F.abs("response") < weak).select("mol_id", F.col("v").alias("u"))
    beside = near.select("mol_id", "v", "u").join(faint, ["mol_id", "u"]).select("mol_id", "v").distinct()
    enough = points.where(F.abs("value") >= weak)
    return enough.where(F.abs("value") >= strong).unionByName(enough.where(F.abs("value") < strong).join(beside, ["mol_id", "v"], "left_anti"))


def _kept_of_one(x: np.ndarray, kinds: Sequence[np.ndarray], radius: float, cells: dict) -> np.ndarray:
    """Which points of one object, in order, are kept; cells holds those kept so far, by types and cell."""
    steps, kept = list(product((-1, 0, 1), repeat=min(x.shape[1], 3))), np.ones(len(x), bool)
    for i, (kind, p) in enumerate(zip(zip(*kinds) if kinds else [()] * len(x), x.tolist())):
        if not all(map(math.isfinite, p)):
            continue  # near to none
        own = tuple(int(c // radius) for c in p[:3])
        near = (q for s in steps for q in cells.get((kind, *(a + b for a, b in zip(own, s))), ()))
        kept[i] = all(math.sqrt(sum((a - b) * (a - b) for a, b in zip(p, q))) >= radius for q in near)
        if kept[i]:
            cells.setdefault((kind, *own), []).append(p)
    return kept


def _kept_of_small(first: np.ndarray, size: np.ndarray, x: np.ndarray, kinds: Sequence[np.ndarray], radius: float) -> np.ndarray:
    """Which points of many small objects (their first rows and sizes), in order, are kept: all objects' points of one
    place together, against those of each place before."""
    kept, order = np.zeros(len(x), bool), np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(size[0] if len(size) else 0):
            at = first[: np.searchsorted(-size, -j)]  # objects of more than j points
            near = np.zeros(len(at), bool)
            for i in range(j):
                apart = x[at + j] - x[at + i]
                apart *= apart
                total = apart[:, 0].copy()
                for k in range(1, x.shape[1]):
                    total += apart[:, k]
                hit = kept[at + i] & (np.sqrt(total) < radius)
                for kind in kinds:
                    hit &= kind[at + j] == kind[at + i]
                near |= hit
            kept[at + j] = ~near
    return kept


def greedy_points(points: DataFrame, radius: float, order: Sequence[str], coords: Sequence[str] = ("x", "y", "z"), types: Sequence[str] = ()) -> DataFrame:
    """Points kept in order unless an earlier kept one of the object is nearer than radius with the same types. A point
    without a coordinate is kept and near to none.

    Depends on the order, so an object is one task's work: rows are dealt out by object, sorted, and streamed. Objects of
    at most SMALL points are worked on together, a batch at a time; of a larger one the kept points are held in cells of
    side radius (over up to three coordinates), so that each point is compared with its surroundings only.
    """
    names, schema = points.columns, points.schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = held = last = None  # rows of an object that may go on, or what it kept if it has more than SMALL
        for g in chain(frames, [None]):
            if g is not None and not len(g):
                continue
            if g is None:
                if rest is None:
                    return
                g, ended = rest, True
            else:
                new = g["mol_id"].iloc[0]
                if held is not None and not (last == new or (pd.isna(last) and pd.isna(new))):
                    held = None
                g, ended = g if rest is None else pd.concat([rest, g], ignore_index=True), False
            code = pd.factorize(g["mol_id"])[0]
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            size = np.diff(np.append(first, len(g)))
            x, kinds, kept = np.stack([g[c].to_numpy(float) for c in coords], axis=1), [g[t].to_numpy() for t in types], np.zeros(len(g), bool)
            small = size <= SMALL
            if held is not None:
                small[0] = False
            wait = bool(small[-1]) and not ended
            together = small.copy()
            together[-1] &= not wait
            kept |= _kept_of_small(first[together], size[together], x, kinds, radius)
            for n in np.flatnonzero(~small):
                own = slice(first[n], first[n] + size[n])
                held = {} if n or held is None else held
                kept[own] = _kept_of_one(x[own], [k[own] for k in kinds], radius, held)
            if small[-1]:
                held = None
            rest, last = g.iloc[first[-1] :] if wait else None, g["mol_id"].iloc[-1]
            yield g.iloc[np.flatnonzero(kept)][names]

    return points.repartition("mol_id").sortWithinPartitions("mol_id", *order).mapInPandas(run, schema)


def merge_levels(points: DataFrame, radius: float = 1.0) -> DataFrame:
    """Each level's points with those of the levels beside it, the own ones first, merged greedily."""
    steps = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(rank).alias("rank")) for d, rank in ((0, 0), (-1, 1), (1, 2))]))
    last = points.agg(F.max("level")).first()[0]
    spread = points.withColumn("_s", steps).withColumn("at", F.col("level") - F.col("_s.d")).where(F.col("at").between(0, last if last is not None else -1))
    spread = spread.withColumn("rank", F.col("_s.rank")).drop("_s")
    keyed = spread.withColumn("mol_id", F.struct("mol_id", "at"))
    flat = keyed.withColumn("_mol", F.col("mol_id.mol_id")).withColumn("mol_id", F.xxhash64("mol_id"))
    kept = greedy_points(flat, radius, ["rank", "v"], types=("at",))
    return kept.select(F.col("_mol").alias("mol_id"), F.col("at").alias("level"), "v", "x", "y", "z").distinct()


def responses(near: DataFrame, values: DataFrame, sigmas: Sequence[float], kind: str = "dog") -> DataFrame:
    """mol_id, v, level, value: the blob response at every sigma, standardised by object and level."""
    kind, out = detector(kind), None
    if kind == "hess_det":
        raise ValueError("Hessian responses come from hessian_levels")
    for level, sigma in enumerate(sigmas):
        if kind == "dog":
            one = difference_of_gaussians(near, values, sigma, coefficient=sigma / 0.1)
        else:
            one = apply_kernels(near, values, {"response": laplacian_of_gaussian(sigma)}).withColumn("response", F.col("response") * sigma)
        one = one.withColumn("level", F.lit(level))
        out = one if out is None else out.unionByName(one)
    scaled = standardise(out.withColumnRenamed("response", "raw"), "raw", "mol_id", "level")
    return scaled.select("mol_id", "v", "level", F.col("response").alias("value"))


def hessian_levels(near: DataFrame, vertices: DataFrame, sigmas: Sequence[float], properties: Sequence[str], channel: str = "scalar") -> DataFrame:
    """mol_id, v, level, value: the Hessian response of the properties, blurred at every sigma, standardised by object
    and level; near has the neighbours' places p, q in the tangent plane beside d."""
    out = None
    for prop in properties:
        field = vertices.select("mol_id", "v", F.col(prop).alias("value"))
        blurred = apply_kernels(near, field, {f"s{k}": gaussian(s) for k, s in enumerate(sigmas)})
        levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"s{k}").alias("value")) for k in range(len(sigmas))]))
        one = blurred.select("mol_id", "v", levels.alias("at")).select("mol_id", "v", "at.level", F.lit(prop).alias("prop"), "at.value")
        out = one if out is None else out.unionByName(one)
    found = hessian_responses(near, out, list(sigmas)).select("mol_id", "v", "level", F.col(channel).alias("raw"))
    return standardise(found, "raw", "mol_id", "level").select("mol_id", "v", "level", F.col("response").alias("value"))


class ScaleSpaceFinder:
    """Blob responses over sigmas, extrema in space and scale.

    The kind hess_det takes the Hessians of properties, combined by channels; the other kinds have the scalar channel
    and one property. PCA over properties is geometry.local_pca and no channel of a finder.
    """

    def __init__(self, sigmas: Sequence[float], kind: str = "dog", channels: str = "scalar", properties: Sequence[str] = ("value",)):
        self.sigmas, self.kind, self.channels, self.properties = list(sigmas), detector(kind), combination(channels), list(properties)
        if self.channels == "pca" or (self.kind != "hess_det" and (self.channels != "scalar" or len(self.properties) > 1)):
            raise ValueError(f"{self.kind} has no channels {self.channels} of {len(self.properties)} properties")

    def responses(self, vertices: DataFrame, near: DataFrame) -> DataFrame:
        if self.kind == "hess_det":
            return hessian_levels(near, vertices, self.sigmas, self.properties, self.channels)
        return responses(near, vertices.select("mol_id", "v", F.col(self.properties[0]).alias("value")), self.sigmas, self.kind)

    def find(self, vertices: DataFrame, edges: DataFrame, near: DataFrame) -> DataFrame:
        return scale_extrema(self.responses(vertices, near), edges)


def separate_extrema(finders: Sequence[ScaleSpaceFinder], vertices: DataFrame, edges: DataFrame, near: DataFrame, radius: float = 1.0) -> DataFrame:
    """Points of several finders, one for each property: in their order, no point within radius of one kept before.

    vertices have x, y, z; the result has mol_id, number (of the finder), level, v, kind, value and x, y, z.
    """
    out = None
    for number, own in enumerate(finders):
        one = own.find(vertices, edges, near).select("mol_id", F.lit(number).alias("number"), "level", "v", "kind", "value")
        out = one if out is None else out.unionByName(one)
    placed = out.join(vertices.select("mol_id", "v", "x", "y", "z"), ["mol_id", "v"])
    return greedy_points(placed, radius, ["number", "level", "v"])


class PlainFinder:
    """Extrema of the field itself, at level 0."""

    def find(self, vertices: DataFrame, edges: DataFrame, near: DataFrame) -> DataFrame:
        return local_extrema(vertices.select("mol_id", "v", "value"), edges).withColumn("level", F.lit(0))


def finder(use_levels: bool, **options) -> Finder:
    return ScaleSpaceFinder(**options) if use_levels else PlainFinder()

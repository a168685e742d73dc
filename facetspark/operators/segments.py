"""Segmentation of surfaces: parts of equal curvature type, large ones split, the rest clustered, numbered without gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetspark.operators.graph import connected_components, majority, medoids, segment_edges, segments_by_value, voronoi_segments


def renumber(parts: DataFrame, *by: str) -> DataFrame:
    """mol_id, v, seg: the distinct values of by numbered from 1 within each object, in order."""
    distinct = parts.select("mol_id", *by).distinct().withColumn("_number", F.row_number().over(Window.partitionBy("mol_id").orderBy(*by)))
    return parts.join(distinct, ["mol_id", *by]).select("mol_id", "v", F.col("_number").alias("seg"))


def split_segments(segments: DataFrame, distances: DataFrame, largest: int) -> DataFrame:
    """mol_id, v, seg: segments of more than `largest` vertices cut into clusters; the first part keeps the number, the
    others get new ones after the greatest. Segment 0 stays."""
    size = F.count("*").over(Window.partitionBy("mol_id", "seg"))
    sized = segments.withColumn("_n", size)
    big = sized.where(f"seg <> 0 and _n > {int(largest)}")
    rest = sized.where(f"seg = 0 or _n <= {int(largest)}").select("mol_id", "v", "seg")
    cut = voronoi_segments(distances, big.select("mol_id", "v", F.col("seg").alias("component")), largest)
    last = segments.groupBy("mol_id").agg(F.max("seg").alias("last"))
    parts = cut.select("mol_id", "component", "centre").distinct()
    rank = F.row_number().over(Window.partitionBy("mol_id", "component").orderBy("centre"))
    fresh = parts.withColumn("_r", rank)
    added = fresh.where("_r > 1").withColumn("_k", F.row_number().over(Window.partitionBy("mol_id").orderBy("component", "centre"))).join(last, "mol_id").select("mol_id", "component", "centre", (F.col("last") + F.col("_k")).alias("seg"))
    first = fresh.where("_r = 1").select("mol_id", "component", "centre", F.col("component").alias("seg"))
    numbered = first.unionByName(added)
    return rest.unionByName(cut.join(numbered, ["mol_id", "component", "centre"]).select("mol_id", "v", "seg"))


def segment_surface(types: DataFrame, edges: DataFrame, distances: DataFrame, smallest: int = 5, largest: int = 500) -> DataFrame:
    """mol_id, v, seg of types(mol_id, v, type): convex (1) and concave (2) parts of `smallest` vertices or more, split
    above `largest`; saddles and what is left are clustered by nearness within their own connected parts."""
    curved = types.where("type in (1, 2)")
    ends = lambda part: edges.join(part.select("mol_id", F.col("v").alias("src")), ["mol_id", "src"], "left_semi").join(part.select("mol_id", F.col("v").alias("dst")), ["mol_id", "dst"], "left_semi")
    parts = segments_by_value(curved.select("mol_id", "v", F.col("type").alias("value")), ends(curved), smallest)
    firm = split_segments(parts.where("seg <> 0"), distances, largest).withColumn("kind", F.lit(0))
    loose = types.select("mol_id", "v").join(firm.select("mol_id", "v"), ["mol_id", "v"], "left_anti")
    clusters = voronoi_segments(distances, connected_components(loose, ends(loose)), largest).select("mol_id", "v", F.col("centre").alias("seg")).withColumn("kind", F.lit(1))
    return renumber(firm.unionByName(clusters), "kind", "seg")


def segment_graph(segments: DataFrame, edges: DataFrame, distances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Centres (mol_id, seg, center_v) and edges (mol_id, s1, s2) of the segments."""
    return medoids(distances, segments), segment_edges(edges, segments)


def votes_to_vertices(triangle_segments: DataFrame, triangles: DataFrame) -> DataFrame:
    """mol_id, v, seg: the segment that most of a vertex's triangles have, the least on ties."""
    votes = triangles.select("mol_id", "t", F.explode(F.array("a", "b", "c")).alias("v")).join(triangle_segments, ["mol_id", "t"])
    return majority(votes.select("mol_id", "v", "seg"), ["mol_id", "v"], "seg")

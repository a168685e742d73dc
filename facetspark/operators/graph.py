"""Graph operators on edge tables (mol_id, src, dst), both directions present unless stated.

Fixpoints are driver loops over DataFrames whose rounds are written to the shared checkpoint folder, so that lineage
stays short and lost executors cost one round; shortest paths, which need a priority queue, run as one numpy task for
each object.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where it may be unset, a folder of our own."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    return at or f"file://{tempfile.gettempdir()}/facetspark-rounds-{os.getpid()}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """mol_id, v, component: the least vertex of v's component.

    Labels move to the least label of the ring and then jump to the label's own label, so that the number of rounds
    grows with the logarithm of a component's diameter.
    """
    labels = written(vertices.select("mol_id", "v").distinct().withColumn("component", F.col("v")))
    links = written(edges.select("mol_id", "src", "dst").distinct())
    for _ in range(max_rounds):
        other = labels.select("mol_id", F.col("v").alias("dst"), F.col("component").alias("near"))
        least = links.join(other, ["mol_id", "dst"]).groupBy("mol_id", F.col("src").alias("v")).agg(F.min("near").alias("near"))
        moved = labels.join(least, ["mol_id", "v"], "left").select("mol_id", "v", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        roots = moved.select("mol_id", F.col("v").alias("component"), F.col("component").alias("root"))
        after = written(moved.join(roots, ["mol_id", "component"], "left").select("mol_id", "v", "old", F.least("component", "root").alias("component")))
        changed = not after.where("component <> old").isEmpty()
        labels = after.select("mol_id", "v", "component")
        if not changed:
            return labels
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")


def segments_by_value(values: DataFrame, edges: DataFrame, min_size: int = 1) -> DataFrame:
    """mol_id, v, seg over values(mol_id, v, value): components of equal neighbours, numbered from 1 without gaps by
    their least vertex; those below min_size get 0."""
    a, b = values.select("mol_id", F.col("v").alias("src"), F.col("value").alias("x")), values.select("mol_id", F.col("v").alias("dst"), F.col("value").alias("y"))
    same = edges.join(a, ["mol_id", "src"]).join(b, ["mol_id", "dst"]).where("x = y").select("mol_id", "src", "dst")
    comp = connected_components(values, same).withColumn("size", F.count("*").over(Window.partitionBy("mol_id", "component")))
    kept = comp.where(F.col("size") >= min_size).select("mol_id", "component").distinct()
    numbered = kept.withColumn("seg", F.row_number().over(Window.partitionBy("mol_id").orderBy("component")))
    return comp.join(numbered, ["mol_id", "component"], "left").select("mol_id", "v", F.coalesce("seg", F.lit(0)).alias("seg"))


def segments_from_seeds(values: DataFrame, edges: DataFrame, seeds: DataFrame, tolerance: float) -> DataFrame:
    """mol_id, seed, v: vertices reached from each seed over vertices within tolerance of the seed's value."""
    start = seeds.select("mol_id", "seed").join(values.select("mol_id", F.col("v").alias("seed"), F.col("value").alias("at")), ["mol_id", "seed"])
    ways, field = edges.select("mol_id", "src", "dst"), values.select("mol_id", F.col("v").alias("dst"), F.col("value").alias("to"))
    front = written(start.select("mol_id", "seed", F.col("seed").alias("v"), "at"))
    reached = front.drop("at")
    while True:
        step = front.withColumnRenamed("v", "src").join(ways, ["mol_id", "src"]).select("mol_id", "seed", "dst", "at").distinct()
        near = step.join(field, ["mol_id", "dst"]).where(F.abs(F.col("to") - F.col("at")) <= tolerance).select("mol_id", "seed", F.col("dst").alias("v"), "at").distinct()
        front = written(near.join(reached, ["mol_id", "seed", "v"], "left_anti"))
        if front.isEmpty():
            return reached
        reached = reached.union(front.drop("at").select("mol_id", "seed", "v"))


def reachable(seeds: DataFrame, edges: DataFrame, keys: list[str], max_rounds: int = 1000) -> DataFrame:
    """keys, v: what edges(keys, src, dst) lead to from seeds(keys, v), themselves included."""
    reached = front = written(seeds.select(*keys, "v").distinct())
    for _ in range(max_rounds):
        step = front.withColumnRenamed("v", "src").join(edges, [*keys, "src"]).select(*keys, F.col("dst").alias("v")).distinct()
        front = written(step.join(reached, [*keys, "v"], "left_anti"))
        if front.isEmpty():
            return reached
        reached = reached.union(front)
    raise RuntimeError(f"not all reached after {max_rounds} rounds")


def bfs_hops(seeds: DataFrame, edges: DataFrame, radius: int) -> DataFrame:
    """mol_id, v, hops: least number of edges from a seed, up to radius; other vertices are absent."""
    reached = seeds.select("mol_id", "v").distinct().withColumn("hops", F.lit(0))
    front = reached
    for hop in range(1, radius + 1):
        step = front.select("mol_id", F.col("v").alias("src")).join(edges, ["mol_id", "src"]).select("mol_id", F.col("dst").alias("v")).distinct()
        front = written(step.join(reached, ["mol_id", "v"], "left_anti").withColumn("hops", F.lit(hop)))
        reached = reached.unionByName(front)
    return reached


def fill_from_borders(values: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """values(mol_id, v, value) with NULL values filled layer by layer by the mean of finished neighbours.

    Vertices that no edges lead to from a value stay NULL. Raises RuntimeError if max_rounds layers aren't enough.
    """
    start = values.select("mol_id", "v", F.col("value").cast("double").alias("value"), F.lit(0).alias("layer"))
    done = front = written(start.where("value is not null"))
    # What is finished beside an open vertex is of the last layer, or the vertex would have been filled before.
    open_ = written(start.where("value is null"))
    ways = written(edges.select("mol_id", "src", "dst").join(open_.select("mol_id", F.col("v").alias("src")), ["mol_id", "src"], "left_semi"))
    for layer in range(1, max_rounds):
        near = front.select("mol_id", F.col("v").alias("dst"), F.col("value").alias("near"))
        means = ways.join(near, ["mol_id", "dst"]).groupBy("mol_id", F.col("src").alias("v")).agg(F.avg("near").alias("mean"))
        front = written(open_.join(means, ["mol_id", "v"]).select("mol_id", "v", F.col("mean").alias("value"), F.lit(layer).alias("layer")))
        if front.isEmpty():
            return done.union(open_)
        done, open_ = done.union(front), written(open_.join(front, ["mol_id", "v"], "left_anti"))
        ways = written(ways.join(front.select("mol_id", F.col("v").alias("src")), ["mol_id", "src"], "left_anti"))
    raise RuntimeError(f"not filled after {max_rounds} layers")


def _dijkstra(src: np.ndarray, dst: np.ndarray, length: np.ndarray, n: int, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import heapq

    ring: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for s, d, w in zip(src.tolist(), dst.tolist(), length.tolist()):
        ring[s].append((d, w))
    out = []
    for s in range(n):
        best, done, heap = {s: 0.0}, set(), [(0.0, s)]
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            out.append((s, v, d))
            for u, w in ring[v]:
                if (x := d + w) <= limit and x < best.get(u, np.inf):
                    best[u] = x
                    heapq.heappush(heap, (x, u))
    got = np.array(out)
    return got[:, 0].astype(int), got[:, 1].astype(int), got[:, 2]


def _within_edges(edges: DataFrame, limit: float, max_edges: int) -> DataFrame:
    """geodesics() over paths of at most max_edges edges, a join for each edge after the first."""
    ways = written(edges.select(F.col("mol_id").cast("long"), F.col("src").cast("long"), F.col("dst").cast("long"), F.col("len").cast("double")))
    names = "mol_id", F.col("src").alias("v")
    own = ways.select(*names, F.col("src").alias("u"), F.lit(0.0).alias("d")).distinct()
    found = own.unionByName(ways.select(*names, F.col("dst").alias("u"), F.col("len").alias("d")))
    for _ in range(1, max_edges):
        longer = found.where("v <> u").join(ways.withColumnRenamed("src", "u"), ["mol_id", "u"]).select("mol_id", "v", F.col("dst").alias("u"), (F.col("d") + F.col("len")).alias("d"))
        found = found.unionByName(longer.where(F.col("d") <= limit)).groupBy("mol_id", "v", "u").agg(F.min("d").alias("d"))
    return found.where(F.col("d") <= limit).groupBy("mol_id", "v", "u").agg(F.min("d").alias("d"))


def geodesics(edges: DataFrame, limit: float = float("inf"), max_edges: int | None = None) -> DataFrame:
    """mol_id, v, u, d: shortest path lengths over edges(mol_id, src, dst, len), both directions given, up to limit; with
    max_edges, over paths of no more edges than that.

    Includes v = u at 0; pairs that aren't connected (or beyond limit) are absent. Without max_edges one task holds one
    object's edges.
    """
    if max_edges is not None:
        return _within_edges(edges, limit, max_edges)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        names, flat = np.unique(np.concatenate([g["src"].to_numpy(), g["dst"].to_numpy()]), return_inverse=True)
        v, u, d = _dijkstra(flat[: len(g)], flat[len(g) :], g["len"].to_numpy(), len(names), limit)
        return pd.DataFrame({"mol_id": g["mol_id"].iloc[0], "v": names[v], "u": names[u], "d": d})

    return edges.select(F.col("mol_id").cast("long"), F.col("src").cast("long"), F.col("dst").cast("long"), F.col("len").cast("double")).groupBy("mol_id").applyInPandas(one, "mol_id long, v long, u long, d double")


def medoids(distances: DataFrame, segments: DataFrame) -> DataFrame:
    """mol_id, seg, center_v: the vertex with the least sum of distances within its segment, the first on ties."""
    own, other = segments.where("seg <> 0").select("mol_id", "v", "seg"), segments.where("seg <> 0").select("mol_id", F.col("v").alias("u"), F.col("seg").alias("seg_u"))
    sums = distances.join(own, ["mol_id", "v"]).join(other, ["mol_id", "u"]).where("seg = seg_u").groupBy("mol_id", "seg", "v").agg(F.sum("d").alias("total"))
    return sums.groupBy("mol_id", "seg").agg(F.min_by("v", F.struct("total", "v")).alias("center_v"))


def segment_edges(edges: DataFrame, segments: DataFrame) -> DataFrame:
    """mol_id, s1 < s2 of segments that an edge joins."""
    a, b = segments.select("mol_id", F.col("v").alias("src"), F.col("seg").alias("a")), segments.select("mol_id", F.col("v").alias("dst"), F.col("seg").alias("b"))
    crossing = edges.join(a, ["mol_id", "src"]).join(b, ["mol_id", "dst"]).where("a <> b and a <> 0 and b <> 0")
    return crossing.select("mol_id", F.least("a", "b").alias("s1"), F.greatest("a", "b").alias("s2")).distinct()


def _seeds(components: DataFrame, size: int) -> DataFrame:
    """components with _seed: whether the vertex is a seed, every (n / k)-th member of its component in order."""
    w = Window.partitionBy("mol_id", "component")
    ranked = components.withColumn("_i", F.row_number().over(w.orderBy("v")) - 1).withColumn("_n", F.count("*").over(w)).withColumn("_k", F.greatest(F.lit(1), F.ceil(F.col("_n") / size)).cast("long"))
    step = F.floor(F.col("_n") / F.col("_k"))
    return ranked.withColumn("_seed", (F.col("_i") % step == 0) & (F.col("_i") / step < F.col("_k")))


def voronoi_segments(distances: DataFrame, components: DataFrame, size: int, rounds: int = 1) -> DataFrame:
    """mol_id, v, component, centre: every component cut into about (members / size) clusters.

    Seeds are every (n / k)-th member in order; members go to the nearest centre by distances(mol_id, v, u, d), ties to
    the lesser one; a member without a distance to any centre is left out. rounds = 1 assigns to the seeds; more rounds move
    each centre to its cluster's medoid in between.
    """
    centres = _seeds(components, size).where("_seed").select("mol_id", "component", F.col("v").alias("u"))
    found = None
    for i in range(rounds):
        reach = distances.join(components, ["mol_id", "v"]).join(centres, ["mol_id", "component", "u"])
        found = reach.groupBy("mol_id", "component", "v").agg(F.min_by("u", F.struct("d", "u")).alias("centre"))
        if i + 1 < rounds:
            found = written(found)
            centres = medoids(distances, found.select("mol_id", "v", F.col("centre").alias("seg"))).join(found.select("mol_id", F.col("v").alias("center_v"), "component"), ["mol_id", "center_v"]).select("mol_id", "component", F.col("center_v").alias("u"))
    return found


def path_segments(components: DataFrame, size: int) -> DataFrame:
    """voronoi_segments() of paths, where a vertex's number v is its place: the nearest seed is the last one before or the
    first one after, however far, so that no distance is a row."""
    w = Window.partitionBy("mol_id", "component")
    own = F.when(F.col("_seed"), F.col("v"))
    # Running windows both ways: one that looks ahead to the end would go over the rest of the path for each vertex.
    sided = _seeds(components.where("mol_id is not null"), size).withColumn("_before", F.last(own, ignorenulls=True).over(w.orderBy("v"))).withColumn("_after", F.last(own, ignorenulls=True).over(w.orderBy(F.desc("v"))))
    nearest = F.when(F.col("_after") - F.col("v") < F.col("v") - F.col("_before"), F.col("_after")).otherwise(F.col("_before"))
    return sided.select("mol_id", "component", "v", nearest.alias("centre"))


def majority(votes: DataFrame, keys: list[str], choice: str) -> DataFrame:
    """keys, choice: the most frequent one, the least on ties."""
    counted = votes.groupBy(*keys, choice).agg(F.count("*").alias("_n"))
    return counted.groupBy(*keys).agg(F.min_by(choice, F.struct(-F.col("_n"), F.col(choice))).alias(choice))


def triangle_types(triangles: DataFrame, types: DataFrame, saddle: int = 3) -> DataFrame:
    """mol_id, t, type: the type that at least two corners have, else saddle."""
    c = triangles.select("mol_id", "t", F.explode(F.array("a", "b", "c")).alias("v")).join(types, ["mol_id", "v"]).groupBy("mol_id", "t", "type").agg(F.count("*").alias("n"))
    return c.groupBy("mol_id", "t").agg(F.coalesce(F.min(F.when(F.col("n") >= 2, F.col("type"))), F.lit(saddle)).alias("type"))


def ring_bonds(bonds: DataFrame) -> DataFrame:
    """bonds(mol_id, i, j) with in_ring: a bond is in a ring if its ends stay connected without it (it is no bridge)."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        pairs_ = list(zip(g["i"].tolist(), g["j"].tolist()))
        ring: dict[int, set[int]] = {}
        for i, j in pairs_:
            ring.setdefault(i, set()).add(j)
            ring.setdefault(j, set()).add(i)

        def joined(i: int, j: int) -> bool:
            seen, todo = {i}, [i]
            while todo:
                v = todo.pop()
                for u in ring[v]:
                    if {v, u} != {i, j} and u not in seen:
                        if u == j:
                            return True
                        seen.add(u)
                        todo.append(u)
            return False

        return g[["mol_id", "i", "j"]].assign(in_ring=[joined(i, j) for i, j in pairs_])

    return bonds.select(F.col("mol_id").cast("long"), F.col("i").cast("long"), F.col("j").cast("long")).groupBy("mol_id").applyInPandas(one, "mol_id long, i long, j long, in_ring boolean")


def frame_conflicts(frames: DataFrame, edges: DataFrame) -> DataFrame:
    """mol_id, v, conflict over frames(mol_id, v, ux, uy, uz): whether the axis points against some neighbour's."""
    a = frames.select("mol_id", F.col("v").alias("src"), *[F.col(f"u{c}").alias(f"a{c}") for c in "xyz"])
    b = frames.select("mol_id", F.col("v").alias("dst"), *[F.col(f"u{c}").alias(f"b{c}") for c in "xyz"])
    against = sum((F.col(f"a{c}") * F.col(f"b{c}") for c in "xyz"), F.lit(0.0)) < 0
    return edges.join(a, ["mol_id", "src"]).join(b, ["mol_id", "dst"]).groupBy("mol_id", F.col("src").alias("v")).agg(F.bool_or(against).alias("conflict"))

"""Centroid clustering: Lloyd's rounds over partition-local metric trees.

Vectors become integers (floor(scale * x)). Each task packs its vectors into balls: a tree over at most `TREE` of them,
whose nodes store their vectors' count, exact integer sum, mean and radius. Trees are built once and written; a round
sends the few centroids along and descends each tree. By the triangle inequality a centroid c rules another one out for
a whole ball if d(c, mean) + radius < d(other, mean) - radius. A ball with one centroid left is assigned by its count and
sum; any other is split down to leaves, whose vectors are compared one by one, exactly. What comes back to the driver is
a count and a sum for each centroid, whatever the number of vectors.

Bounds on real distances carry a slack, so that rounding only makes a ball descend further, never decides; distances that
decide are integers, ties go to the smaller number.

Defined results: only vectors with exactly dims components, none of them null, NaN or infinite, are kept; a null
vec_id stays but is no starting centroid unless there are too few others; repeated rows count as often as they stand
there; components whose integer is beyond 2^27 in size are taken as 2^27, so that distances fit a long; fewer
vectors than k give as many centroids as there are vectors; an empty table gives an empty table; only vec_id and the
vector are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetspark.llm.common import as_documents, drop_staged, releasing, stage

#: Vectors in a tree, and in a leaf.
TREE = 8192
LEAF = 32
#: Components are at most this large.
LARGEST = 1 << 27
#: Slack of the squared bounds, as a share of the largest squares that go into them.
SLACK = 1e-12

_TREE = "vec_id array<long>, vector binary, first binary, last binary, child binary, total binary, radius binary"


def whole(vectors: DataFrame, dims: int, scale: int, vector: str = "embedding") -> DataFrame:
    """vec_id and the integer components x (array<int>) of the vectors that are kept."""
    own = as_documents(vectors, ["vec_id", vector]).toDF("vec_id", "x").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("x").cast("array<double>").alias("x"))
    fine = F.coalesce((F.size("x") == dims) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    integer = lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(v * scale))).cast("int")
    return own.where(fine).select("vec_id", F.transform("x", integer).alias("x"))


def build_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The vectors' order, and by node the first and one past the last of them, the left child (the right one follows it;
    0 for a leaf), the sum and the radius around the mean. Node 0 is the root; children come after their parents."""
    order, spans, child, at = np.arange(len(x)), [(0, len(x))], [], 0
    total, radius = [], []
    while at < len(spans):
        lo, hi = spans[at]
        own = x[order[lo:hi]]
        total.append(own.sum(axis=0))
        away = own - total[-1] / len(own)
        far = np.einsum("ij,ij->i", away, away)
        radius.append(np.sqrt(far.max()))
        if hi - lo <= leaf or far.max() < 0.25:  # copies of one vector need no halves
            child.append(0)
        else:
            a = own[far.argmax()]
            from_a = own - a
            b = own[np.einsum("ij,ij->i", from_a, from_a).argmax()]
            half = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(from_a @ (b - a).astype(float), half)]
            child.append(len(spans))
            spans += [(lo, lo + half), (lo + half, hi)]
        at += 1
    first, last = np.array(spans, np.int64).T
    return order, first, last, np.array(child, np.int64), np.array(total, np.int64), np.array(radius)


def _trees(dims: int):
    def pack(ids: list, rows: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(rows).reshape(-1, dims).astype(np.int64)
        order, first, last, child, total, radius = build_tree(x)
        values = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.concat_arrays(ids).take(pa.array(order)))]
        values += [pa.array([v.tobytes()], pa.binary()) for v in (x[order].astype(np.int32), first, last, child, total, radius)]
        return pa.RecordBatch.from_arrays(values, [c.split()[0] for c in _TREE.split(", ")])

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, n = [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, TREE):
                part = batch.slice(lo, TREE)
                ids.append(part.column(0))
                rows.append(part.column(1).flatten().to_numpy())
                n += part.num_rows
                if n >= TREE:
                    yield pack(ids, rows)
                    ids, rows, n = [], [], 0
        if n:
            yield pack(ids, rows)

    return run


def exact_squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c, as integers."""
    largest = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    kind = np.float64 if x.shape[1] * 4 * float(largest) ** 2 < 2**53 else np.int64  # whole numbers below 2^53 are exact
    a, b = x.astype(kind), c.astype(kind)
    if kind is np.float64:
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)


def descend(tree: dict, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Each vector's centroid, the centroids' counts and sums, and how many vectors were compared one by one."""
    n, k = len(tree["x"]), len(c)
    size = tree["last"] - tree["first"]
    mean = tree["total"] / size[:, None]
    centre = c.astype(float)
    d = np.sqrt(np.maximum((mean * mean).sum(axis=1)[:, None] - 2 * mean @ centre.T + (centre * centre).sum(axis=1), 0))
    reach = np.sqrt((mean * mean).sum(axis=1)) + np.sqrt((centre * centre).sum(axis=1)).max(initial=0) + 1
    # The square of d is off by SLACK times the square of reach at most, so d itself by its root.
    slack = reach * np.sqrt(SLACK)
    upper, lower = d + (tree["radius"] + slack)[:, None], d - (tree["radius"] + slack)[:, None]
    open_ = lower <= upper.min(axis=1)[:, None]
    owner, count, total = np.zeros(n, np.int64), np.zeros(k, np.int64), np.zeros((k, c.shape[1]), np.int64)
    todo, compared = [0], []
    while todo:
        node = todo.pop()
        left = np.flatnonzero(open_[node])
        lo, hi = tree["first"][node], tree["last"][node]
        if len(left) == 1:
            owner[lo:hi] = left[0]
            count[left[0]] += hi - lo
            total[left[0]] += tree["total"][node]
        elif tree["child"][node]:
            todo += [tree["child"][node], tree["child"][node] + 1]
        else:
            compared.append(np.arange(lo, hi))
    if compared:
        rows = np.concatenate(compared)
        x = tree["x"][rows]
        owner[rows] = own = exact_squares(x, c).argmin(axis=1)  # the first, so the smaller number, of equal ones
        count += np.bincount(own, minlength=k)
        for j in np.unique(own):
            total[j] += x[own == j].sum(axis=0)
    return owner, count, total, sum(map(len, compared))


def _read_trees(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, dict]]:
    for i in range(batch.num_rows):
        raw = [batch.column(j)[i].as_buffer() for j in range(1, 7)]
        kinds = (np.int32, np.int64, np.int64, np.int64, np.int64, np.float64)
        x, first, last, child, total, radius = (np.frombuffer(r, t) for r, t in zip(raw, kinds))
        yield batch.column(0)[i].values, {"x": x.reshape(-1, dims).astype(np.int64), "first": first, "last": last, "child": child, "total": total.reshape(-1, dims), "radius": radius}


def _sums(c: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, compared = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64), 0
        for batch in batches:
            for _, tree in _read_trees(batch, c.shape[1]):
                _, n, s, one_by_one = descend(tree, c)
                count, total, compared = count + n, total + s, compared + one_by_one
        if count.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(len(c)), pa.int32()), pa.array(count), pa.array(total.tolist(), pa.list_(pa.int64())), pa.array([compared] + [0] * (len(c) - 1), pa.int64())], ["cluster", "n", "total", "compared"])

    return run


def _assigned(c: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _read_trees(batch, c.shape[1]):
                owner, _, _, _ = descend(tree, c)
                distance = np.zeros(len(owner), np.int64)
                for j in np.unique(owner):
                    own = owner == j
                    distance[own] = exact_squares(tree["x"][own], c[j : j + 1])[:, 0]
                yield pa.RecordBatch.from_arrays([ids, pa.array(owner.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def starting_rank(vec_id: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), vec_id.cast("string")), 256)


class Clustering:
    """centroids (list of integer lists), assigned(vec_id, cluster, distance), and by round the share of vectors that were
    compared one by one."""

    def __init__(self, centroids: list[list[int]], assigned: DataFrame, compared: list[float]):
        self.centroids, self.assigned, self.compared = centroids, assigned, compared


def fit(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3:", vector: str = "embedding") -> Clustering:
    """Lloyd's rounds from the k vectors whose salted vec_id has the smallest hash; means are rounded down."""
    spark, kept = vectors.sparkSession, whole(vectors, dims, scale, vector)
    rank = starting_rank(F.col("vec_id"), salt)
    start = kept.select("x", rank.alias("h")).orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()  # k rows
    c = np.array([r["x"] for r in start], np.int64).reshape(-1, dims)
    if not len(c):
        return Clustering([], spark.createDataFrame([], "vec_id long, cluster int, distance long"), [])
    trees, compared = stage(kept.mapInArrow(_trees(dims), _TREE), "trees"), []
    for _ in range(rounds):
        parts = trees.mapInArrow(_sums(c), "cluster int, n long, total array<long>, compared long")
        each = parts.select("cluster", "n", "compared", F.posexplode("total").alias("i", "value"))
        found = each.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("total"), F.sum("compared").alias("compared")).collect()  # k x dims rows
        for r in found:
            if r["n"]:
                c[r["cluster"], r["i"]] = int(r["total"]) // r["n"]
        compared.append(sum(r["compared"] for r in found if r["i"] == 0) / sum(r["n"] for r in found if r["i"] == 0))
    out = stage(trees.mapInArrow(_assigned(c), "vec_id long, cluster int, distance long"), "clusters")
    drop_staged(trees)
    return Clustering(c.tolist(), out, compared)


def clusters(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256, a row for each kept vector."""
    model = fit(vectors, **options)
    spark, digests = vectors.sparkSession, [(i, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for i, row in enumerate(model.centroids)]
    own = model.assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # at most k rows
    own = own.join(F.broadcast(own.agg(F.sum("cluster_inertia").alias("inertia")))).join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")
    return model.assigned.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")



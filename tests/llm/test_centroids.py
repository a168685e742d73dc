import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetspark.llm import centroids


def brute_force(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(scale * float(v)) for v in x]) for i, x in rows if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "z", x) for i, x in kept)[:k]
    c = [x for _, x in start]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for j in range(len(c)):
            mine = [x for (_, x), o in zip(kept, own) if o == j]
            if mine:
                c[j] = [sum(v) // len(mine) for v in zip(*mine)]
    out = [(i, near(x)[1], near(x)[0]) for i, x in kept]
    inertia = {j: sum(d for _, o, d in out if o == j) for j in range(len(c))}
    return sorted(((i, o, d, inertia[o], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for i, o, d in out), key=str)


def check(spark, rows, k=4, rounds=5, dims=3, scale=16, partitions=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(partitions)
    got = sorted((tuple(r) for r in centroids.clusters(df, k=k, rounds=rounds, dims=dims, scale=scale).collect()), key=str)
    assert got == brute_force([(i, None if x is None else [None if v is None else float(np.float32(v)) for v in x]) for i, x in rows], k, rounds, dims, scale)
    return got


def test_equals_lloyds_rounds(spark, monkeypatch):
    monkeypatch.setattr(centroids, "LEAF", 4)
    g = np.random.default_rng(3)
    middle = g.normal(size=(4, 3)) * 8
    check(spark, [(i, (middle[i % 4] + g.normal(size=3)).tolist()) for i in range(400)])


def test_ties_copies_and_vectors_that_are_left_out(spark):
    rows = [(i, [float(i % 2), 0.0, 0.0]) for i in range(12)] + [(50, [0.5, 0.0, 0.0])] * 3 + [(i, [0.25, 0.25, -0.25]) for i in range(100, 120)]
    rows += [(60, None), (61, [1.0, 2.0]), (62, [1.0, None, 2.0]), (63, [float("nan"), 0.0, 0.0]), (64, [float("inf"), 0.0, 0.0]), (65, []), (66, [1.0, 2.0, 3.0, 4.0]), (None, [0.5, 0.5, 0.5])]
    assert len(check(spark, rows)) == 36


def test_few_vectors_and_no_vectors(spark):
    assert len(check(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.5, 2.0, 3.0])], k=8)) == 2
    assert check(spark, [], k=8) == []
    assert check(spark, [(1, [1.0])], k=8) == []


def test_other_columns_play_no_part(spark):
    rows = [(i, [float(i), 1.0, 0.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    more = df.withColumns({"x": F.lit("a"), "cluster": F.lit(7), "inertia": F.lit(None), "first": F.lit(1)})
    options = {"k": 2, "rounds": 3, "dims": 3, "scale": 4}
    assert sorted(centroids.clusters(more, **options).collect()) == sorted(centroids.clusters(df, **options).collect())


def test_large_components_are_exact(spark):
    g = np.random.default_rng(5)
    check(spark, [(i, (g.normal(size=3) * 3000).tolist()) for i in range(60)], scale=1024)
    out = centroids.clusters(spark.createDataFrame([(1, [1e30, -1e30, 0.0]), (2, [0.0, 0.0, 0.0])], "vec_id long, embedding array<double>"), k=1, rounds=1, dims=3)
    assert {r.vec_id for r in out.collect()} == {1, 2}


def test_balls_decide_most_vectors(spark):
    g = np.random.default_rng(1)
    middle = np.array([[0, 0], [100, 0], [0, 100]])
    x = np.floor((middle[np.arange(6000) % 3] + g.normal(size=(6000, 2))) * 64).astype(np.int64)
    order, first, last, child, total, radius = centroids.build_tree(x)
    assert sorted(order) == list(range(6000))
    tree = {"x": x[order], "first": first, "last": last, "child": child, "total": total, "radius": radius}
    owner, count, sums, compared = centroids.descend(tree, middle * 64)
    near = centroids.exact_squares(x[order], middle * 64).argmin(axis=1)
    assert (owner == near).all() and compared < 100  # leaves that hold vectors of two groups
    assert (count == np.bincount(near)).all() and all((sums[j] == x[order][near == j].sum(axis=0)).all() for j in range(3))


def test_query_reports_a_share_for_each_round(spark):
    df = spark.createDataFrame([(i, [float(i % 5), float(i // 5)]) for i in range(50)], "vec_id long, embedding array<float>")
    model = centroids.fit(df, k=3, rounds=4, dims=2, scale=8)
    assert len(model.compared) == 4 and all(0 <= s <= 1 for s in model.compared)
    with pytest.raises(Exception):
        centroids.fit(df.drop("vec_id"), k=3)

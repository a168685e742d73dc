import numpy as np
from pyspark.sql import functions as F

from facetspark.operators import projections

NAMES = ["x", "y", "z", "a", "b"]


def cloud(spark, n=30):
    x = np.random.default_rng(3).normal(size=(n, 5)) * [0.002, 0.001, 0.003, 1, 2] + [0, 0, 0, 4, -1]
    near = [(0, v, u) for v in range(n) for u in range(n) if abs(v - u) <= 6]
    values = spark.createDataFrame([(0, v, *map(float, x[v])) for v in range(n)], "mol_id long, v long, x double, y double, z double, a double, b double")
    return x, near, values, spark.createDataFrame(near, "mol_id long, v long, u long")


def test_shape_directions_against_numpy(spark):
    x, near, values, table = cloud(spark)
    scaled = x * [1000, 1000, 1000, 1, 1]
    d = projections.shape_directions(table, values, NAMES[:3], NAMES[3:])
    got = {r["v"]: np.array(r["direction"]) for r in d.collect()}
    along = {r["v"]: r["value"] for r in projections.project(d, values, NAMES, True).collect()}
    for v in range(len(x)):
        own = scaled[[u for _, w, u in near if w == v]]
        mean = own.mean(axis=0)
        axes = np.linalg.svd(own - mean)[2][:4]
        total = np.zeros(4)
        for j in (3, 4):
            part = axes[:, j] * (scaled[v, j] - mean[j])
            for i in range(3):
                base = axes[:, i] / np.linalg.norm(axes[:, i])
                part = part - part @ base * base
            total += part
        want = axes.T @ total / np.linalg.norm(total)
        assert np.allclose(got[v], want, atol=1e-6) and abs(along[v] - (x[v] - mean) @ want) < 1e-6


def test_principal_directions_against_numpy(spark):
    x, near, values, table = cloud(spark)
    d = projections.principal_directions(table, values, ["a", "b"])
    along = {r["v"]: r["value"] for r in projections.project(d, values, ["a", "b"]).collect()}
    for v in range(len(x)):
        own = x[[u for _, w, u in near if w == v], 3:]
        want = np.linalg.svd(own)[2][0]
        want = want * np.sign(want[np.abs(want).argmax()])
        assert abs(along[v] - x[v, 3:] @ want) < 1e-9


def test_defined_results(spark):
    _, _, values, table = cloud(spark)
    some = values.withColumn("a", F.when(F.col("v") != 2, F.lit(0.0))).withColumn("b", F.lit(0.0))
    d = projections.shape_directions(table, some, NAMES[:3], NAMES[3:])
    assert d.where("direction is not null").isEmpty() and projections.project(d, some, NAMES).where("value is not null").isEmpty()
    assert projections.principal_directions(table.limit(0), values, ["a", "b"]).isEmpty()


def test_hessian_of_a_response(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0), (1.0, 1.0), (-1.0, -1.0), (1.0, -1.0), (-1.0, 1.0)]
    local = spark.createDataFrame([(0, 0, u, p, q) for u, (p, q) in enumerate(ring) if u], "mol_id long, v long, u long, p double, q double")
    response = spark.createDataFrame([(0, u, lev, (lev + 1) * (p * p + 2 * q * q)) for lev in (0, 1) for u, (p, q) in enumerate(ring)], "mol_id long, v long, level int, value double")
    out = {r["level"]: r for r in projections.response_hessians(local, response).collect()}
    for lev in (0, 1):
        assert np.allclose([out[lev]["hpp"], out[lev]["hpq"], out[lev]["hqq"]], [2 * (lev + 1), 0, 4 * (lev + 1)]) and abs(out[lev]["ratio"]) > 0

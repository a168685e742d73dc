"""Triples of two objects where their pairs meet, against the relational kernel."""

import numpy as np
import pytest

from facetspark.functions import expressions as X
from facetspark.operators import kernels, pairs


def test_blocks_give_the_relational_kernel(spark):
    g = np.random.default_rng(3)
    rows = [(m, m % 2, p, int(g.integers(2)), *[float(x) for x in g.uniform(0, 12, 3)]) for m in range(14) for p in range(int(g.integers(1, 6)))]
    points = spark.createDataFrame(rows, "mol_id long, customer long, p int, type int, x double, y double, z double")
    found = pairs.pairs(points).join(points.select("mol_id", "customer").distinct(), "mol_id")
    old = {(r["m1"], r["m2"]): r["k"] for r in kernels.triple_kernel(found, lambda a, b: X.triangle_kernel(a, b, 8.0), within=["customer"]).collect()}
    for size in (2, 64):
        new = kernels.triple_kernel_of_blocks(found, lambda a, b: np.maximum(0.0, (8.0 - np.abs(a - b)) / 8.0), ["customer"], size)
        assert {(r["m1"], r["m2"]): r["k"] for r in new.collect()} == pytest.approx(old) and len(old) >= 10
        assert "SortMergeJoin [m1" not in new._jdf.queryExecution().toString()

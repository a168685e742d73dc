import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetspark.functions import expressions as X


def value(spark, column, **row):
    return spark.createDataFrame([row]).select(column.alias("v")).first()[0]


def test_bins(spark):
    got = spark.createDataFrame([(x,) for x in (3.0, 4.0, 5.9, 6.0, 9.0, 100.0, float("nan"), None)], "v double").select(X.bin_of(F.col("v"), [4, 6, 9]).alias("b"), X.bin_of(F.col("v"), F.array(F.lit(4.0), F.lit(6.0), F.lit(9.0))).alias("c"), X.bin_of(F.col("v"), []).alias("e")).collect()
    assert [r["b"] for r in got] == [0, 1, 1, 2, 3, 3, None, None]
    assert [r["c"] for r in got] == [r["b"] for r in got]
    assert [r["e"] for r in got] == [0] * 6 + [None, None]


def test_mixed_radix(spark):
    a, b = X.range_part(F.lit(2), 1, 3), X.range_part(F.lit(1), -1, 1, 2)
    assert value(spark, X.mixed_radix([a, b]), x=1) == 3


def test_curvature_types(spark):
    rows = spark.createDataFrame([(-1.0, 0.5), (-1.0, -0.5), (1.0, -0.5), (0.0, 0.0)], "g double, m double")
    assert [r[0] for r in rows.select(X.curvature_type(F.col("g"), F.col("m"))).collect()] == [2, 3, 1, 1]


def test_rescale_and_back(spark):
    rows = spark.createDataFrame([(float(v),) for v in (0, 4, 10, 16, 20)], "v double")
    scaled = X.rescale(F.col("v"), F.lit(10.0), F.lit(2.0))
    got = rows.select(scaled.alias("s"), X.unscale(scaled, F.lit(10.0), F.lit(2.0)).alias("b")).collect()
    assert [r["s"] for r in got] == [0, 0, 3, 6, 6]
    assert [r["b"] for r in got] == [4, 4, 10, 16, 16]


@pytest.mark.parametrize(("x", "expected"), [(2.5, 3), (-2.5, -3), (0.4, 0), (-0.6, -1)])
def test_rounded(spark, x, expected):
    assert value(spark, X.rounded(F.col("x")), x=x) == expected


def test_kernels(spark):
    k = lambda c: value(spark, c, x=0.0)
    assert math.isclose(k(X.triangle_kernel(F.lit(0.0), F.lit(0.05), 0.2)), 0.75)
    assert k(X.triangle_kernel(F.lit(0.0), F.lit(0.3), 0.2)) == 0
    assert k(X.gaussian_kernel(F.lit(0.0), F.lit(4.1), 1.0)) == 0
    assert math.isclose(k(X.gaussian_kernel(F.lit(0.0), F.lit(1.0), 1.0)), math.exp(-0.5))
    assert k(X.product_kernel([F.lit(0.0), F.raise_error(F.lit("no")).cast("double")])) == 0
    assert math.isclose(k(X.f_measure(F.lit(1.0), F.lit(0.5))), 1 / (1.5 + 1e-6) + 0.35)


def test_names_are_checked():
    assert X.detector("DoG") == "dog"
    for f in (X.detector, X.combination):
        with pytest.raises(ValueError):
            f("nonsense")


@settings(max_examples=15, deadline=None)
@given(st.tuples(*[st.floats(-1, 1)] * 3))
def test_tangent_basis(spark, n):
    size = math.sqrt(sum(c * c for c in n))
    if size < 1e-3:
        return
    n = [c / size for c in n]
    u, w = X.tangent_basis([F.lit(c) for c in n])
    u, w = spark.range(1).select(F.array(*u), F.array(*w)).first()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, b, e in ((u, u, 1), (w, w, 1), (u, w, 0), (u, n, 0), (w, n, 0)):
        assert abs(dot(a, b) - e) < 1e-6

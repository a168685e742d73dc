"""What belongs to one object stays on one partition: joins by object and vertex need no exchange of their own."""

import re

import pytest

from facetspark.operators import geometry, graph, stats
from facetspark.plans import queries

KEY = "spark.sql.requireAllClusterKeysForCoPartition"


@pytest.mark.parametrize("name", ["scale_space", "scale_sign", "scale_extrema", "blob_points", "principal_response", "voronoi_segments"])
def test_neighbours_are_not_shuffled(spark, name):
    """Every neighbour was a row of a shuffle, by (object, cell), then (object, neighbour)."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange hashpartitioning(user_id#" in plan and not re.findall(r"Exchange hashpartitioning\(\w+#\w+, \w+#.*", plan)
    assert spark.conf.get(KEY) == "true"


def test_filling_layer_by_layer_keeps_what_no_value_reaches(spark):
    values = spark.createDataFrame([(0, v, x) for v, x in enumerate([1.0, None, None, None, 5.0])] + [(1, 0, None), (1, 1, None), (2, 0, 3.0)], "mol_id long, v long, value double")
    edges = spark.createDataFrame([(0, a, b) for a in range(5) for b in (a - 1, a + 1) if 0 <= b < 5] + [(1, 0, 1), (1, 1, 0)], "mol_id long, src long, dst long")
    got = {(r["mol_id"], r["v"]): (r["value"], r["layer"]) for r in graph.fill_from_borders(values, edges).collect()}
    assert got == {(0, 0): (1.0, 0), (0, 1): (1.0, 1), (0, 2): (3.0, 2), (0, 3): (5.0, 1), (0, 4): (5.0, 0), (1, 0): (None, 0), (1, 1): (None, 0), (2, 0): (3.0, 0)}


def test_deviations_rank_no_group_in_one_task(spark):
    """A window over the groups held all of a group's rows."""
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), (None, 2.0), (None, 4.0), ("b", None)], "k string, x double")
    out = stats.mean_absolute_deviation(df, "x", "k")
    assert {tuple(r) for r in out.collect()} == {("a", 2.0, 1.0), (None, 3.0, 1.0), ("b", None, None)}
    assert [tuple(r) for r in stats.mean_absolute_deviation(df, "x").collect()] == [(2.5, 1.0)]
    assert "Window" not in out._jdf.queryExecution().toString()


def test_whole_objects_as_neighbourhoods_form_no_pairs(spark):
    """All pairs of an object's points were joined, and joined again with their values."""
    rows = [(m, v, float(m * v % 5), float(v * v % 7), None if (m, v) == (2, 1) else 0.5 * v) for m in range(4) for v in range(m + 1)]
    df = spark.createDataFrame(rows, "mol_id long, v long, x double, y double, z double")
    near = df.select("mol_id", "v").join(df.select("mol_id", df.v.alias("u")), "mol_id")
    old = {(r.mol_id, r.v): (r.projection, *r.direction) for r in geometry.local_pca(near, df.na.fill(0.5), ["x", "y", "z"]).collect()}
    out = geometry.object_pca(df.na.fill(0.5), ["x", "y", "z"])
    assert {(r.mol_id, r.v): (r.projection, *r.direction) for r in out.collect()} == {k: pytest.approx(v, abs=1e-6) for k, v in old.items()}
    assert "Join" not in queries.queries()["local_pca"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["pair_kernel", "pair_kernel_with_properties"])
def test_pairs_of_orders_are_not_shuffled(spark, name):
    """Points went by customer for nothing but their pairs' customer, then pairs went by customer and types, twice."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange hashpartitioning(customer#" in plan
    assert not re.findall(r"Exchange hashpartitioning\(\w+#\w+, \w+#.*", plan)

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from facetspark.operators import filters, learn
from facetspark.plans import queries as own
from facetspark.sources import text
from facetspark.streaming import histograms

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_oracle_has_its_query():
    assert set(own.oracle_sql()) <= set(own.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["pair_histogram", "triple_histogram", "trim_search", "conflict_removal", "class_balance", "scale_extrema", "components", "wave_fill", "greedy_points", "pair_kernel", "raster_hessian", "segments_by_value", "gaussian_grams"])
def test_queries_equal_their_oracles(spark, duck, name):
    df = own.queries()[name](spark, SF)
    names = sorted(df.columns)
    expected = duck.sql(own.oracle_sql()[name])
    at = [expected.columns.index(c) for c in names]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=key) == sorted((tuple(r[i] for i in at) for r in expected.fetchall()), key=key)


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_streaming_counts(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, float(i), f"2024-01-01 00:00:{i:02d}") for i in range(20)], "mol_id int, x double, t string").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = histograms.typed_counts(stream, "x", [5.0, 10.0]).writeStream.outputMode("complete").format("memory").queryName("typed").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    batch = {tuple(r) for r in histograms.typed_counts(rows, "x", [5.0, 10.0]).collect()}
    assert {tuple(r) for r in spark.table("typed").collect()} == batch and sum(c for *_, c in batch) == 20
    assert sum(r["cnt"] for r in histograms.windowed_counts(rows, "t", "10 seconds", "5 seconds", "x", [10.0]).collect()) == 20


def test_coordinates_stay_on_the_sphere(spark):
    vertices = spark.createDataFrame([(0, i, *p) for i, p in enumerate(((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)))], "mol_id int, v int, x double, y double, z double")
    near = spark.createDataFrame([(0, v, u, 0.0 if v == u else 1.4) for v in range(3) for u in range(3)], "mol_id int, v int, u int, d double")
    for r in filters.spherical_scale_space(near, vertices, 1.0, 2).collect():
        assert abs(r["x"] ** 2 + r["y"] ** 2 + r["z"] ** 2 - 1) < 1e-9


def test_nested_and_kernel_validation(spark):
    rows = spark.createDataFrame([(i, [float(i % 2), float(i % 7)], 1 if i % 2 else -1, i // 2 % 3) for i in range(42)], "id long, x array<double>, y int, fold int")
    assert {r["balanced_accuracy"] for r in learn.nested_cross_validate(rows, [0.1, 1.0], 3, 2).collect()} == {1.0}
    gram = spark.createDataFrame([(i, j, 4.0 if i % 2 == j % 2 else -4.0) for i in range(12) for j in range(12)], "m1 long, m2 long, k double")
    labels = spark.createDataFrame([(i, 1 if i % 2 else -1, i // 2 % 3) for i in range(12)], "mol_id long, y int, fold int")
    assert [(r["number"], r["loss"]) for r in learn.kernel_cross_validate(gram, labels, [1.0]).collect()] == [(0, 0)]


def test_libsvm(spark, tmp_path):
    md = spark.createDataFrame([(0, 2, 3), (0, 0, 1), (1, 1, 5), (1, 0, 0)], "mol_id int, type int, cnt int")
    labels = spark.createDataFrame([(0, 1), (1, -1)], "mol_id int, y int")
    text.write_libsvm(md, labels, f"{tmp_path}/svm")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/svm").collect()) == ["-1 2:5", "1 1:1 3:3"]

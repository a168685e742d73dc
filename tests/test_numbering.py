from pyspark.sql import functions as F

from facetspark.operators.numbering import numbered


def test_numbers_follow_the_order_and_have_no_gaps(spark):
    rows = [(i * 7919 % 1000, f"k{i % 13}") for i in range(1000)]
    df = spark.createDataFrame(rows, "a long, b string").repartition(5)
    got = {(r.a, r.b): r.number for r in numbered(df, ["b", F.desc("a")], start=1).collect()}
    want = {row: i + 1 for i, row in enumerate(sorted(set(rows), key=lambda r: (r[1], -r[0])))}
    assert got == want


def test_ties_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, 1)] * 3 + [(5, 2)] * 300 + [(4, 3)], "a long, _part int")
    out = numbered(df, ["a"], "n", partitions=6)
    assert out.columns == ["a", "_part", "n"]
    got = sorted((r.n, r.a) for r in out.collect())
    assert [n for n, _ in got] == list(range(304))
    assert [a for _, a in got] == [None] * 3 + [4] + [5] * 300


def test_one_value_is_dealt_over_several_partitions(spark):
    df = spark.range(8000).select(F.lit(1).alias("a"))
    plan = df.withColumn("t", F.rand(7)).repartitionByRange(4, "a", "t").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(plan) == 4
    assert numbered(df, ["a"], partitions=4).agg(F.min("number"), F.max("number"), F.count_distinct("number")).first()[:] == (0, 7999, 8000)


def test_empty(spark):
    assert numbered(spark.createDataFrame([], "a long"), ["a"]).collect() == []

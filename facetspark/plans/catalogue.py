"""The registry of queries: each applies operators to the driver's tables and carries its DuckDB equivalent.

Mapping: an order is an object with its line items as points; a user is an object whose events, in time order, are a
path; embeddings are elements with classes; documents are objects whose words are descriptors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetspark.operators.pairs import number_points

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The line items' columns in a total order.
ITEM = "l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its oracle unless SQL can't express it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def by_object(spark: SparkSession) -> SparkSession:
    """A session like spark, in which tables dealt by object stay so for joins and groups by object and vertex.

    Objects are many and small, so that their points, neighbours and levels need one exchange; the given session keeps its
    setting, as other queries have keys that are skewed.
    """
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return own


def items(spark: SparkSession, d: str) -> DataFrame:
    """Points of orders: mol_id, p, v (= p), x, y, z, flag, level."""
    spark = by_object(spark)
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    rows = number_points(table(spark, d, "lineitem"), "l_orderkey", [c.strip() for c in ITEM.split(",")])
    return rows.select(
        F.col("l_orderkey").alias("mol_id"), "p", F.col("p").alias("v"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"),
        flag.alias("flag"), F.least(F.col("l_linenumber") - 1, F.lit(4)).alias("level"), F.col("l_partkey").alias("part"),
    )


PTS = f"""pts AS (SELECT l_orderkey AS mol_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ITEM}) - 1 AS p,
 l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag,
 LEAST(l_linenumber - 1, 4) AS level, l_partkey AS part FROM lineitem)"""
DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
QT = "qt AS (SELECT v[CAST(floor(i * n / 4.0 + 0.5) AS BIGINT) + 1] AS t FROM (SELECT list(l_quantity ORDER BY l_quantity) AS v, count(*) AS n FROM lineitem), generate_series(1, 3) AS g(i))"
TYPED = "typed AS (SELECT pts.*, flag * 4 + (SELECT count(*) FROM qt WHERE pts.x >= qt.t) AS type FROM pts)"
PAIRS = f"prs AS (SELECT a.mol_id, a.p AS p1, b.p AS p2, a.type AS t1, b.type AS t2, a.level AS level1, b.level AS level2, {DIST} AS dist FROM typed a JOIN typed b ON a.mol_id = b.mol_id AND a.p < b.p)"


def levels_sql(name: str, of: str, k: int, alpha: float, where: str = "") -> str:
    """A CTE with the level thresholds of a column `dist` of a relation."""
    return f"""{name} AS (SELECT lo + (hi - lo) * i / {float(k - 1)} AS t FROM (SELECT v[CAST(floor((n - 1) * {alpha} + 0.5) AS BIGINT) + 1] AS lo, v[CAST(floor((n - 1) * (1 - {alpha}) + 0.5) AS BIGINT) + 1] AS hi
 FROM (SELECT list(dist ORDER BY dist) AS v, count(*) AS n FROM {of} {where})), generate_series(0, {k - 1}) AS g(i))"""


def events_path(spark: SparkSession, d: str) -> DataFrame:
    """Paths of users: mol_id, v, value, x (= v)."""
    spark = by_object(spark)
    rows = number_points(table(spark, d, "events"), "user_id", ["ts", "event_id"])
    return rows.select(F.col("user_id").alias("mol_id"), F.col("p").alias("v"), "value", F.col("p").cast("double").alias("x"), "event_type", "event_id")


EV = "ev AS (SELECT user_id AS mol_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS v, value, event_type, event_id FROM events)"


def path_edges(path: DataFrame) -> DataFrame:
    """Edges between events next to each other, both ways."""
    last = path.groupBy("mol_id").agg(F.max("v").alias("_last"))
    both = path.join(last, "mol_id").select("mol_id", F.col("v").alias("src"), F.explode(F.array(F.col("v") - 1, F.col("v") + 1)).alias("dst"), "_last")
    return both.where((F.col("dst") >= 0) & (F.col("dst") <= F.col("_last"))).drop("_last")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").alias("key"), F.col("vec_id").alias("v"), F.col("embedding").alias("vec"))


def fx(x: str, digits: int = 6) -> str:
    """The SQL of expressions.fixed."""
    return f"(floor(({x}) * {float(10**digits)} + 0.5) / {float(10**digits)})"

"""Queries over segments, detection by levels, selection of columns, and the descriptor pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetspark.functions import expressions as X
from facetspark.operators import chains, detect, features, filters, frames, geometry, graph, learn, projections, stats
from facetspark.plans import pipeline
from facetspark.plans.catalogue import EV, events_path, fx, items, path_edges, query, table
from facetspark.plans.descriptor_queries import PRED, cells, predicted
from facetspark.plans.surface_queries import blur_sql, near_sql, path_near
from facetspark.sources.config import Options

RUNS = f"{EV}, ch AS (SELECT mol_id, v, event_type, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS c FROM ev WINDOW w AS (PARTITION BY mol_id ORDER BY v)), rn AS (SELECT mol_id, v, event_type, sum(c) OVER (PARTITION BY mol_id ORDER BY v) AS run FROM ch)"


def event_segments(spark: SparkSession, d: str, min_size: int = 1) -> tuple[DataFrame, DataFrame]:
    path = events_path(spark, d)
    edges = path_edges(path)
    return graph.segments_by_value(path.select("mol_id", "v", F.col("event_type").alias("value")), edges, min_size), edges


@query(f"""WITH {RUNS}, k AS (SELECT mol_id, run, row_number() OVER (PARTITION BY mol_id ORDER BY run) AS seg FROM (SELECT mol_id, run FROM rn GROUP BY ALL HAVING count(*) >= 2))
SELECT mol_id, CAST(v AS INTEGER) AS v, CAST(coalesce(seg, 0) AS INTEGER) AS seg FROM rn LEFT JOIN k USING (mol_id, run)""")
def segments_by_value(spark: SparkSession, d: str) -> DataFrame:
    return event_segments(spark, d, 2)[0]


@query(f"""WITH {RUNS}, m AS (SELECT mol_id, max(run) AS n FROM rn GROUP BY 1) SELECT mol_id, CAST(i AS INTEGER) AS s1, CAST(i + 1 AS INTEGER) AS s2 FROM m, generate_series(1, 1000) AS g(i) WHERE i < n""")
def segment_edges(spark: SparkSession, d: str) -> DataFrame:
    segments, edges = event_segments(spark, d)
    return graph.segment_edges(edges, segments)


@query(f"""WITH RECURSIVE {EV}, sd AS (SELECT mol_id, v AS seed, value AS level FROM ev WHERE v % 10 = 0), r AS (SELECT mol_id, seed, level, seed AS v FROM sd UNION SELECT r.mol_id, r.seed, r.level, e.v FROM r JOIN ev e ON e.mol_id = r.mol_id AND abs(e.v - r.v) = 1 AND abs(e.value - r.level) <= 40)
SELECT mol_id, CAST(seed AS INTEGER) AS seed, CAST(v AS INTEGER) AS v FROM r""")
def segments_from_seeds(spark: SparkSession, d: str) -> DataFrame:
    path = events_path(spark, d)
    seeds = path.where("v % 10 = 0").select("mol_id", F.col("v").alias("seed"))
    return graph.segments_from_seeds(path.select("mol_id", "v", "value"), path_edges(path), seeds, 40.0)


@query(f"""WITH {EV}, n AS (SELECT mol_id, v, count(*) OVER (PARTITION BY mol_id) AS n FROM ev), k AS (SELECT mol_id, v, n, GREATEST(1, CAST(ceil(n / 12.0) AS BIGINT)) AS k FROM n), c AS (SELECT mol_id, v AS u FROM k WHERE v % (n // k) = 0 AND v / CAST(n // k AS DOUBLE) < k)
SELECT k.mol_id, CAST(k.v AS INTEGER) AS v, CAST(arg_min(u, abs(k.v - u) * 100000 + u) AS INTEGER) AS centre FROM k JOIN c ON c.mol_id = k.mol_id GROUP BY ALL""")
def voronoi_segments(spark: SparkSession, d: str) -> DataFrame:
    path = events_path(spark, d)
    return graph.path_segments(path.select("mol_id", "v", F.lit(0).alias("component")), 12).select("mol_id", "v", "centre")


@query(f"""WITH {EV}, t AS (SELECT a.mol_id, a.v AS t, [a.event_id % 3 + 1, b.event_id % 3 + 1, c.event_id % 3 + 1] AS k FROM ev a JOIN ev b ON a.mol_id = b.mol_id AND b.v = a.v + 1 JOIN ev c ON a.mol_id = c.mol_id AND c.v = a.v + 2)
SELECT mol_id, CAST(t AS INTEGER) AS t, CAST(CASE WHEN k[1] = k[2] OR k[1] = k[3] THEN k[1] WHEN k[2] = k[3] THEN k[2] ELSE 3 END AS INTEGER) AS type FROM t""")
def triangle_types(spark: SparkSession, d: str) -> DataFrame:
    path = events_path(spark, d)
    last = path.groupBy("mol_id").agg(F.max("v").alias("n")).where("n >= 2")
    tri = last.select("mol_id", F.explode(F.sequence(F.lit(0), F.col("n") - 2)).alias("t")).select("mol_id", "t", F.col("t").alias("a"), (F.col("t") + 1).alias("b"), (F.col("t") + 2).alias("c"))
    types = path.select("mol_id", "v", (F.pmod("event_id", F.lit(3)) + 1).cast("int").alias("type"))
    return graph.triangle_types(tri, types)


@query(f"""WITH {near_sql(2)}, m AS (SELECT mol_id, v, value, row_number() OVER (PARTITION BY mol_id, v ORDER BY value, u) AS i, count(*) OVER (PARTITION BY mol_id, v) AS n FROM nr WHERE d <= 2) SELECT mol_id, CAST(v AS INTEGER) AS v, value AS median FROM m WHERE i = n // 2 + 1""")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    path = events_path(spark, d)
    return filters.weighted_median(path_near(path, 2), path, 2.0, upper=True)


@query(f"""WITH {EV} SELECT a.mol_id, CAST(a.v AS INTEGER) AS v, {fx('avg(a.value - b.value)', 5)} AS laplacian FROM ev a JOIN ev b ON a.mol_id = b.mol_id AND abs(a.v - b.v) = 1 GROUP BY ALL""")
def simple_laplacian(spark: SparkSession, d: str) -> DataFrame:
    path = events_path(spark, d)
    return filters.simple_laplacian(path.select("mol_id", "v", "value"), path_edges(path)).withColumn("laplacian", X.fixed(F.col("laplacian"), 5))


def _steps_sql(n: int) -> str:
    parts = [f"b0 AS (SELECT mol_id, v, {blur_sql(0.8, 'value')} FROM nr GROUP BY ALL)"]
    for k in range(1, n):
        parts.append(f"b{k} AS (SELECT mol_id, v, {blur_sql(0.8, 'value')} FROM (SELECT a.mol_id, a.v, CAST(abs(a.v - b.v) AS DOUBLE) AS d, b.value FROM b{k - 1} a JOIN b{k - 1} b ON a.mol_id = b.mol_id AND abs(a.v - b.v) <= 3) GROUP BY ALL)")
    return f"WITH {near_sql(3)}, {', '.join(parts)} " + " UNION ALL ".join(f"SELECT mol_id, CAST(v AS INTEGER) AS v, {k} AS level, {fx('value', 5)} AS value FROM b{k}" for k in range(n))


@query(_steps_sql(3))
def recursive_scale_space(spark: SparkSession, d: str) -> DataFrame:
    path = events_path(spark, d)
    return filters.recursive_scale_space(path_near(path, 3), path.select("mol_id", "v", "value"), 0.8, 3).withColumn("value", X.fixed(F.col("value"), 5))


@query(f"""WITH s AS (SELECT list(value ORDER BY value) AS v, count(*) AS n FROM events), q AS (SELECT v[1] AS lo, v[LEAST(CAST(floor(0.3 * n + 0.5) AS BIGINT), n - 1) + 1] AS a, v[LEAST(CAST(floor(0.8 * n + 0.5) AS BIGINT), n - 1) + 1] AS b FROM s) SELECT {fx('LEAST(a, (b - lo) * 0.01 + lo)')} AS cut FROM q""")
def gradient_cut(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(stats.gradient_cut(table(spark, d, "events"), "value"),)], "cut double").withColumn("cut", X.fixed(F.col("cut")))


@query(f"""WITH c AS (SELECT CASE WHEN label < 5 THEN 1 ELSE -1 END AS y, generate_subscripts(embedding, 1) - 1 AS type, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings), g AS (SELECT type, y, count(*) AS n, avg(value) AS m, var_pop(value) AS s FROM c GROUP BY ALL), t AS (SELECT type, avg(value) AS m, count(*) AS n FROM c GROUP BY type)
SELECT CAST(type AS INTEGER) AS type, {fx('sum(g.n * (g.m - t.m) * (g.m - t.m)) / (count(*) - 1) / (sum(g.n * g.s) / (any_value(t.n) - count(*)))', 4)} AS f FROM g JOIN t USING (type) GROUP BY type ORDER BY f DESC, type LIMIT 10""")
def select_k_best(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("mol_id"), F.when(F.col("label") < 5, 1).otherwise(-1).alias("y"))
    scores = features.f_scores(cells(spark, d), labels)
    return features.best_columns(scores.select("type", X.fixed(F.col("f"), 4).alias("f")), 10)


@query(f"""WITH {PRED} SELECT fold, {fx('sum(CASE WHEN abs(s) < 0.2 THEN 0.5 WHEN sign(s) = y THEN 0 ELSE 1 END)')} AS loss FROM (SELECT fold, 2 * y - 1 AS y, predicted - 0.3 - 0.1 * fold AS s FROM p) GROUP BY fold""")
def fuzzy_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = predicted(spark, d).select("fold", (2 * F.col("y") - 1).alias("y"), (F.col("predicted") - F.lit(0.3).cast("decimal(2,1)") - F.lit(0.1).cast("decimal(2,1)") * F.col("fold")).cast("double").alias("s"))
    return rows.groupBy("fold").agg(X.fixed(learn.fuzzy_loss(F.col("y"), F.col("s"), 0.2)).alias("loss"))


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS mol_id, l_partkey % 7 AS i, l_suppkey % 7 AS j FROM lineitem), b AS MATERIALIZED (SELECT DISTINCT mol_id, LEAST(i, j) AS i, GREATEST(i, j) AS j FROM i WHERE i <> j), w AS MATERIALIZED (SELECT mol_id, i, j FROM b UNION ALL SELECT mol_id, j, i FROM b)
SELECT a.mol_id, a.i AS a, a.j AS b, c.j AS c FROM w a JOIN w c ON a.mol_id = c.mol_id AND a.j = c.i AND a.i < c.j""")
def simple_paths(spark: SparkSession, d: str) -> DataFrame:
    found = chains.paths(small_graphs(spark, d), 3)
    return found.select("mol_id", *[F.get("path", F.lit(k)).alias(c) for k, c in enumerate("abc")])


def small_graphs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as graphs over seven nodes: bonds(mol_id, i < j)."""
    i, j = F.col("l_partkey") % 7, F.col("l_suppkey") % 7
    return table(spark, d, "lineitem").where(i != j).select(F.col("l_orderkey").alias("mol_id"), F.least(i, j).alias("i"), F.greatest(i, j).alias("j")).distinct()


@query()
def merged_levels(spark: SparkSession, d: str) -> DataFrame:
    path = events_path(spark, d).withColumn("y", F.lit(0.0)).withColumn("z", F.lit(0.0))
    points = path.where("value > 150").select("mol_id", (F.col("event_id") % 4).cast("int").alias("level"), "v", "x", "y", "z")
    return detect.merge_levels(points, 2.0)


@query()
def blob_points(spark: SparkSession, d: str) -> DataFrame:
    path = events_path(spark, d)
    return detect.finder(True, sigmas=[0.8, 1.2, 1.8, 2.7, 4.0], kind="log").find(path, path_edges(path), path_near(path, 12))


@query()
def local_pca(spark: SparkSession, d: str) -> DataFrame:
    p = items(spark, d)
    return geometry.object_pca(p.select("mol_id", "v", "x", "y", "z"), ["x", "y", "z"]).select("mol_id", "v", F.round("projection", 6).alias("projection"))


@query()
def descriptor_pipeline(spark: SparkSession, d: str) -> DataFrame:
    path = events_path(spark, d)
    return pipeline.run(path, path_edges(path), path_near(path, 12), [0.8, 1.2, 1.8, 2.7, 4.0], Options(distance_bins=4))


#: Paths of events as strips of a surface: the normal leans with the event's value and number.
STRIP = """s AS (SELECT mol_id, v, CAST(v AS DOUBLE) AS x, y, nx / l AS nx, ny / l AS ny, 1 / l AS nz FROM (SELECT mol_id, v, y, nx, ny, sqrt(nx * nx + ny * ny + 1) AS l
 FROM (SELECT mol_id, v, CAST(value AS DOUBLE) / 100 AS y, CAST(value AS DOUBLE) / 1000 AS nx, CAST(event_id % 7 AS DOUBLE) / 10 - 0.3 AS ny FROM ev)))"""


@query(f"""WITH RECURSIVE {EV}, {STRIP},
k AS (SELECT a.mol_id, a.v AS src, b.v AS dst, a.nx * b.nx + a.ny * b.ny + a.nz * b.nz AS c, b.x - a.x AS ex, b.y - a.y AS ey,
 a.ny * b.nz - a.nz * b.ny AS kx, a.nz * b.nx - a.nx * b.nz AS ky, a.nx * b.ny - a.ny * b.nx AS kz
 FROM s a JOIN s b ON a.mol_id = b.mol_id AND b.v - a.v BETWEEN 1 AND 12 AND (b.v + 11) // 12 = (a.v + 11) // 12 + 1),
t AS (SELECT *, coalesce((kx * ex + ky * ey) / nullif(sqrt(kx * kx + ky * ky + kz * kz) * sqrt(ex * ex + ey * ey), 0), 0) AS along FROM k),
w AS (SELECT *, pow(least(1.0, greatest(0.0, 1 - along)), 10) AS weight FROM t),
f AS (SELECT mol_id, v, 0 AS layer, (1 - nx * nx) / l AS ux, -nx * ny / l AS uy, -nx * nz / l AS uz FROM (SELECT *, sqrt(1 - nx * nx) AS l FROM s WHERE v = 0)
 UNION ALL SELECT mol_id, v, layer, ux / nullif(l, 0), uy / nullif(l, 0), uz / nullif(l, 0) FROM (SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS l FROM (
 SELECT w.mol_id, w.dst AS v, f.layer + 1 AS layer, sum(weight * (c * ux + ky * uz - kz * uy + kx * (kx * ux + ky * uy + kz * uz) / (1 + c))) AS ux,
 sum(weight * (c * uy + kz * ux - kx * uz + ky * (kx * ux + ky * uy + kz * uz) / (1 + c))) AS uy, sum(weight * (c * uz + kx * uy - ky * ux + kz * (kx * ux + ky * uy + kz * uz) / (1 + c))) AS uz
 FROM f JOIN w ON f.mol_id = w.mol_id AND f.v = w.src GROUP BY w.mol_id, w.dst, f.layer)))
SELECT mol_id, CAST(v AS INTEGER) AS v, CAST(layer AS INTEGER) AS layer, {fx("ux")} AS ux, {fx("uy")} AS uy, {fx("uz")} AS uz FROM f""")
def carried_frames(spark: SparkSession, d: str) -> DataFrame:
    path = events_path(spark, d)
    lean = [(F.col("value").cast("double") / 1000).alias("nx"), (F.col("event_id") % 7 / 10 - 0.3).alias("ny"), F.lit(1.0).alias("nz")]
    strip = path.select("mol_id", "v", "x", (F.col("value").cast("double") / 100).alias("y"), F.lit(0.0).alias("z"), *lean)
    edges = path_near(path, 12).where("v <> u").select("mol_id", F.col("v").alias("src"), F.col("u").alias("dst"))
    seeds = path.where("v = 0").select("mol_id", "v", F.lit(1.0).alias("ux"), F.lit(0.0).alias("uy"), F.lit(0.0).alias("uz"))
    carried = frames.propagate(strip, edges, seeds)
    return carried.select("mol_id", "v", "layer", *[X.fixed(F.col(c), 6).alias(c) for c in frames.AXIS])


@query(f"""WITH {EV}, p AS (SELECT mol_id, v, CAST(value AS DOUBLE) / 100 AS a, CAST(event_id % 7 AS DOUBLE) + 0.5 AS b FROM ev),
m AS (SELECT p.mol_id, p.v, p.a, p.b, avg(q.a * q.a) AS aa, avg(q.a * q.b) AS ab, avg(q.b * q.b) AS bb FROM p JOIN p q ON p.mol_id = q.mol_id AND abs(p.v - q.v) <= 12 GROUP BY ALL),
t AS (SELECT *, cos(atan2(2 * ab, aa - bb) / 2) AS c, sin(atan2(2 * ab, aa - bb) / 2) AS s FROM m)
SELECT mol_id, CAST(v AS INTEGER) AS v, {fx("(a * c + b * s) * CASE WHEN (CASE WHEN abs(c) >= abs(s) THEN c ELSE s END) < 0 THEN -1 ELSE 1 END")} AS value FROM t""")
def principal_response(spark: SparkSession, d: str) -> DataFrame:
    path = events_path(spark, d)
    values = path.select("mol_id", F.col("v").cast("int").alias("v"), (F.col("value").cast("double") / 100).alias("a"), (F.col("event_id") % 7 + 0.5).alias("b"))
    along = projections.project(projections.principal_directions(path_near(path, 12), values, ["a", "b"]), values, ["a", "b"])
    return along.select("mol_id", F.col("v").cast("int").alias("v"), X.fixed(F.col("value"), 6).alias("value"))

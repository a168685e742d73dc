import colorsys

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from facetspark.functions import expressions as X
from facetspark.operators import geometry, graph, neighbours, segments
from facetspark.plans import queries
from facetspark.sources import text


def line(spark, types):
    n = len(types)
    kinds = spark.createDataFrame([(0, v, t) for v, t in enumerate(types)], "mol_id int, v int, type int")
    edges = spark.createDataFrame([(0, v, v + s) for v in range(n) for s in (-1, 1) if 0 <= v + s < n], "mol_id int, src int, dst int")
    far = spark.createDataFrame([(0, v, u, float(abs(v - u))) for v in range(n) for u in range(n)], "mol_id int, v int, u int, d double")
    return kinds, edges, far


def test_segments_of_a_line(spark):
    kinds, edges, far = line(spark, [1] * 6 + [3] * 3 + [2] * 2 + [1] * 12)
    got = {r["v"]: r["seg"] for r in segments.segment_surface(kinds, edges, far, 5, 8).collect()}
    assert set(got) == set(range(23)) and len({got[v] for v in range(6)}) == 1
    assert len({got[v] for v in range(11, 23)}) == 2 and sorted(set(got.values())) == list(range(1, len(set(got.values())) + 1))
    assert {got[v] for v in range(6, 11)}.isdisjoint({got[v] for v in range(6)})
    table = spark.createDataFrame([(0, v, s) for v, s in got.items()], "mol_id int, v int, seg int")
    centres, links = segments.segment_graph(table, edges, far)
    assert centres.count() == len(set(got.values())) and links.count() >= len(set(got.values())) - 1


def test_long_paths_lose_no_vertex(spark, tmp_path):
    """Vertices more than 200 steps from the last seed were left out; 2,999 events leave 259 after it."""
    rows = [(u, t, "view") for u, n in ((7, 2999), (8, 13), (9, 1), (None, 3)) for t in range(n)]
    events = pd.DataFrame([(i, t, u, kind, float(i % 11), "{}") for i, (u, t, kind) in enumerate(rows)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    events["ts"], events["user_id"] = pd.to_datetime(events["ts"], unit="s"), events["user_id"].astype("Int64")
    events.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    got = queries.queries()["voronoi_segments"](spark, str(tmp_path))
    want = duckdb.sql(queries.oracle_sql()["voronoi_segments"].replace("FROM events", f"FROM '{tmp_path}/events.parquet'")).fetchall()
    assert sorted(map(tuple, got.select("mol_id", "v", "centre").collect())) == sorted(want) and len(want) == 2999 + 13 + 1


def test_path_segments_equal_those_by_distances(spark):
    parts = spark.createDataFrame([(m, v, c) for m, c, n in ((0, 0, 40), (0, 1, 7), (1, 0, 1), (2, 5, 26)) for v in range(100 * c, 100 * c + n)], "mol_id int, v int, component int")
    other = parts.select("mol_id", F.col("v").alias("u"))
    apart = parts.join(other, "mol_id").select("mol_id", "v", "u", F.abs(F.col("v") - F.col("u")).cast("double").alias("d"))
    for size in (3, 5, 12):
        want = graph.voronoi_segments(apart, parts, size).select("mol_id", "component", "v", "centre").collect()
        assert sorted(map(tuple, graph.path_segments(parts, size).collect())) == sorted(map(tuple, want)) and len(want) == 74


def test_hessian_of_a_quadratic(spark):
    ring = [(1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]
    f = lambda p, q: 2 * p * p / 2 + 3 * p * q + 5 * q * q / 2
    local = spark.createDataFrame([(0, 0, i + 1, p, q) for i, (p, q) in enumerate(ring)], "mol_id int, v int, u int, p double, q double")
    scales = spark.createDataFrame([(0, 0, 0, "a", 0.0)] + [(0, i + 1, 0, "a", f(p, q)) for i, (p, q) in enumerate(ring)], "mol_id int, v int, level int, prop string, value double")
    r = geometry.hessian_responses(local, scales, [1.0]).where("v = 0").first()
    assert np.isfinite(r["scalar"]) and r["manifold_trace"] > 0


def test_vector_extrema(spark):
    vec = spark.createDataFrame([(0, v, lev, [5.0 if (v, lev) == (0, 1) else float(v), 0.0]) for v in range(3) for lev in range(3)], "mol_id int, v int, level int, vec array<double>")
    onto = vec.select("mol_id", "v", "level", F.array(F.lit(0.0), F.lit(0.0)).alias("mean"), F.array(F.lit(1.0), F.lit(0.0)).alias("direction"))
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (0, 0, 2), (0, 2, 0)], "mol_id int, src int, dst int")
    got = neighbours.vector_extrema(vec, onto, edges).where("kind = 1").collect()
    assert [(r["v"], r["level"]) for r in got] == [(0, 1)]


def test_colours_and_codes(spark):
    for h, s, v in ((0, 1, 1), (90, 0.5, 0.8), (200, 0.3, 0.4), (359, 1, 0.2)):
        got = spark.range(1).select(*X.hsv_to_rgb(F.lit(float(h)), F.lit(float(s)), F.lit(float(v)))).first()
        assert np.allclose(tuple(got), colorsys.hsv_to_rgb(h / 360, s, v))
    assert tuple(spark.range(1).select(*X.decode_type(F.lit(5)), X.binary_label(F.lit(-1))).first()) == (2, 2, 0)


def test_stage_tables(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert text.stage_table(spark, str(tmp_path), "prs", make).count() == 3
    assert text.stage_table(spark, str(tmp_path), "prs", make, reload=True).count() == 3 and made == [1]
    text.write_predictions(spark.createDataFrame([(1, 2)], "mol_id int, activity int"), f"{tmp_path}/p", "a")
    bonds = spark.createDataFrame([(0, 1, 2, 1)], "mol_id int, i int, j int, order int")
    assert text.connections(bonds).count() == 2

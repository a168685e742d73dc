import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetspark.operators import chains, detect, features, fields, filters, geometry, graph, kernels, learn, mesh, neighbours, pairs, stats

OCTAHEDRON = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def numbers(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "v double")


@pytest.fixture(scope="module")
def octahedron(spark):
    vertices = spark.createDataFrame([(0, i, *map(float, p), *map(float, p)) for i, p in enumerate(OCTAHEDRON)], "mol_id int, v int, x double, y double, z double, nx double, ny double, nz double")
    faces = [(x, y, z) for x in (0, 1) for y in (2, 3) for z in (4, 5)]
    triangles = spark.createDataFrame([(0, t, *f) for t, f in enumerate(faces)], "mol_id int, t int, a int, b int, c int")
    return vertices, triangles


def test_thresholds(spark):
    assert stats.quantile_thresholds(numbers(spark, range(1, 11)), "v", 3) == [4, 6, 9]
    assert stats.level_thresholds(numbers(spark, range(101)), "v", 5, 0.05) == [5, 27.5, 50, 72.5, 95]
    assert stats.level_thresholds(numbers(spark, range(9)), "v", 1, 0.05) == []
    assert stats.quantile_thresholds(numbers(spark, []), "v", 3) == []
    levels = spark.createDataFrame([(0, 1.0)], "level int, sigma double")
    got = [r["threshold"] for r in stats.linear_thresholds(levels, 8.0, 1.35, 4).orderBy("i").collect()]
    assert np.allclose(got, [1.87, 3.74, 5.61, 7.48])


@pytest.mark.parametrize("seed", range(3))
def test_order_statistics_are_exact(spark, seed):
    rng = np.random.default_rng(seed)
    values = rng.choice([rng.normal(size=400), rng.integers(0, 5, 400).astype(float)][seed % 2], 3000)
    wanted = [0, 1, 17, 1499, 2998, 2999]
    assert stats.order_statistics(numbers(spark, values), "v", lambda n: wanted) == [float(x) for x in np.sort(values)[wanted]]


def test_trim_search_agrees_with_slices(spark):
    rng = np.random.default_rng(4)
    values = np.sort(np.round(rng.exponential(size=501), 2))
    best = None
    for lev in range(50):
        cut = 501 * lev // 100
        s = values[cut : 501 - cut]
        span = s[-1] - s[0]
        if span > 0:
            ratio = (6 * s.std() - span) / span
            if best is None or abs(ratio) < abs(best[2]) - 1e-12:
                best = (lev, s.mean(), ratio)
    got = stats.trim_search(numbers(spark, values), "v").first()
    assert got["lev"] == best[0] and np.allclose((got["mean"], got["ratio"]), best[1:])


def test_histogram_of_pairs(spark):
    points = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 0.0), (0, 1, 0, 1.0, 0.0, 0.0), (0, 2, 1, 0.5, 2.9580398915498081, 0.0)], "mol_id int, p int, type int, x double, y double, z double")
    for salts in (1, 3):
        got = {r["type"]: r["cnt"] for r in pairs.pair_histogram(points, 2, [2.0], salts=salts).collect()}
        assert got == {0: 1, 3: 2}
    assert pairs.triples(points).count() == 1


def test_histogram_totals(spark):
    rng = np.random.default_rng(1)
    sizes = [1, 2, 7, 12]
    rows = [(m, p, int(rng.integers(3)), *map(float, rng.normal(size=3))) for m, n in enumerate(sizes) for p in range(n)]
    points = spark.createDataFrame(rows, "mol_id int, p int, type int, x double, y double, z double")
    two = {r["mol_id"]: r["n"] for r in pairs.pair_histogram(points, 3, [0.5, 1.0]).groupBy("mol_id").agg(F.sum("cnt").alias("n")).collect()}
    three = {r["mol_id"]: r["n"] for r in pairs.triple_histogram(points, [0.5, 1.0]).groupBy("mol_id").agg(F.sum("cnt").alias("n")).collect()}
    assert two == {m: n * (n - 1) // 2 for m, n in enumerate(sizes) if n > 1}
    assert three == {m: n * (n - 1) * (n - 2) // 6 for m, n in enumerate(sizes) if n > 2}


def test_octahedron(spark, octahedron):
    vertices, triangles = octahedron
    edges = mesh.undirected_edges(triangles)
    assert edges.count() == 12 and mesh.triangle_adjacency(triangles).count() == 12
    shaped = mesh.triangle_geometry(triangles, vertices).collect()
    assert all(math.isclose(r["area"], math.sqrt(3) / 2) for r in shaped)
    assert all(math.isclose(r["nx"] ** 2 + r["ny"] ** 2 + r["nz"] ** 2, 1) for r in shaped)
    lengths = mesh.both_ways(mesh.edge_lengths(edges, vertices))
    far = {(r["v"], r["u"]): r["d"] for r in graph.geodesics(lengths).collect()}
    assert math.isclose(far[0, 1], 2 * math.sqrt(2)) and far[3, 3] == 0 and len(far) == 36
    rows = spark.createDataFrame([(0, v, u, d) for (v, u), d in far.items()], "mol_id int, v int, u int, d double")
    got = {(r["v"], r["t"]): r["d"] for r in mesh.vertex_triangle_distance(rows, triangles).collect()}
    assert math.isclose(got[0, 0], 2 * math.sqrt(2) / 3) and math.isclose(max(got.values()), 4 * math.sqrt(2) / 3)


def test_components_and_segments(spark):
    vertices = spark.createDataFrame([(0, v, v // 3) for v in range(6)], "mol_id int, v int, value int")
    triangles = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 3, 4, 5)], "mol_id int, t int, a int, b int, c int")
    edges = mesh.both_ways(mesh.undirected_edges(triangles))
    assert mesh.undirected_edges(triangles).count() == 6 and mesh.triangle_adjacency(triangles).count() == 0
    comp = {r["v"]: r["component"] for r in graph.connected_components(vertices, edges).collect()}
    assert comp == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
    segs = {r["v"]: r["seg"] for r in graph.segments_by_value(vertices, edges).collect()}
    assert segs == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 2}
    assert {r["seg"] for r in graph.segments_by_value(vertices, edges, 4).collect()} == {0}


def path(spark, n):
    return spark.createDataFrame([(0, i, i + 1) for i in range(n - 1)] + [(0, i + 1, i) for i in range(n - 1)], "mol_id int, src int, dst int")


def test_long_path_has_one_component(spark):
    vertices = spark.createDataFrame([(0, v) for v in range(40)], "mol_id int, v int")
    assert {r["component"] for r in graph.connected_components(vertices, path(spark, 40)).collect()} == {0}


def test_hops_and_filling(spark):
    seed = spark.createDataFrame([(0, 0)], "mol_id int, v int")
    assert {r["v"]: r["hops"] for r in graph.bfs_hops(seed, path(spark, 4), 2).collect()} == {0: 0, 1: 1, 2: 2}
    holes = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (0, 2, None), (0, 3, None), (0, 4, 9.0)], "mol_id int, v int, value double")
    assert {r["v"]: r["value"] for r in graph.fill_from_borders(holes, path(spark, 5)).collect()} == {0: 1, 1: 1, 2: 5, 3: 9, 4: 9}
    values = spark.createDataFrame([(0, v, x) for v, x in enumerate((1.0, 1.5, 3.0, 1.2))], "mol_id int, v int, value double")
    seeds = spark.createDataFrame([(0, 0)], "mol_id int, seed int")
    assert sorted(r["v"] for r in graph.segments_from_seeds(values, path(spark, 4), seeds, 1.0).collect()) == [0, 1]


def test_ring_bonds(spark):
    bonds = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 0, 2), (0, 2, 3)], "mol_id long, i long, j long")
    got = {(r["i"], r["j"]): r["in_ring"] for r in graph.ring_bonds(bonds).collect()}
    assert got == {(0, 1): True, (1, 2): True, (0, 2): True, (2, 3): False}
    atoms = spark.createDataFrame([(0, i, "C") for i in range(4)], "mol_id long, i long, elem string")
    ordered = bonds.withColumn("order", F.when(F.col("i") == 1, 2).otherwise(1))
    codes = {r["i"]: r["code"] for r in chains.atom_codes(atoms, ordered, graph.ring_bonds(bonds)).collect()}
    assert codes == {0: "C2sr", 1: "C2dr", 2: "C3ds", 3: "C1sc"}
    assert chains.paths(bonds, 3).count() == 5


def test_extrema(spark):
    values = [(0, v, lev, float(x)) for lev, row in enumerate(((1, 0, 0), (5, 4, 4), (2, 0, 0))) for v, x in enumerate(row)]
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (0, 0, 2), (0, 2, 0)], "mol_id int, src int, dst int")
    df = spark.createDataFrame(values, "mol_id int, v int, level int, value double")
    got = neighbours.scale_extrema(df, edges).where("kind = 1").collect()
    assert [(r["v"], r["level"]) for r in got] == [(0, 1)]
    tied = df.withColumn("value", F.when((F.col("v") == 1) & (F.col("level") == 1), 5.0).otherwise(F.col("value")))
    assert neighbours.scale_extrema(tied, edges).where("v = 0").count() == 0


def test_radius_join_agrees_with_all_pairs(spark):
    rng = np.random.default_rng(2)
    xyz = rng.uniform(-3, 3, (60, 3))
    points = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(xyz)], "mol_id int, v int, x double, y double, z double")
    far = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
    for sides in (None, 2, 1, 0):
        got = {(r["v"], r["u"]) for r in neighbours.within_radius(points, 1.3, sides=sides).collect()}
        assert got == {(i, j) for i in range(60) for j in range(60) if i != j and far[i, j] <= 1.3}


def test_blur_of_constant(spark):
    near = spark.createDataFrame([(0, v, u, float(abs(v - u)), 2.0) for v in range(6) for u in range(6)], "mol_id int, v int, u int, d double, w double")
    values = spark.createDataFrame([(0, v, 7.0) for v in range(6)], "mol_id int, v int, value double")
    for r in filters.scale_space(near, values, [0.4, 1.0, 9.0]).collect():
        assert math.isclose(r["value"], 7.0)
    assert {r["median"] for r in filters.weighted_median(near, values, 2.0).collect()} == {7.0}


def test_fields(spark):
    point = spark.createDataFrame([(0, 0, 2.0, 0.0, 0.0)], "mol_id int, v int, x double, y double, z double")
    atom = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 1.53)], "mol_id int, x double, y double, z double, charge double, radius double")
    assert math.isclose(fields.potential(point, atom).first()["potential"], 0.5)
    near = point.withColumn("x", F.lit(1.53))
    assert abs(fields.lennard_jones(near, atom).first()["lj"]) < 1e-6
    assert fields.force(point, atom).first()["fx"] == pytest.approx(0.25)


def test_curvature_of_a_paraboloid(spark):
    rows = [(0, 0, i, p, q, 1.5 * p * p / 2 + 0.5 * p * q - q * q / 2) for i, (p, q) in enumerate(((1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (-1.0, 0.5)))]
    local = spark.createDataFrame(rows, "mol_id int, v int, u int, p double, q double, h double")
    r = geometry.paraboloid_curvature(local).first()
    assert (r["gauss"], r["mean"]) == pytest.approx((1.5 * -1 - 0.25, 0.5))
    few = geometry.paraboloid_curvature(local.limit(1)).first()
    assert (few["gauss"], few["mean"]) == (0, 0)


def test_conflicts(spark):
    rows = spark.createDataFrame([(1, 1, 0, 1), (2, 1, 0, -1), (3, 0, 1, 1), (4, 2, 2, -1)], "id int, a int, b int, y int")
    kept = learn.delete_conflicts(rows, ["a", "b"])
    assert sorted(r["id"] for r in kept.collect()) == [3, 4]
    assert kept.exceptAll(learn.delete_conflicts(kept, ["a", "b"])).count() == 0
    learn.check_classes(kept)
    with pytest.raises(ValueError):
        learn.check_classes(kept.where("y = 1"))


def test_balancing(spark):
    rows = spark.createDataFrame([(i, 1) for i in range(5)] + [(10, -1), (11, -1)], "id int, y int")
    out = learn.balance(rows, "id", "y")
    assert sorted((r["id"], r["copy"]) for r in out.where("copy > 0").collect()) == [(10, 1), (10, 2), (11, 1)]
    assert [r["count"] for r in out.groupBy("y").count().collect()] == [5, 5]


def test_folds_keep_duplicates(spark):
    rows = spark.createDataFrame([(i % 9, 1 if i % 9 < 4 else -1) for i in range(30)], "id int, y int")
    folds = learn.balanced_folds(rows, "id", 3)
    assert folds.count() == 9 and sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [3, 3, 3]


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3))
    y = np.where(x[:, 0] - 0.5 * x[:, 1] > 0, 1.0, -1.0)
    w, b = learn.linear_svm(x, y, 10.0)
    assert np.mean(np.where(x @ w + b >= 0, 1, -1) == y) > 0.95
    a = learn.kernel_svm(x @ x.T, y, 10.0)
    assert np.mean(np.where((x @ x.T + 1) @ a >= 0, 1, -1) == y) > 0.95
    z = learn.l0_weights(np.hstack([x, rng.normal(size=(80, 6)) * 0.3]), y, 1.0)
    assert z[0] > 0 and (z > 0).sum() <= 5


def test_tfidf(spark):
    md = spark.createDataFrame([("A", "x", 2), ("A", "y", 1), ("B", "y", 1)], "mol_id string, type string, cnt int")
    got = {(r[0], r[1]): r[2] for r in features.tfidf(md, 2).collect()}
    assert got["A", "x"] == pytest.approx(2.810930) and got["A", "y"] == 1 and got["B", "y"] == 1


def test_tfidf_shuffles_no_cells(spark, monkeypatch):
    """Every cell was shuffled by type, twice, whatever the number of types; a null object was in no count."""
    md = spark.createDataFrame([("A", "x", 2), ("A", "y", 1), ("B", "y", 1), (None, "x", 1)], "mol_id string, type string, cnt int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = features.tfidf(md, 3)
        assert {(r[0], r[1]): r[2] for r in out.collect()} == {("A", "x"): pytest.approx(2 * (np.log(4 / 3) + 1)), ("A", "y"): pytest.approx(np.log(4 / 3) + 1), ("B", "y"): pytest.approx(np.log(4 / 3) + 1), (None, "x"): pytest.approx(np.log(4 / 3) + 1)}
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(features, "TYPE_BYTES", 0)
        shuffled = features.tfidf(md, 3)
        assert sorted(shuffled.collect(), key=str) == sorted(out.collect(), key=str) and "BroadcastHashJoin" not in shuffled._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_correlation_filter(spark):
    cells = [(i, t, v) for i in range(6) for t, v in enumerate((float(i), 2.0 * i, 3.0))]
    md = spark.createDataFrame(cells, "mol_id int, type int, value double")
    assert [r["type"] for r in features.variance_corr_filter(md).collect()] == [0]


def test_reverse_dedupe(spark):
    rows = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["c", "b", "a"]), (2, ["a", "b", "a"])], "i int, chain array<string>")
    assert sorted(r["i"] for r in chains.reverse_dedupe(rows).collect()) == [1, 2]


def test_set_kernels(spark):
    points = spark.createDataFrame([(m, p, 0, float(p), 0.0, 0.0) for m in (0, 1) for p in (0, 1)], "mol_id int, p int, type int, x double, y double, z double")
    same = lambda a, b: (a == b).cast("double")
    two = {(r["m1"], r["m2"]): r["k"] for r in kernels.pair_kernel(pairs.pairs(points), same).collect()}
    assert two[0, 1] == 2
    assert kernels.triple_kernel(pairs.pairs(points), same).where("k <> 0").count() == 0


def test_majority(spark):
    types = spark.createDataFrame([(0, v, t) for v, t in enumerate((1, 1, 3, 1, 2, 3))], "mol_id int, v int, type int")
    triangles = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 3, 4, 5)], "mol_id int, t int, a int, b int, c int")
    assert {r["t"]: r["type"] for r in graph.triangle_types(triangles, types).collect()} == {0: 1, 1: 3}


def test_greedy_points(spark):
    rng = np.random.default_rng(3)
    xyz = rng.uniform(0, 3, (80, 3))
    df = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(xyz)], "mol_id int, p int, x double, y double, z double")
    kept = []
    for i in range(80):
        if all(np.linalg.norm(xyz[i] - xyz[j]) >= 0.9 for j in kept):
            kept.append(i)
    assert sorted(r["p"] for r in detect.greedy_points(df, 0.9, ["p"]).collect()) == kept


def test_greedy_points_of_many_objects(spark):
    """Small objects together, larger ones by cells, over batches that cut them; a null coordinate failed."""
    rng = np.random.default_rng(5)
    rows, expected = [], set()
    for m, n in enumerate([1, 40, 2, 0, 33, 32, 7, 90, 5, 31, 3]):
        xyz, kinds, kept = rng.uniform(0, 3, (n, 3)), rng.integers(0, 2, n), []
        for i in range(n):
            null = i % 13 == 6
            rows.append((m or None, i, *map(float, xyz[i][:2]), None if null else float(xyz[i][2]), int(kinds[i])))
            if null or all(kinds[i] != kinds[j] or np.linalg.norm(xyz[i] - xyz[j]) >= 0.9 for j in kept):
                kept += [] if null else [i]
                expected.add((m or None, i))
    df = spark.createDataFrame(rows, "mol_id int, p int, x double, y double, z double, kind int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("10000", "17", "1"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            assert {(r["mol_id"], r["p"]) for r in detect.greedy_points(df, 0.9, ["p"], types=("kind",)).collect()} == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_balanced_accuracy_and_losses(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (1, -1), (-1, -1)], "y int, predicted int")
    assert learn.balanced_accuracy(rows).first()[0] == pytest.approx((2 / 3 + 1) / 2)
    assert rows.agg(learn.zero_one_loss(F.col("y"), F.col("predicted"))).first()[0] == 1

"""Pair equality, rotations, frames, fields of unit vectors, grown descriptor sets, folds of meshes, finders by property."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetspark.functions import expressions as X
from facetspark.operators import chains, detect, filters, geometry, graph, kernels, learn, pairs, spheres
from facetspark.plans import queries
from facetspark.sources.text import STAGES


def cloud(seed=1, n=24):
    """A piece of a curved surface with normals, and for each vertex a unit vector and a value."""
    r, rows = random.Random(seed), []
    for v in range(n):
        x, y = r.uniform(-1, 1), r.uniform(-1, 1)
        normal = np.array([-0.4 * x, -0.6 * y, 1.0])
        normal /= np.linalg.norm(normal)
        f = np.array([0.3 + 0.2 * x, 0.1 * y * y - 0.2, 0.9])
        f /= np.linalg.norm(f)
        rows.append((1, v, x, y, 0.2 * x * x + 0.3 * y * y, *normal.tolist(), *f.tolist(), x * x - y))
    return rows


@pytest.fixture(scope="module")
def surface(spark):
    df = spark.createDataFrame(cloud(), "mol_id long, v long, x double, y double, z double, nx double, ny double, nz double, fx double, fy double, fz double, value double")
    near = df.select("mol_id", "v").crossJoin(df.select(F.col("v").alias("u"))).where("v <> u")
    return df, geometry.local_coordinates(df, near)


def fit(rows, columns):
    return np.linalg.lstsq(np.array([[x ** i * y ** j for i, j in columns] for x, y, _ in rows]), np.array([z for *_, z in rows]), rcond=None)[0]


def test_heat_step_and_spherical_hessians(surface):
    df, local = surface
    field = df.select("mol_id", "v", *[F.col(f"f{c}").alias(c) for c in "xyz"])
    values = {r["v"]: np.array([r["x"], r["y"], r["z"]]) for r in field.collect()}
    at = defaultdict(list)
    for r in local.collect():
        at[r["v"]].append((r["u"], r["p"], r["q"]))
    expected = {}
    for v, f in values.items():
        theta, phi = math.atan2(f[1], f[0]), math.acos(f[2])
        along = np.array([math.cos(theta) * math.cos(phi), math.sin(theta) * math.cos(phi), -math.sin(phi)])
        across = np.array([-math.sin(theta), math.cos(theta), 0])
        traces = []
        for k in (0, 1):
            rows = []
            for u, p, q in at[v]:
                w = (along @ values[u], across @ values[u])
                rows.append((p, q, math.acos(min(1, f @ values[u])) * w[k] / math.hypot(*w)))
            g = fit(rows, [(1, 0), (0, 1)])
            h = np.linalg.lstsq(np.array([[p * p / 2, p * q, q * q / 2] for p, q, _ in rows]), np.array([z - g @ (p, q) for p, q, z in rows]), rcond=None)[0]
            traces.append(0.01 * (h[0] + h[2]))
        size = math.hypot(*traces)
        expected[v] = math.sin(size) * (traces[0] * along + traces[1] * across) / size + math.cos(size) * f
    got = {r["v"]: np.array([r["x"], r["y"], r["z"]]) for r in spheres.heat_step(local, field, 0.01).collect()}
    assert all(np.allclose(got[v], expected[v], atol=1e-8) for v in values) and all(abs(np.linalg.norm(x) - 1) < 1e-9 for x in got.values())
    still = field.withColumns({"x": F.lit(0.0), "y": F.lit(0.6), "z": F.lit(0.8)})
    assert all(np.allclose([r["x"], r["y"], r["z"]], [0, 0.6, 0.8]) for r in spheres.heat_flow(local, still, 0.1, 2).collect())
    poles = spheres.normal_coordinates(local.limit(1).select("mol_id", F.lit(0).alias("v"), F.lit(1).alias("u")), field.sparkSession.createDataFrame([(1, 0, 0.0, 0.0, 1.0), (1, 1, 0.0, 0.0, -1.0)], "mol_id long, v int, x double, y double, z double"))
    assert poles.first()["a"] == pytest.approx(math.pi)


def test_covariant_differential(surface):
    df, local = surface
    field = df.select("mol_id", "v", *[F.col(f"f{c}").alias(c) for c in "xyz"])
    frames = {r["v"]: r for r in geometry.tangent_frames(df).collect()}
    got = {r["v"]: r for r in spheres.covariant_differential(local, spheres.vector_steps(geometry.tangent_frames(df), local, field)).collect()}
    at = defaultdict(list)
    for r in local.collect():
        at[r["v"]].append(r)
    for v, rows in at.items():
        own = frames[v]
        points, dp, dq = [], [], []
        for r in rows:
            length, flat = math.sqrt(r["p"] ** 2 + r["q"] ** 2 + r["h"] ** 2), math.hypot(r["p"], r["q"])
            step = [frames[r["u"]][f"f{c}"] - own[f"f{c}"] for c in "xyz"]
            points.append((r["p"] * length / flat, r["q"] * length / flat))
            dp.append(sum(own[f"u{c}"] * s for c, s in zip("xyz", step)) / length)
            dq.append(sum(own[f"w{c}"] * s for c, s in zip("xyz", step)) / length)
        a, b = np.linalg.lstsq(np.array(points), np.array(dp), rcond=None)[0], np.linalg.lstsq(np.array(points), np.array(dq), rcond=None)[0]
        assert (got[v]["gpp"], got[v]["gpq"], got[v]["gqq"]) == (pytest.approx(a[0]), pytest.approx((a[1] + b[0]) / 2), pytest.approx(b[1]))


def test_rotations_and_frames(spark):
    r = random.Random(4)

    def unit():
        x = np.array([r.gauss(0, 1) for _ in range(3)])
        return (x / np.linalg.norm(x)).tolist()

    rows = [(unit(), unit(), unit()) for _ in range(30)] + [([1.0, 0.0, 0.0], [-1.0, 0.0, 0.0], unit()), ([0.0, 0.6, -0.8], [0.0, -0.6, 0.8], unit()), ([0.0, 0.0, 1.0], [0.0, 0.0, 1.0], unit())]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, x array<double>")
    of = lambda c: [F.get(c, F.lit(i)) for i in range(3)]
    out = df.withColumn("m", X.rotation_between(of("a"), of("b"))).select("a", "b", "x", "m", F.array(*X.turned(F.col("m"), of("a"))).alias("to"))
    for row in out.collect():
        m = np.array(row["m"]).reshape(3, 3)
        assert np.allclose(row["to"], row["b"]) and np.allclose(m @ m.T, np.eye(3)) and np.linalg.det(m) == pytest.approx(1)
    frames = lambda axes: [[F.lit(float(c)) for c in axis] for axis in axes]
    mean = lambda a, b: spark.range(1).select(*[F.array(*axis) for axis in X.frame_mean(frames(a), frames(b))]).first()
    one, quarter, half = [(1, 0, 0), (0, 1, 0), (0, 0, 1)], [(0, 1, 0), (-1, 0, 0), (0, 0, 1)], [(-1, 0, 0), (0, -1, 0), (0, 0, 1)]
    assert np.allclose(mean(one, quarter), [[0.5**0.5, 0.5**0.5, 0], [-(0.5**0.5), 0.5**0.5, 0], [0, 0, 1]])
    assert np.allclose(mean(one, half), [one[1], one[0], one[2]])


def test_equal_pairs(spark):
    rows = [((1, 2, 3.0), (2, 1, 3.0), True), ((1, 2, 3.0), (1, 2, 3.0), True), ((1, 2, 3.0), (2, 1, 4.0), False), ((1, 2, 3.0), (1, 1, 3.0), False), ((None, 2, 3.0), (2, None, 3.0), True), ((1, 2, None), (1, 2, 3.0), False)]
    df = spark.createDataFrame([(*a, *b, e) for a, b, e in rows], "p int, q int, d double, r int, s int, e double, same boolean")
    got = df.select("same", X.same_pair((F.col("p"), F.col("q"), F.col("d")), (F.col("r"), F.col("s"), F.col("e"))).alias("got"))
    assert all(r["same"] == r["got"] for r in got.collect())


def test_kernels_with_properties(spark):
    r = random.Random(8)
    rows = [(m, p, r.randrange(2), r.uniform(0, 4), r.uniform(0, 4), 0.0, r.uniform(0, 1), m % 2) for m in range(4) for p in range(4)]
    points = spark.createDataFrame(rows, "mol_id long, p int, type int, x double, y double, z double, w double, block int")
    found = pairs.pairs(points).join(points.select("mol_id", "block").distinct(), "mol_id")
    for i in (1, 2):
        found = found.join(points.select("mol_id", F.col("p").alias(f"p{i}"), F.col("w").alias(f"w{i}")), ["mol_id", f"p{i}"])
    near = lambda a, b: X.triangle_kernel(a["w"], b["w"], 1.0)
    step = lambda a, b: X.triangle_kernel(a, b, 2.0)
    tri = lambda x, y, c: max(0.0, (c - abs(x - y)) / c)
    own = defaultdict(list)
    for row in rows:
        own[row[0]].append(row)
    dist = lambda a, b: math.dist(a[3:5], b[3:5])
    two, three = defaultdict(float), defaultdict(float)
    for m in own:
        for n in own:
            if m <= n and m % 2 == n % 2:
                a, b = own[m], own[n]
                for i, p in enumerate(a):
                    for q in a[i + 1 :]:
                        for s in b:
                            for t in b:
                                if s[1] != t[1] and p[2] == s[2] and q[2] == t[2]:
                                    two[m, n] += tri(dist(p, q), dist(s, t), 2.0) * tri(p[6], s[6], 1.0) * tri(q[6], t[6], 1.0)
                index = [(p, s) for p in a for s in b if p[2] == s[2]]
                mat = np.array([[tri(p[6], s[6], 1.0) * tri(dist(p, q), dist(s, t), 2.0) if p[1] != q[1] and s[1] != t[1] else 0.0 for q, t in index] for p, s in index])
                three[m, n] = float(np.trace(mat @ mat @ mat)) if len(index) else 0.0
    for kernel, expected in ((kernels.pair_kernel, two), (kernels.triple_kernel, three)):
        got = {(r["m1"], r["m2"]): r["k"] for r in kernel(found, step, ["w"], near, ["block"]).collect()}
        assert all(got.get(k, 0.0) == pytest.approx(x) for k, x in expected.items()) and set(got) <= set(expected)


def test_grown_sets(spark):
    r = random.Random(3)
    x = [[r.randrange(2) for _ in range(5)] for _ in range(40)]
    y = [1 if a[1] ^ a[3] else -1 for a in x]
    cells = spark.createDataFrame([(i, t, v) for i, row in enumerate(x) for t, v in enumerate(row)], "mol_id long, type int, value int")
    labels = spark.createDataFrame(list(enumerate(y)), "mol_id long, y int")
    out = learn.mgua(cells, labels, range(5), 10, 4, 0, good=0.0).collect()
    best = max(out, key=lambda r: r["f"])
    assert best["set_key"] == "1,3" and best["precision"] == 1.0 and {r["round"] for r in out} == {0, 1}
    assert Counter(r["round"] for r in out) == {0: 5, 1: 10}


def test_sets_grow_until_they_no_longer_tell_better(spark, monkeypatch):
    """The query stopped after four rounds, with sets of four signs."""
    r = random.Random(5)
    x = [[r.randrange(2) for _ in range(7)] for _ in range(300)]
    x += x[:40]
    y = [1 if sum(a[:6]) % 2 else -1 for a in x]
    # Some cells are missing or stand twice.
    rows = [(i, t, v) for i, row in enumerate(x) for t, v in enumerate(row) if (i, t) not in {(3, 0), (4, 6)}] + [(5, 2, 1), (400, 3, 0)]
    cells = spark.createDataFrame(rows, "mol_id long, type int, value int")
    labels = spark.createDataFrame([*enumerate(y), (400, 1)], "mol_id long, y int")
    out = [tuple(o) for o in learn.mgua(cells, labels, range(7), 15, None, 0, good=0.0).collect()]
    assert max(out, key=lambda o: o[-1])[1] == "0,1,2,3,4,5" and {o[0] for o in out} == set(range(6))
    monkeypatch.setattr(learn, "FEW", 4)  # most sets' vectors meet
    assert [tuple(o) for o in learn.mgua(cells, labels, range(7), 15, None, 0, good=0.0).collect()] == out
    monkeypatch.setattr(learn, "coded_objects", lambda *_: None)  # by mgua_round's own sums
    assert [tuple(o) for o in learn.mgua(cells, labels, range(7), 15, None, 0, good=0.0).collect()] == out
    taken = []
    monkeypatch.setattr(learn, "mgua", lambda cells, labels, types, keep, rounds, *_: taken.append(rounds) or spark.createDataFrame([], "round int, set_key string, f double"))
    queries.queries()["grown_sets"](spark, "/root/testdata/sf0.001")
    assert taken == [None]


def test_sets_are_counted_where_objects_are(spark):
    """Every object was shuffled once for each set. Cells may be missing or stand twice."""
    cells = [(0, 0, 1), (0, 1, 0), (1, 0, 1), (1, 1, 0), (2, 0, 1), (3, 1, 0), (3, 1, 1), (4, 1, 1), (4, 1, 0), (5, 0, None), (6, 2, 1), (7, 0, 1), (7, 1, 0)]
    cells = spark.createDataFrame(cells, "mol_id long, type int, value int")
    labels = spark.createDataFrame([(0, 1), (1, -1), (2, 1), (3, 1), (4, 1), (5, -1), (6, 1), (8, 1)], "mol_id long, y int")
    out = learn.mgua_round(cells, labels, [[], [0]], [0, 1], 9, 0)
    # Vectors of 0,1: two of (1, 0) in conflict, one of (1, none), two of (none, 0 and 1), one of (null, none).
    want = {"0": (3 / 4, 3 / 4 * 1 / 4), "1": (3 / 4, 3 / 4 * 2 / 4), "0,1": (5 / 6, 5 / 6 * 4 / 6)}
    assert {r["set_key"]: (r["precision"], r["recall"]) for r in out.collect()} == {k: pytest.approx(v) for k, v in want.items()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "set_key" not in "".join(line for line in plan.splitlines() if "Exchange" in line and "mol_id" in line) and plan.count("partial_count(1)")


def test_class_weights(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (1, -1), (-1, 1)], "y int, predicted int")
    assert learn.class_weights(rows) == {1: pytest.approx(4 / 6), -1: pytest.approx(2.0)}
    assert learn.balanced_accuracy(rows).first()[0] == pytest.approx((2 / 3 + 0) / 2)
    assert learn.balanced_accuracy(rows, weights={1: 3.0}).first()[0] == pytest.approx(2 / 3 * 3 / 4)


def test_far_side_of_a_fold(spark):
    """Two strips that lie close but aren't joined: the near one alone counts."""
    tri = spark.createDataFrame([(1, 0, 0, 1, 2, 1.0), (1, 1, 1, 2, 3, 1.0), (1, 2, 2, 3, 4, 1.0), (1, 3, 10, 11, 12, 1.0)], "mol_id long, t int, a int, b int, c int, area double")
    dist = spark.createDataFrame([(1, 0, t, d) for t, d in ((0, 0.1), (1, 0.5), (2, 9.0), (3, 0.2))], "mol_id long, v int, t int, d double")
    all_ = {r["u"]: r["w"] for r in filters.mesh_weights(dist, tri, 1.0).collect()}
    own = {r["u"]: r["w"] for r in filters.connected_mesh_weights(dist, tri, 1.0).collect()}
    assert set(all_) == {0, 1, 2, 3, 10, 11, 12} and own == {0: 1.0, 1: 2.0, 2: 2.0, 3: 1.0}


def test_filling_must_end(spark):
    edges = spark.createDataFrame([(1, i, j) for i in range(6) for j in (i - 1, i + 1) if 0 <= j < 6], "mol_id long, src int, dst int")
    values = spark.createDataFrame([(1, v, 1.0 if v == 0 else None) for v in range(6)], "mol_id long, v int, value double")
    assert graph.fill_from_borders(values, edges).where("value is null").count() == 0
    with pytest.raises(RuntimeError):
        graph.fill_from_borders(values, edges, 3)


def test_finders_by_property(surface):
    df, local = surface
    vertices = df.withColumn("other", -F.col("value"))
    steps = F.sqrt(F.col("p") ** 2 + F.col("q") ** 2 + F.col("h") ** 2)
    itself = df.select("mol_id", "v", F.col("v").alias("u"), *[F.lit(0.0).alias(c) for c in "pqhd"])
    near = local.withColumn("d", steps).select("mol_id", "v", "u", "p", "q", "h", "d").unionByName(itself)
    edges = local.where(steps < 0.7).select("mol_id", F.col("v").alias("src"), F.col("u").alias("dst"))
    for channel in ("scalar", "manifold_det", "manifold_trace"):
        own = detect.ScaleSpaceFinder([0.3, 0.6, 0.9], "hess_det", channel, ["value", "other"])
        assert own.responses(vertices, near).count() == 3 * 24 and "kind" in own.find(vertices, edges, near).columns
    for wrong in ({"channels": "manifold_det"}, {"properties": ["value", "other"]}, {"kind": "hess_det", "channels": "pca"}):
        with pytest.raises(ValueError):
            detect.ScaleSpaceFinder([1.0], **wrong)
    each = [detect.ScaleSpaceFinder([0.3, 0.6, 0.9], "log", properties=[c]) for c in ("value", "other")]
    merged = detect.separate_extrema(each, vertices, edges, near, 0.5).collect()
    every = [f.find(vertices, edges, near).count() for f in each]
    places = [(r["x"], r["y"], r["z"]) for r in merged]
    assert len(merged) < sum(every) and all(math.dist(a, b) >= 0.5 for i, a in enumerate(places) for b in places[:i])


def test_sweep_over_markers_and_lengths(spark):
    atoms = spark.createDataFrame([(1, i, e) for i, e in enumerate("CCO")], "mol_id long, i int, elem string")
    bonds = spark.createDataFrame([(1, 0, 1, 2), (1, 1, 2, 1)], "mol_id long, i int, j int, order int")
    out = chains.sweep(atoms, bonds, markers=["", "B"], lengths=[2, 3]).collect()
    got = {(r["markers"], r["length"], r["code"]): r["cnt"] for r in out}
    assert got == {("", 2, "C___-C___"): 1, ("", 2, "C___-O___"): 1, ("", 3, "C___-C___-O___"): 1, ("B", 2, "C_d_-C_d_"): 1, ("B", 2, "C_d_-O_s_"): 1, ("B", 3, "C_d_-C_d_-O_s_"): 1}
    assert len(chains.MARKERS) * len(chains.LENGTHS) == 24 and len(STAGES) == 28 and len(set(STAGES.values())) == 28

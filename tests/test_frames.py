import numpy as np
import pytest

from facetspark.operators import frames, graph


def ball(n=60, reach=0.75, seed=5):
    p = np.random.default_rng(seed).normal(size=(n, 3))
    p /= np.linalg.norm(p, axis=1)[:, None]
    return p, [(i, j) for i in range(n) for j in range(n) if i != j and np.linalg.norm(p[i] - p[j]) < reach]


def tables(spark, p, normals, edges):
    surface = spark.createDataFrame([(0, v, *map(float, p[v]), *map(float, 2 * normals[v])) for v in range(len(p))], "mol_id long, v long, x double, y double, z double, nx double, ny double, nz double")
    return surface, spark.createDataFrame([(0, i, j) for i, j in edges], "mol_id long, src long, dst long")


def queue_version(p, normals, edges, seed, axis):
    """Axes by a queue of vertices, each pushing its axis to neighbours one layer on."""
    near = {}
    for i, j in edges:
        near.setdefault(i, []).append(j)
    out, sums, layer, todo = {}, {seed: axis - axis @ normals[seed] * normals[seed]}, {seed: 0}, [seed]
    while todo:
        i = todo.pop(0)
        out[i] = sums[i] / np.linalg.norm(sums[i])
        for j in near.get(i, []):
            if j not in layer:
                layer[j], sums[j] = layer[i] + 1, np.zeros(3)
                todo.append(j)
            if layer[j] == layer[i] + 1:
                k, c = np.cross(normals[i], normals[j]), normals[i] @ normals[j]
                angle, about = np.arccos(np.clip(c, -1, 1)), k / np.linalg.norm(k)
                x = out[i]
                turned = x * np.cos(angle) + np.cross(about, x) * np.sin(angle) + about * (about @ x) * (1 - np.cos(angle))
                edge = (p[j] - p[i]) / np.linalg.norm(p[j] - p[i])
                sums[j] = sums[j] + min(1, max(0, 1 - about @ edge)) ** 10 * turned
    return out, layer


def test_propagation_against_a_queue(spark):
    p, edges = ball()
    normals = p + np.random.default_rng(6).normal(size=p.shape) * 0.2
    normals /= np.linalg.norm(normals, axis=1)[:, None]
    surface, links = tables(spark, p, normals, edges)
    seeds = spark.createDataFrame([(0, 3, 1.0, 2.0, 0.5)], "mol_id long, v long, ux double, uy double, uz double")
    want, layer = queue_version(p, normals, edges, 3, np.array([1.0, 2.0, 0.5]))
    got = {r["v"]: r for r in frames.propagate(surface, links, seeds).collect()}
    assert got.keys() == want.keys() and len(set(layer.values())) > 3
    for v, r in got.items():
        u = np.array([r["ux"], r["uy"], r["uz"]])
        assert r["layer"] == layer[v] and np.allclose(u, want[v], atol=1e-8) and abs(u @ normals[v]) < 1e-9


def test_conflicts_only_round_the_far_pole(spark):
    """A sphere has no frame without a seam; carried from one pole, it lies at the other."""
    p, edges = ball(400, 0.3, 7)
    surface, links = tables(spark, p, p, edges)
    top = int(p[:, 2].argmax())
    seeds = spark.createDataFrame([(0, top, 1.0, 0.0, 0.0)], "mol_id long, v long, ux double, uy double, uz double")
    carried = graph.written(frames.propagate(surface, links, seeds))
    against = [r["v"] for r in graph.frame_conflicts(carried, links).where("conflict").collect()]
    assert all(p[v][2] < 0 for v in against)


def test_signs_are_aligned(spark):
    flat = np.array([(i, j, 0.0) for i in range(5) for j in range(5)])
    edges = [(a, b) for a in range(25) for b in range(25) if np.abs(flat[a] - flat[b]).sum() == 1]
    signs = np.random.default_rng(1).choice([-1.0, 1.0], 25)
    own = spark.createDataFrame([(0, v, float(signs[v]), 0.1 * float(signs[v]), 0.0) for v in range(25)], "mol_id long, v long, ux double, uy double, uz double")
    _, links = tables(spark, flat, np.tile([0.0, 0.0, 1.0], (25, 1)), edges)
    out = frames.aligned(own, links, own.where("v = 7")).collect()
    assert len(out) == 25 and {r["ux"] for r in out} == {signs[7]}


def test_defined_results(spark):
    p = np.array([(0.0, 0, 0), (1, 0, 0), (2, 0, 0), (9, 9, 9)])
    surface, links = tables(spark, p, np.array([(0.0, 0, 1), (0, 0, -1), (0, 0, 0), (0, 0, 1)]), [(0, 1), (1, 0), (1, 2), (2, 1)])
    seeds = spark.createDataFrame([(0, 0, 1.0, 0.0, 5.0)], "mol_id long, v long, ux double, uy double, uz double")
    got = {r["v"]: (r["layer"], r["ux"]) for r in frames.propagate(surface, links, seeds).collect()}
    assert got == {0: (0, 1.0), 1: (1, 1.0), 2: (2, None)}  # opposite normals leave the axis, none has none, the rest is absent
    assert frames.propagate(surface, links, seeds.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        frames.propagate(surface, links, seeds, max_rounds=1)

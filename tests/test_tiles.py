"""Work on all pairs of vectors by tiles, against plain loops; chunks are small, so that keys have many of them."""

import math

import numpy as np
import pyarrow as pa
import pytest

from facetspark.operators import graph, tiles
from facetspark.plans import queries

SCHEMA = "key int, v long, vec array<float>"


@pytest.fixture(scope="module")
def rows():
    g = np.random.default_rng(5)
    return [(i % 3, i, [float(np.float32(x)) for x in g.normal(size=4)]) for i in range(90)]


ODD = [(0, 200, None), (0, 201, [1.0, None, 0.0, 0.0]), (0, 202, [1.0]), (None, 203, [1.0] * 4), (0, None, [1.0] * 4), (7, 204, [1.0] * 4), (0, 205, [math.inf] * 4), (0, 206, [math.nan] * 4), (0, 207, [])]


def apart(a, b):
    total = 0.0  # sum() of floats rounds once
    for x, y in zip(a, b):
        total += (x - y) * (x - y)
    return math.sqrt(total)


def test_pairs_within_a_radius_over_many_tiles(spark, rows):
    found = {(r["key"], r["v"], r["u"]): r["d"] for r in tiles.within(spark.createDataFrame(rows + ODD, SCHEMA), 2.0, 7).collect()}
    want = {(k, v, u): apart(a, b) for k, v, a in rows for j, u, b in rows if k == j and v < u and apart(a, b) <= 2.0}
    assert found == want and len(want) > 100
    edge = [(0, 1, [0.0, 0.0]), (0, 2, [3.0, 4.0]), (0, 3, [3.0, 4.000001]), (0, 4, [1e30, 1e30]), (0, 5, [1e30, 1e30])]
    assert {(r["v"], r["u"]) for r in tiles.within(spark.createDataFrame(edge, SCHEMA), 5.0, 2).collect()} == {(1, 2), (2, 3), (4, 5)}
    assert tiles.within(spark.createDataFrame([], SCHEMA), 1.0).count() == 0


def test_sums_of_distances(spark, rows):
    got = {(r["key"], r["v"]): r["total"] for r in tiles.distance_sums(spark.createDataFrame(rows, SCHEMA), size=7).collect()}
    assert got == {(k, v): sum(math.floor(apart(a, b) * 1e6 + 0.5) for j, u, b in rows if j == k and u != v) for k, v, a in rows}


def test_medoid_counts_pairs_of_any_distance(spark, tmp_path):
    """Pairs further apart than 4 were left out."""
    at = [[0.0], [1.0], [2.0], [50.0], [51.0], [52.0], [53.0]]
    spark.createDataFrame([(i, x, 0) for i, x in enumerate(at)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in queries.queries()["medoid"](spark, str(tmp_path)).collect()] == [(0, 1, 3)]


def test_gram_of_all_pairs(spark, rows):
    df = spark.createDataFrame(rows + ODD[:4], SCHEMA).withColumnRenamed("v", "mol_id")
    got = {(r["m1"], r["m2"]): r["k"] for r in tiles.gram(df, ["key"], 7).collect()}
    want = {(v, u): sum(x * y for x, y in zip(a, b)) for k, v, a in rows for j, u, b in rows if j == k}
    assert {p: k for p, k in got.items() if max(p) < 200} == pytest.approx(want, abs=1e-12)
    odd = {p: k for p, k in got.items() if max(p) >= 200}
    assert {p for p, k in odd.items() if k is not None} == {(202, 202)} and len(odd) == 3 * 33 + 30 * 3


def test_sums_of_gaussian_rows(spark, rows):
    df = spark.createDataFrame(rows + ODD[:3], SCHEMA).withColumnRenamed("v", "mol_id")
    got = {(r["mol_id"], r["parameter"]): r["total"] for r in tiles.gaussian_sums(df, ["key"], [0.5, 2.0], 7).collect()}
    want = {(v, i): sum(math.exp(-g * apart(a, b) ** 2) for j, u, b in rows if j == k) for k, v, a in rows for i, g in enumerate([0.5, 2.0])}
    assert {p: t for p, t in got.items() if p[0] < 200} == pytest.approx(want)


def test_vectors_of_large_keys_travel_a_few_times(spark, rows):
    """Each vector travelled once for every `size` vectors of its key; a tile's pairs were one table."""
    df = spark.createDataFrame(rows, SCHEMA)
    work = lambda a, b, same: iter([{"n": [len(a.ids) + (0 if same else len(b.ids))]}])
    for size, chunks in ((1, 8), (2, 8), (7, 5), (100, 1)):
        met = tiles.tiled(df, ["key"], work, "n long", size=size).agg({"n": "sum"}).first()[0]
        assert met == 90 * chunks
    chunk = tiles.Chunk(np.arange(70_000), pa.array([[0.0]] * 70_000))
    parts = list(tiles.strips(chunk, chunk))
    assert parts[0].stop == 1 and len(parts) == 70_000 and len(list(tiles.strips(chunk, tiles.Chunk(np.arange(9), pa.array([[0.0]] * 9))))) == 1094


def test_gaussians_of_doubled_parameters_are_squares(monkeypatch):
    """Each kernel was a power of its own, and each distance 64 steps through memory."""
    r, gammas, calls, exp = np.random.default_rng(2), [2.0**i for i in range(-10, 5)] + [3.0], [], np.exp
    a, b = r.normal(size=(20, 64)) / 8, r.normal(size=(30, 64)) / 8
    out = np.zeros((20, 30), bool)
    out[3, 4] = True
    monkeypatch.setattr(tiles, "squares", lambda *_: pytest.fail("by components"))
    d2 = tiles.squares_within(a, b, tiles.ERROR / 16)
    monkeypatch.setattr(tiles.np, "exp", lambda *args, **named: calls.append(1) or exp(*args, **named))
    got = [k.copy() for k in tiles.gaussians(d2, out, gammas)]
    assert len(calls) == 4
    for k, gamma in zip(got, gammas):
        assert k == pytest.approx(np.where(out, 0.0, exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(axis=2))), rel=1e-11)


def test_geodesics_of_at_most_two_edges(spark):
    """A path of three edges is no path of two; one of two may be shorter than one edge."""
    one = [(0, 1, 2, 1.0), (0, 2, 3, 0.5), (0, 3, 4, 0.5), (0, 1, 3, 1.9)]
    edges = spark.createDataFrame([e for m, a, b, x in one for e in ((m, a, b, x), (m, b, a, x))], "mol_id long, src long, dst long, len double")
    two = {(r["v"], r["u"]): r["d"] for r in graph.geodesics(edges, 2.1, 2).collect()}
    assert two == {(a, b): d for x, y, d in ((1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0), (4, 4, 0.0), (1, 2, 1.0), (2, 3, 0.5), (3, 4, 0.5), (1, 3, 1.5), (2, 4, 1.0)) for a, b in ((x, y), (y, x))}
    assert {(r["v"], r["u"]) for r in graph.geodesics(edges, 2.1).collect()} == set(two) | {(1, 4), (4, 1)}

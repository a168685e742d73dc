import random
from itertools import combinations

import numpy as np
import pytest

from facetspark.operators import learn, solvers


def data(seed=5, n=70):
    r = random.Random(seed)
    x = [[r.randrange(4) for _ in range(6)] for _ in range(n)]
    return x, [1 if a[1] + a[4] > 3 else -1 for a in x]


def brute_force(x, y, chosen, least, folds, c):
    of = {}
    for a, label in zip(x, y):
        of.setdefault(tuple(float(a[t]) for t in chosen), []).append(label)
    free = [(v, labels[0], len(labels)) for v, labels in of.items() if len(set(labels)) == 1]
    if sum(n for _, _, n in free) < least:
        return None
    free.sort(key=lambda r: (r[1], r[2], r[0]))
    wrong = tested = 0
    for k in range(min(folds, len(free))):
        train, test = [r for i, r in enumerate(free) if i % folds != k], [r for i, r in enumerate(free) if i % folds == k]
        if len({r[1] for r in train}) < 2:
            continue
        rows = [(v, label) for v, label, n in train for _ in range(n)]
        w = solvers.fit(np.array([v for v, _ in rows]), np.array([label for _, label in rows], float), c)
        for v, label, n in test:
            wrong += n * ((1 if np.dot(v, w[:-1]) + w[-1] >= 0 else -1) != label)
            tested += n
    if not tested:
        return None
    p = 1 - wrong / tested
    return p, p * sum(n for _, _, n in free) / len(x)


@pytest.mark.parametrize("size", [1, 2, 3])
def test_round_equals_brute_force(spark, size):
    x, y = data()
    cells = spark.createDataFrame([(i, t, v) for i, row in enumerate(x) for t, v in enumerate(row)], "mol_id long, type int, value int")
    labels = spark.createDataFrame(list(enumerate(y)), "mol_id long, y int")
    sets = [list(s) for s in combinations(range(6), size - 1)]
    got = {r.set_key: (r.precision, r.recall) for r in learn.validated_round(cells, labels, sets, range(6), 1000, 10).collect()}
    want = {",".join(map(str, s)): brute_force(x, y, s, 10, 5, 1.0) for s in combinations(range(6), size)}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items() if v}


def test_growth_finds_the_telling_pair(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(90, 5))
    y = np.where(x[:, 1] - x[:, 3] > 0, 1, -1)
    cells = spark.createDataFrame([(i, t, float(x[i, t])) for i in range(90) for t in range(5)], "mol_id long, type int, value double")
    labels = spark.createDataFrame([(i, int(y[i])) for i in range(90)], "mol_id long, y int")
    out = learn.mgua(cells, labels, range(5), 3, 2, folds=5).collect()
    best = max(out, key=lambda o: o.f)
    assert best.set_key == "1,3" and best.precision > 0.93 and {o.round for o in out} == {0, 1}


def test_objects_are_sent_as_columns(spark, monkeypatch):
    """Every cell was a row for every set with its type, and every object a row for every set, twice."""
    r = np.random.default_rng(8)
    x = r.normal(size=(120, 6)).round(2).tolist()
    y = [1 if a[1] + a[4] > 0.2 else -1 for a in x]
    x += x[:15]
    y += [-y[0], *y[1:15]]
    cells = spark.createDataFrame([(i, t, v) for i, row in enumerate(x) for t, v in enumerate(row)], "mol_id long, type int, value double")
    labels = spark.createDataFrame(list(enumerate(y)), "mol_id long, y int")
    own = [tuple(o) for o in learn.mgua(cells, labels, range(6), 4, 3, folds=5).collect()]
    held = learn.dense_objects(cells, labels, range(6))
    plan = learn.validated_scores(held, range(6), [(0, 1), (0, 2), (1, 3)], 9, 10, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "set_key" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    monkeypatch.setattr(learn, "dense_objects", lambda *_: None)
    assert [tuple(o) for o in learn.mgua(cells, labels, range(6), 4, 3, folds=5).collect()] == own and len(own) == 8
    monkeypatch.undo()
    for odd in ([(0, 0, 2.0)], [(500, 1, 1.0)], [(500, t, None) for t in range(6)]):
        more = cells.unionByName(spark.createDataFrame(odd, cells.schema))
        assert learn.dense_objects(more, labels.unionByName(spark.createDataFrame([(500, 1)], labels.schema)), range(6)) is None

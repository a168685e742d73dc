"""Learning from the descriptor matrix: conflicts, balancing, folds, losses, linear classifiers, selection of columns.

What is relational is DataFrame code. Linear models are fitted by sums over rows (solvers); linear_svm, kernel_svm and
l0_weights are for small matrices. kernel_cross_validate takes a Gram matrix of any kernel, one task for each block and c.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import count, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetspark.functions.expressions import f_measure
from facetspark.operators import solvers
from facetspark.operators.graph import written
from facetspark.operators.numbering import numbered
from facetspark.operators.solvers import cross_validate, nested_cross_validate, select_l0  # noqa: F401

#: Possible vectors of a descriptor set that are counted where the objects are.
FEW = 256


def delete_conflicts(rows: DataFrame, features: Sequence[str], label: str = "y", tolerance: float | None = None) -> DataFrame:
    """Rows whose features occur with one label only (real labels: within tolerance of each other)."""
    if tolerance is None:
        bad = rows.groupBy(*features).agg(F.count_distinct(label).alias("_n")).where("_n > 1")
    else:
        bad = rows.groupBy(*features).agg((F.max(label) - F.min(label)).alias("_n")).where(F.col("_n") > tolerance)
    bad = bad.select(*[F.col(f).alias(f"_{f}") for f in features])
    same = [rows[f].eqNullSafe(bad[f"_{f}"]) for f in features]
    return rows.join(bad, same, "left_anti")


def check_classes(rows: DataFrame, label: str = "y") -> None:
    """Refuses a set without rows or with one class."""
    n = rows.select(label).distinct().limit(2).count()
    if n < 2:
        raise ValueError("all rows conflict" if n == 0 else "one class is left")


def balance(rows: DataFrame, key: str, label: str = "y") -> DataFrame:
    """rows and as many copies of the minority's rows, cyclic in the order of key, as make the classes equal; copy is 0
    for original rows. Two classes; ties copy nothing."""
    sizes = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count("*")).collect()}  # a row for each class
    if len(sizes) < 2:
        return rows.withColumn("copy", F.lit(0).cast("bigint"))
    minor = min(sizes, key=lambda y: (sizes[y], str(y)))
    m, need = sizes[minor], max(sizes.values()) - sizes[minor]
    ranked = rows.where(F.col(label) == F.lit(minor)).withColumn("_i", F.row_number().over(Window.partitionBy(label).orderBy(key)) - 1)
    times = F.floor((F.lit(need) - F.col("_i") - 1) / m) + 1
    copies = ranked.withColumn("_t", times.cast("bigint")).where("_t > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_t")))).drop("_i", "_t")
    return rows.withColumn("copy", F.lit(0).cast("bigint")).unionByName(copies)


def balanced_folds(rows: DataFrame, key: str, k: int, label: str = "y") -> DataFrame:
    """key, y, n (duplicates), fold: duplicates of a key stay together; groups are dealt round-robin over one rank by
    (label, number of duplicates, key), the counter running on across classes."""
    groups = rows.groupBy(key, label).agg(F.count("*").alias("n"))
    return numbered(groups, [label, "n", key], "fold").withColumn("fold", (F.col("fold") % k).cast("int"))


def zero_one_loss(y: Column, predicted: Column) -> Column:
    return F.sum(F.when(y == predicted, 0).otherwise(1))


def fuzzy_loss(y: Column, predicted: Column, band: float) -> Column:
    """Mistakes count 1, answers within band of 0 count a half."""
    return F.sum(F.when(F.abs(predicted) < band, 0.5).when(F.signum(predicted) == y, 0.0).otherwise(1.0))


def cv_error(folds: DataFrame, loss: str = "loss", n: str = "n") -> DataFrame:
    """Sum of losses over sum of elements."""
    return folds.agg((F.sum(loss) / F.sum(n)).alias("error"))


def balanced_accuracy(rows: DataFrame, label: str = "y", predicted: str = "predicted", *keys: str, weights: dict | None = None) -> DataFrame:
    """Mean of each class's recall, by keys; weights gives classes other weights than 1 in it."""
    recall = rows.groupBy(*keys, label).agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("_recall"))
    weight = F.lit(1.0)
    for k, w in (weights or {}).items():
        weight = F.when(F.col(label) == k, float(w)).otherwise(weight)
    return recall.groupBy(*keys).agg((F.sum(F.col("_recall") * weight) / F.sum(weight)).alias("balanced_accuracy"))


def class_weights(rows: DataFrame, label: str = "y") -> dict:
    """The weight of each class that makes all classes count alike: all rows by classes times its own rows."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    return {k: sum(counts.values()) / (len(counts) * n) for k, n in counts.items()}


def weighted_score(rows: DataFrame, weight: str = "w", score: str = "s") -> DataFrame:
    return rows.agg((F.sum(F.col(weight) * F.col(score)) / F.sum(weight)).alias("score"))


def grid(axes: dict[str, Sequence[float]]) -> list[tuple]:
    """All points of the lattice, the last axis fastest, each with its number."""
    return [(i, *p) for i, p in enumerate(product(*axes.values()))]


def grid_argmin(results: DataFrame, error: str = "error", number: str = "number") -> DataFrame:
    """The row of the least error, the first by number on ties."""
    best = results.agg(F.min_by(F.struct(*results.columns), F.struct(error, number)).alias("b"))
    return best.select("b.*")


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge loss by dual coordinate ascent, in a fixed order."""
    xb = np.hstack([x, np.ones((len(x), 1))])
    q, a, w = (xb * xb).sum(axis=1), np.zeros(len(x)), np.zeros(xb.shape[1])
    for _ in range(rounds):
        before = a.copy()
        for i in range(len(x)):
            g = y[i] * (xb[i] @ w) - 1
            new = min(max(a[i] - g / q[i], 0.0), c)
            w += (new - a[i]) * y[i] * xb[i]
            a[i] = new
        if np.abs(a - before).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def kernel_svm(gram: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 200) -> np.ndarray:
    """Dual coefficients (times labels) on a Gram matrix, whose constant shift takes the bias's place."""
    k, a = gram + 1.0, np.zeros(len(y))
    f = np.zeros(len(y))
    for _ in range(rounds):
        before = a.copy()
        for i in range(len(y)):
            new = min(max(a[i] - (y[i] * f[i] - 1) / k[i, i], 0.0), c)
            f += (new - a[i]) * y[i] * k[i]
            a[i] = new
        if np.abs(a - before).max() < 1e-6:
            break
    return a * y


def l0_weights(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 20, tolerance: float = 1e-3) -> np.ndarray:
    """Multiplicative selection of columns: fit on scaled columns, multiply the scales by the weights' sizes, until they
    stand still; columns that fall below tolerance are 0."""
    z = np.ones(x.shape[1])
    for _ in range(rounds):
        w, _ = linear_svm(x * z, y, c)
        new = z * np.abs(w)
        new[new < tolerance * max(new.max(), 1e-300)] = 0.0
        if np.abs(new - z).max() < tolerance:
            return new
        z = new
        if not z.any():
            break
    return z


def validated_round(cells: DataFrame, labels: DataFrame, sets: Sequence[Sequence[int]], candidates: Sequence[int], keep: int, least: int = 10, folds: int = 5, c: float = 1.0) -> DataFrame:
    """One round of growing descriptor sets: every set with every candidate that it lacks, scored by cross-validation, the
    best `keep` kept: set_key, n, free, precision, recall, f.

    cells(mol_id, type, value) are descriptors; a set's rows are its objects' value vectors. Vectors that occur with both
    labels conflict and are left out; sets with fewer than `least` rows beside them are skipped. Precision is 1 less the
    error of a linear support-vector machine in `folds` folds over the rows that are left, equal rows in one fold and
    dealt in turn by (label, number of rows, vector); recall is precision times the share of rows that don't conflict.

    Equal rows are one row with a weight before any fit, so that a fit holds a set's distinct vectors and not its objects;
    all sets are fitted in one grouped job. The order is by F, then by the set.
    """
    grown = grown_from(sets, candidates)
    types = sorted({int(t) for s in grown for t in s})
    if (dense := dense_objects(cells, labels, types)) is not None:
        return validated_scores(dense, types, grown, keep, least, folds, c)
    return _validated_cells(cells, labels, grown, keep, least, folds, c)


def dense_objects(cells: DataFrame, labels: DataFrame, types: Sequence[int]) -> DataFrame | None:
    """(x, y) of every object that has a label: its values in the order of types and 1 or -1; None if an object with a cell of
    types lacks one, has one twice or a value that is no number."""
    typed = cells.select("mol_id", F.col("type").cast("bigint").alias("type"), F.col("value").cast("double").alias("value")).where(F.col("type").isin([int(t) for t in types]))
    own = typed.groupBy("mol_id").agg(F.sort_array(F.collect_list(F.struct("type", "value"))).alias("own"))
    whole = (F.transform("own", lambda o: o["type"]) == F.array(*[F.lit(int(t)).cast("bigint") for t in sorted(types)])) & ~F.exists("own", lambda o: o["value"].isNull() | F.isnan(o["value"]))
    place = {t: i for i, t in enumerate(sorted(types))}
    x = F.array(*[F.get(F.transform("own", lambda o: o["value"]), F.lit(place[t])) for t in types])
    held = written(own.join(labels.select("mol_id", F.when(F.col("y") > 0, 1).otherwise(-1).alias("y")), "mol_id").select(F.when(whole, x).alias("x"), "y"))
    return held if held.where("x is null").isEmpty() else None


def validated_scores(dense: DataFrame, types: Sequence[int], grown: Sequence[Sequence[int]], keep: int, least: int, folds: int, c: float = 1.0) -> DataFrame:
    """validated_round() over dense_objects(): sets that are grown from one meet in a task, which is sent the columns of that set
    and of what it is grown by, as blocks of numbers; a set's vectors are formed there."""
    spark, place = dense.sparkSession, {int(t): i for i, t in enumerate(types)}
    at_once = max(1, -(-len(grown) // (3 * spark.sparkContext.defaultParallelism)))
    jobs = []  # columns, and the sets by their places among them
    for base, mine in _by_parent([tuple(place[int(t)] for t in s) for s in grown]):
        for first in range(0, len(mine), at_once):
            columns = [*base, *[t for _, t in mine[first : first + at_once]]]
            jobs.append((columns, [(",".join(map(str, grown[i])), [columns.index(place[int(t)]) for t in grown[i]]) for i, _ in mine[first : first + at_once]]))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1) + 0.0, batch.column("y").to_numpy().astype(np.int8).tobytes()
                for number, (columns, _) in enumerate(jobs):
                    yield pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int32()), "x": [np.ascontiguousarray(x[:, columns].T).tobytes()], "y": [y]})

    def validate(table: pa.Table) -> pa.Table:
        columns, sets = jobs[table.column("number")[0].as_py()]
        x = np.concatenate([np.frombuffer(b, float).reshape(len(columns), -1) for b in table.column("x").to_pylist()], axis=1)
        y, out = np.concatenate([np.frombuffer(b, np.int8) for b in table.column("y").to_pylist()]), []
        for key, own in sets:
            order = np.lexsort([x[j] for j in own[::-1]])
            v, label = x[own][:, order], y[order]
            first = np.flatnonzero(np.append(True, (v[:, 1:] != v[:, :-1]).any(axis=0)))
            n, low, high = np.diff(np.append(first, len(label))).astype(float), np.minimum.reduceat(label, first), np.maximum.reduceat(label, first)
            free, wrong, tested = low == high, 0.0, 0.0
            if (some := n[free].sum()) >= least:
                v, label, weight = v[:, first[free]], low[free].astype(float), n[free]
                order = np.lexsort((*v[::-1], weight, label))
                wrong, tested = validation_error(np.ascontiguousarray(v[:, order].T), label[order], weight[order], np.arange(len(order)) % folds, c)
            out.append((key, len(y), int(some), wrong, tested))
        return pa.table(dict(zip(("set_key", "n", "free", "wrong", "tested"), map(pa.array, zip(*out)))))

    sent = dense.mapInArrow(dealt, "number int, x binary, y binary").repartition(len(jobs), "number") if jobs else None
    if sent is None:
        return spark.createDataFrame([], "set_key string, n long, free long, precision double, recall double, f double")
    error = sent.groupBy("number").applyInArrow(validate, "set_key string, n long, free long, wrong double, tested double")
    return _validated_best(error.where((F.col("free") >= least) & (F.col("tested") > 0)), keep)


def _validated_best(scored: DataFrame, keep: int) -> DataFrame:
    """The best sets of scored(set_key, n, free, wrong, tested)."""
    p = 1 - F.col("wrong") / F.col("tested")
    scored = scored.withColumn("precision", p).withColumn("recall", p * F.col("free") / F.col("n"))
    return scored.withColumn("f", f_measure(F.col("precision"), F.col("recall"))).drop("wrong", "tested").orderBy(F.desc("f"), "set_key").limit(keep)


def _by_parent(sets: Sequence[tuple[int, ...]]) -> list[tuple[tuple[int, ...], list[tuple[int, int]]]]:
    """Few sets with one member less that all of sets are grown from, each with (number of the set, the member more): the one
    that most are grown from, then that of the rest."""
    left, work = set(range(len(sets))), []
    of: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for number, s in enumerate(sets):
        for t in s:
            of.setdefault(tuple(x for x in s if x != t), []).append((number, t))
    for base in sorted(of, key=lambda b: (-len(of[b]), b)):
        mine = [(number, t) for number, t in of[base] if number in left]
        if mine:
            work.append((base, mine))
            left -= {number for number, _ in mine}
    return work


def _validated_cells(cells: DataFrame, labels: DataFrame, grown: Sequence[Sequence[int]], keep: int, least: int, folds: int, c: float) -> DataFrame:
    """validated_round() for objects that lack cells or have one twice."""
    spark, names = cells.sparkSession, "set_key string, wrong double, tested double"
    table = spark.createDataFrame([(",".join(map(str, s)), t) for s in grown for t in s], "set_key string, type int")
    vectors = cells.join(table, "type").groupBy("set_key", "mol_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("type", F.col("value").cast("double").alias("value")))), lambda v: v["value"]).alias("vec"))
    own = vectors.join(labels.select("mol_id", F.when(F.col("y") > 0, 1).otherwise(-1).alias("y")), "mol_id")
    by = own.groupBy("set_key", "vec").agg(F.count("*").alias("n"), F.min("y").alias("y"), F.max("y").alias("most"))
    free = by.where("y = most")
    size = by.groupBy("set_key").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("y") == F.col("most"), F.col("n")).otherwise(0)).alias("free"))

    def validate(g: pd.DataFrame) -> pd.DataFrame:
        wrong = tested = 0.0
        if g["n"].sum() >= least:
            x, y, n = np.stack(g["vec"].to_numpy()).astype(float), g["y"].to_numpy(float), g["n"].to_numpy(float)
            order = np.lexsort((*x.T[::-1], n, y))
            wrong, tested = validation_error(x[order], y[order], n[order], np.arange(len(y)) % folds, c)
        return pd.DataFrame([(g["set_key"].iloc[0], wrong, tested)], columns=["set_key", "wrong", "tested"])

    error = free.groupBy("set_key").applyInPandas(validate, names)
    return _validated_best(size.where(F.col("free") >= least).join(error.where("tested > 0"), "set_key"), keep)


def validation_error(x: np.ndarray, y: np.ndarray, n: np.ndarray, fold: np.ndarray, c: float) -> tuple[float, float]:
    """Rows (n of each) that are told wrong, and rows told, when each fold is left out; folds whose other rows are of one
    class are not told."""
    wrong = tested = 0.0
    for k in np.unique(fold):
        train, test = fold != k, fold == k
        if len(set(y[train])) > 1:
            w = solvers.fit(x[train], y[train], c * n[train])
            wrong += n[test][np.where(x[test] @ w[:-1] + w[-1] >= 0, 1.0, -1.0) != y[test]].sum()
            tested += n[test].sum()
    return float(wrong), float(tested)


def objects_of(cells: DataFrame, labels: DataFrame, types: Sequence[int]) -> DataFrame:
    """positive (whether the label is above 0), own (the object's values by type, as a map) of every object that has a label
    and a cell of types: one row for each, that all sets are read from."""
    typed = cells.select("mol_id", F.col("type").cast("bigint").alias("type"), "value").where(F.col("type").isin([int(t) for t in types]))
    by_type = typed.repartition("mol_id").groupBy("mol_id", "type").agg(F.sort_array(F.collect_list(F.struct("value"))).alias("value"))
    own = by_type.groupBy("mol_id").agg(F.map_from_entries(F.collect_list(F.struct("type", "value"))).alias("own"))
    return own.join(labels.select("mol_id", (F.col("y") > 0).alias("positive")), "mol_id").select("positive", "own")


def grown_from(sets: Sequence[Sequence[int]], candidates: Sequence[int]) -> list[tuple[int, ...]]:
    """Every set with every candidate that it lacks."""
    return sorted({tuple(sorted({*s, t})) for s in sets for t in candidates if t not in s})


def mgua_round(cells: DataFrame, labels: DataFrame, sets: Sequence[Sequence[int]], candidates: Sequence[int], keep: int, least: int = 10) -> DataFrame:
    """One round of growing descriptor sets: every set with every candidate that it lacks, scored, the best `keep` kept.

    cells(mol_id, type, value) are binary-coded descriptors. A set's rows are its objects' value vectors; precision is 1
    less the error of predicting each vector's majority label, recall is precision times the share of rows that don't
    conflict, and sets with fewer than `least` rows free of conflicts are skipped. All sets are scored in one grouped
    job; the order is by F, then by the set.
    """
    grown = grown_from(sets, candidates)
    return majority_scores(objects_of(cells, labels, sorted({t for s in grown for t in s})), grown, keep, least)


def majority_scores(objects: DataFrame, grown: Sequence[Sequence[int]], keep: int, least: int) -> DataFrame:
    """mgua_round() over objects_of(): an object's vector of each set is formed where the object is and counted there, so that
    a shuffle has the distinct vectors of a task and not every object once for each set."""
    table = objects.sparkSession.createDataFrame([(",".join(map(str, s)), list(s)) for s in grown], "set_key string, types array<bigint>")
    vec = F.transform("types", lambda t: F.element_at("own", t))
    vectors = objects.crossJoin(F.broadcast(table)).select("set_key", vec.alias("vec"), "positive").where(F.exists("vec", lambda v: v.isNotNull()))
    by = vectors.groupBy("set_key", "vec").agg(F.count("*").alias("n"), F.sum(F.col("positive").cast("int")).alias("pos"))
    pure = (F.col("pos") == 0) | (F.col("pos") == F.col("n"))
    s = by.groupBy("set_key").agg(F.sum("n").alias("n"), F.sum(F.when(pure, F.col("n")).otherwise(0)).alias("free"), F.sum(F.least("pos", F.col("n") - F.col("pos"))).alias("wrong"))
    return _best_of(s, keep, least)


def _best_of(s: DataFrame, keep: int, least: int) -> DataFrame:
    """The best sets of s(set_key, n, free, wrong)."""
    p = 1 - F.col("wrong") / F.col("n")
    scored = s.where(F.col("free") >= least).withColumn("precision", p).withColumn("recall", p * F.col("free") / F.col("n"))
    return scored.withColumn("f", f_measure(F.col("precision"), F.col("recall"))).orderBy(F.desc("f"), "set_key").limit(keep)


def coded_objects(objects: DataFrame, types: Sequence[int]) -> tuple[DataFrame, list[int]] | None:
    """(codes, n, pos) of the distinct objects of objects_of(), a byte for each of types (0: no cell), and how many codes
    each type has; None if a type has more values than a byte tells apart."""
    cells = objects.select(F.explode("own").alias("type", "value"))
    values = cells.distinct().withColumn("code", F.row_number().over(Window.partitionBy("type").orderBy("value")))
    counted = {r["type"]: r["n"] for r in cells.groupBy("type").agg(F.count_distinct("value").alias("n")).collect()}
    if max(counted.values(), default=0) > 255:
        return None
    # At most 255 rows for each type.
    book = values.select("type", F.struct("value", "code").alias("entry")).groupBy("type").agg(F.map_from_entries(F.collect_list("entry")).alias("code"))
    of = book.agg(F.map_from_entries(F.collect_list(F.struct("type", "code"))).alias("book"))
    code = F.transform(F.array(*[F.lit(int(t)).cast("bigint") for t in types]), lambda t: F.coalesce(F.element_at(F.element_at("book", t), F.element_at("own", t)), F.lit(0)))
    coded = objects.crossJoin(F.broadcast(of)).select(code.alias("codes"), "positive")
    same = coded.groupBy("codes").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("positive").cast("int")), F.lit(0)).cast("bigint").alias("pos"))
    return same, [counted.get(int(t), 0) + 1 for t in types]


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return batch.column("codes").flatten().to_numpy().astype(np.uint8).reshape(batch.num_rows, -1), batch.column("n").to_numpy(), batch.column("pos").to_numpy()


def refined_scores(objects: DataFrame, sizes: Sequence[int], types: Sequence[int], grown: Sequence[Sequence[int]], keep: int, least: int) -> DataFrame:
    """majority_scores() over coded_objects(): a grown set splits the vectors of a set with one descriptor less. Those sets
    are as few as were kept, and objects with equal vectors of one meet, each once for all its descriptors.

    A set with few possible vectors has them counted where the objects are; of others, the objects of a vector fit a task.
    """
    spark, place = objects.sparkSession, {int(t): i for i, t in enumerate(types)}
    work = _by_parent([tuple(place[t] for t in s) for s in grown])
    few = [(base, mine) for base, mine in work if np.prod([float(sizes[i]) for i in base]) <= FEW]
    many = [(base, mine) for base, mine in work if np.prod([float(sizes[i]) for i in base]) > FEW]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n, pos = _matrix(batch)
            for base, mine in few:
                own = np.zeros(len(x), np.int64)
                for i in base:
                    own = own * sizes[i] + x[:, i]
                for number, t in mine:
                    key = own * sizes[t] + x[:, t]
                    all_, own_pos = np.bincount(key, n), np.bincount(key, pos)
                    at = np.flatnonzero(all_[1:]) + 1  # 0: no cell of the set
                    yield pa.RecordBatch.from_pydict({"number": np.full(len(at), number, np.int32), "key": at, "n": all_[at].astype(np.int64), "pos": own_pos[at].astype(np.int64)})

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n, pos = _matrix(batch)
            whole = pa.array(list(map(bytes, x)), pa.binary())
            for b, (base, _) in enumerate(many):
                keys = pa.array(list(map(bytes, x[:, base])), pa.binary())
                yield pa.RecordBatch.from_pydict({"base": np.full(len(x), b, np.int32), "key": keys, "whole": whole, "n": n, "pos": pos})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(batch.column("base").to_numpy(), np.frombuffer(b"".join(batch.column("whole").to_pylist()), np.uint8).reshape(batch.num_rows, -1), batch.column("n").to_numpy(), batch.column("pos").to_numpy()) for batch in batches if batch.num_rows]
        if not parts:
            return
        bases, x, n, pos = map(np.concatenate, zip(*parts))
        out = []
        for b in np.unique(bases):
            rows, (base, mine) = np.flatnonzero(bases == b), many[b]
            held = np.ascontiguousarray(x[rows][:, base])
            _, group = np.unique(held.view(f"V{len(base)}").ravel(), return_inverse=True)
            known = held.any(axis=1)
            for number, t in mine:
                c = x[rows, t]
                use = known | (c > 0)
                key = group[use] * sizes[t] + c[use]
                all_, own = np.bincount(key, n[rows][use]), np.bincount(key, pos[rows][use])
                out.append((number, int(all_.sum()), int(all_[(own == 0) | (own == all_)].sum()), int(np.minimum(own, all_ - own).sum())))
        yield pa.RecordBatch.from_pydict(dict(zip(("number", "n", "free", "wrong"), map(np.array, zip(*out)))), pa.schema([("number", pa.int32()), ("n", pa.int64()), ("free", pa.int64()), ("wrong", pa.int64())]))

    sums = []
    if few:
        by = objects.mapInArrow(counted, "number int, key long, n long, pos long").groupBy("number", "key").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
        pure = (F.col("pos") == 0) | (F.col("pos") == F.col("n"))
        sums.append(by.select("number", "n", F.when(pure, F.col("n")).otherwise(0).alias("free"), F.least("pos", F.col("n") - F.col("pos")).alias("wrong")))
    if many:
        met = objects.mapInArrow(dealt, "base int, key binary, whole binary, n long, pos long").repartition(max(objects.rdd.getNumPartitions(), 3 * spark.sparkContext.defaultParallelism), "base", "key")
        sums.append(met.select("base", "whole", "n", "pos").mapInArrow(split, "number int, n long, free long, wrong long"))
    names = spark.createDataFrame([(i, ",".join(map(str, s))) for i, s in enumerate(grown)], "number int, set_key string")
    all_sums = sums[0] if len(sums) == 1 else sums[0].unionByName(sums[1])
    total = all_sums.groupBy("number").agg(*[F.sum(c).alias(c) for c in ("n", "free", "wrong")])
    return _best_of(total.join(F.broadcast(names), "number").drop("number"), keep, least)


def mgua(cells: DataFrame, labels: DataFrame, descriptors: Sequence[int], keep: int, max_rounds: int | None = 10, least: int = 10, good: float = 0.5, folds: int | None = None) -> DataFrame:
    """round, set_key, precision, recall, f: mgua_round (with folds: validated_round) from the empty set, round by round, each from the best `keep` sets
    of the one before, until the best F no longer grows, no descriptor is left or max_rounds (None: any number) are done; the
    rounds up to the best one.

    After the first round only descriptors whose own precision is at least good, or that had too few rows free of
    conflicts to judge, are candidates.
    """
    spark, sets, candidates, out, best = cells.sparkSession, [[]], list(descriptors), [], -1.0
    types = list(candidates)
    # Read by every round, each object once for each set: small rows and much work, so over more tasks than their bytes ask for.
    objects = None if folds else written(objects_of(cells, labels, candidates).repartition(3 * spark.sparkContext.defaultParallelism))
    dense = dense_objects(cells, labels, types) if folds else None
    coded = None if folds else coded_objects(objects, types)
    if coded:
        coded = written(coded[0].repartition(3 * spark.sparkContext.defaultParallelism)), coded[1]
    for number in count() if max_rounds is None else range(max_rounds):
        most, grown = keep if number else len(candidates), grown_from(sets, candidates)
        if not grown:
            break
        if dense is not None:
            step = validated_scores(dense, types, grown, most, least, folds)
        elif folds:
            step = validated_round(cells, labels, sets, candidates, most, least, folds)
        else:
            step = refined_scores(*coded, types, grown, most, least) if coded else majority_scores(objects, grown, most, least)
        found = [r.asDict() for r in step.collect()]
        if not found or found[0]["f"] <= best:
            break
        if number == 0:
            judged = {int(r["set_key"]): r["precision"] for r in found}
            candidates = [t for t in candidates if judged.get(t, 1.0) >= good]
        best, found = found[0]["f"], found[:keep]
        out += [(number, r["set_key"], r["precision"], r["recall"], r["f"]) for r in found]
        sets = [[int(t) for t in r["set_key"].split(",")] for r in found]
    return spark.createDataFrame(out, "round int, set_key string, precision double, recall double, f double")


def pca_variance(rows: DataFrame, k: int) -> DataFrame:
    """component, explained: the share of variance of the first k principal components of rows(x array).

    Sums of products are taken in the JVM by Spark's own row matrix.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    model = PCA(k=k, inputCol="v", outputCol="p").fit(rows.select(array_to_vector("x").alias("v")))
    return rows.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(model.explainedVariance)], "component int, explained double")


def running_activity(predictions: DataFrame) -> DataFrame:
    """mol_id, activity: the sum of predictions over runs."""
    return predictions.groupBy("mol_id").agg(F.sum("activity").alias("activity"))


def kernel_cross_validate(gram: DataFrame, labels: DataFrame, cs: Sequence[float], within: Sequence[str] = ()) -> DataFrame:
    """number, c, n, loss of kernel SVMs over gram(m1, m2, k), both triangles given, and labels(mol_id, y, fold); one of
    each for every block that columns within of the labels name.

    A Gram matrix is one task's work for each c, so it is for as many objects as its square fits a task.
    """
    a = labels.select(F.col("mol_id").alias("m1"), F.col("y").alias("y1"), F.col("fold").alias("f1"), *within)
    cells = gram.join(a, "m1").join(labels.select(F.col("mol_id").alias("m2")), "m2")
    jobs = gram.sparkSession.createDataFrame(grid({"c": [float(c) for c in cs]}), "number int, c double")

    def one(g: pd.DataFrame) -> pd.DataFrame:
        k = g.pivot(index="m1", columns="m2", values="k").sort_index().fillna(0.0)
        who = g.drop_duplicates("m1").set_index("m1").loc[k.index]
        k, y, fold = k[k.index].to_numpy(), who["y1"].to_numpy(float), who["f1"].to_numpy()
        loss = 0
        for f in np.unique(fold):
            train_, test = fold != f, fold == f
            if len(set(y[train_])) > 1:
                a_ = kernel_svm(k[np.ix_(train_, train_)], y[train_], g["c"].iloc[0])
                loss += int((np.where((k[np.ix_(test, train_)] + 1) @ a_ >= 0, 1.0, -1.0) != y[test]).sum())
        return pd.DataFrame([(*[g[c].iloc[0] for c in within], g["number"].iloc[0], g["c"].iloc[0], len(y), loss)], columns=[*within, "number", "c", "n", "loss"])

    blocks = "".join(f"{c} {labels.schema[c].dataType.simpleString()}, " for c in within)
    return cells.join(F.broadcast(jobs)).groupBy(*within, "number").applyInPandas(one, blocks + "number int, c double, n long, loss long")

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetspark.llm import toxicity

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def invented(n, seed=3):
    """Texts of which a fifth hold a few telling words, and their labels."""
    g, docs, labels = random.Random(seed), [], []
    own = ["".join(g.choice("abdefgilmnorstu") for _ in range(g.randrange(2, 9))) for _ in range(300)]
    for i in range(n):
        words = [g.choice(own) for _ in range(g.randrange(20, 60))]
        toxic = int(g.random() < 0.2)
        if toxic:
            for _ in range(3):
                words.insert(g.randrange(len(words)), g.choice(["Quatsch", "zackzacker", "zackzacken", "pfuipfui"]) + g.choice(["", "!", ","]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return docs, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.mark.parametrize("block", [2, 16, 1000])
def test_nearest_are_those_of_all_pairs(block):
    g = random.Random(block)
    idf = np.array([math.log(200 / (1 + i)) for i in range(40)])
    vector = lambda: (lambda t: (t, [g.randrange(1, 5) for _ in t]))(sorted(g.sample(range(40), g.randrange(0, 7))))
    rows = [(i, i % 2, *vector()) for i in range(300)]
    rows += [(i + 300, 1, *rows[i][2:]) for i in range(40)]
    index = toxicity.Index(rows, idf, block)
    dense = np.zeros((len(index.ids), 40))
    of = {r[0]: r for r in rows}
    for e, i in enumerate(index.ids):
        t, n = np.array(of[i][2], int), np.array(of[i][3], int)
        dense[e, t] = toxicity.weighted(t, n, idf)
    less = 0
    for _ in range(200):
        t, n = map(np.array, vector())
        best, cosine, visited = index.nearest(t.astype(int), n, 15, without=None)
        less += visited < index.blocks
        q = np.zeros(40)
        if len(t):
            q[t] = toxicity.weighted(t, n, idf)
        exact = dense @ q
        want = sorted((e for e in range(len(exact)) if exact[e] > 0), key=lambda e: (-exact[e], e))[:15]
        assert np.allclose(cosine, exact[want]) and np.allclose(exact[best], cosine)
        assert set(best) == set(want) or np.isclose(exact[want[-1]], exact[list(set(best) ^ set(want))]).all()
    assert block == 1000 or less > 0


def test_isotonic_steps():
    at, score = toxicity.isotonic([(0.1, 10, 0), (0.2, 10, 3), (0.3, 10, 1), (0.9, 10, 9)])
    assert at.tolist() == [0.1, 0.2, 0.9] and (np.diff(score) >= 0).all()
    assert score.tolist() == pytest.approx([(0 + 13 / 40) / 11, (4 + 13 / 40) / 21, (9 + 13 / 40) / 11])
    assert toxicity.isotonic([])[1].tolist() == [0.5]


def test_held_out_documents_are_told_apart(spark):
    docs, labels = invented(600)
    out = toxicity.score(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    truth = {i: t for i, _, t in labels}
    assert len(out) == 600 and all(r.held_out == held(r.doc_id) for r in out)
    tested = [r for r in out if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in tested]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert not any(held(x.doc_id) for r in out for x in r.evidence)
    assert all(truth[x.doc_id] == x.toxic for r in out for x in r.evidence)


def test_labels_of_held_out_documents_play_no_part(spark):
    docs, labels = invented(200)
    d = spark.createDataFrame(docs, DOCS)
    flipped = [(i, q, 1 - t if held(i) else t) for i, q, t in labels]
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score(d, spark.createDataFrame(x, LABELS)).collect()) for x in (labels, flipped))
    assert a == b


def test_nulls_empty_and_long_texts_and_repeats(spark):
    docs, labels = invented(200)
    extra = [(1000, None), (1001, ""), (1002, "..."), (None, docs[0][1]), (None, None), (1003, "quatsch " * 100_000), (3, docs[3][1]), (3, "anders")]
    marks = labels + [(None, 1, 1), (5, 1, 1 - labels[5][2]), (7, 1, None), (4000, 1, 1)]
    out = toxicity.score(spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame(marks, LABELS)).collect()
    assert len(out) == 208
    none = {r.score for r in out if r.doc_id in (1000, 1001, 1002)}
    assert len(none) == 1 and all(r.evidence == [] for r in out if r.doc_id in (1000, 1001, 1002))
    assert {r.held_out for r in out if r.doc_id is None} == {False}
    assert not {5, 7, None} & {x.doc_id for r in out for x in r.evidence}
    assert len({r.score for r in out if r.doc_id == 3}) <= 2


def test_equal_texts_have_equal_scores(spark):
    docs, labels = invented(200)
    copies = [(i + 5000, t) for i, t in docs]
    out = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(docs + copies, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert all(out[i] == out[i + 5000] for i, _ in docs)


def test_without_examples_or_documents(spark):
    docs, labels = invented(20)
    no_labels, no_docs = spark.createDataFrame([], LABELS), spark.createDataFrame([], DOCS)
    assert {r.score for r in toxicity.score(spark.createDataFrame(docs, DOCS), no_labels).collect()} == {0.5}
    assert toxicity.score(no_docs, spark.createDataFrame(labels, LABELS)).collect() == []
    one = spark.createDataFrame([(i, q, 0) for i, q, _ in labels], LABELS)
    assert all(r.score < 0.5 for r in toxicity.score(spark.createDataFrame(docs, DOCS), one).collect())


def test_other_columns_play_no_part(spark):
    docs, labels = invented(60)
    d, m = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    more = d.withColumns({c: F.lit(1) for c in ("toxic", "h", "terms", "times", "score", "lang")})
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score(x, y).collect()) for x, y in ((d, m), (more, m.withColumn("text", F.lit("x")))))
    assert a == b

"""Toxicity: nearest labelled examples by exact TF-IDF cosine, found with block-max inverted indexes.

Examples are at most `EXAMPLES` labelled documents, those with the least hash of their doc_id, none of them held out. The
features of a text are its lower-cased words and the words' prefixes of `PREFIXES` characters (inflected words share
them). The vocabulary holds the features that go with a label among the examples (chi-square of `LEAST_CHI` or more, at
most `VOCABULARY` of them, the strongest first), so that near examples are alike in what the label depends on.

Each document becomes a short vector over the vocabulary, (1 + ln tf) idf, of length 1; idf is counted over all documents.
The index lists for each feature the examples that hold it, cut into blocks of `BLOCK` example numbers with the largest
weight of each. A query's bound for a block is the sum of its features' largest weights there; blocks are visited from
the highest bound down until no bound reaches the `NEAREST`-th cosine found. So the nearest are exact: the rest can't be.

The nearest examples vote with the square of their cosine, against `PRIOR` votes at the examples' share of label 1. Votes
become scores by isotonic regression on the examples' own votes, each without itself, so that a score is a share of label
1. A score's evidence is its examples with their cosines and labels.

Defined results: a null or empty text, or one without features of the vocabulary, has the score of no votes; a document
is scored by its text alone, so rows of equal texts have equal scores; a doc_id that is null, or whose labels disagree or
are null, is no example; of several texts of one doc_id the one with the least hash is the example; equal cosines are
taken by example number; without examples every score is 0.5; an empty table gives an empty table; only doc_id and text,
and doc_id and toxic of the labels, are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetspark.llm.common import as_documents, checked_broadcast, drop_staged, parts, releasing, stage
from facetspark.llm.importance import split_words

#: Labelled documents that become examples, at most: the index and the vocabulary are bounded by it.
EXAMPLES = 16_384
VOCABULARY = 2048
LEAST_CHI = 8.0
LEAST_HOLDERS = 4
PREFIXES = (5, 6, 7)
BLOCK = 128
NEAREST = 15
PRIOR = 0.5
#: A score from here on predicts label 1.
THRESHOLD = 0.7
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def text_features(text: str | None) -> Counter:
    """The features of a text with their numbers; a prefix ends in ~, which no word holds."""
    words = Counter(_WORD.findall((text or "").translate(_UPPER)))
    out = Counter(words)
    for w, n in words.items():
        for k in PREFIXES:
            if len(w) > k:
                out[w[:k] + "~"] += n
    return out


def example_ids(labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """doc_id and toxic of the labelled documents that become examples."""
    own = as_documents(labels, ["doc_id", "toxic"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    one = own.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"), F.count_if(F.col("toxic").isNull()).alias("unknown"))
    clear = one.where("toxic = most and unknown = 0 and toxic in (0, 1)").select("doc_id", "toxic")
    return clear.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)


def choose_features(texts: DataFrame, most: int = VOCABULARY, least: float = LEAST_CHI) -> list[str]:
    """The features of texts(text, toxic) that go with a label, the strongest first."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in text_features(text):
                    found.setdefault(f, [0, 0])[toxic] += 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found)), *(pa.array([n[k] for n in found.values()], pa.int64()) for k in (0, 1))], ["f", "n0", "n1"])

    all0, all1 = texts.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    if not all0 or not all1:
        return []
    held = texts.select("text", "toxic").mapInArrow(run, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").cast("double").alias("a"), F.sum("n1").cast("double").alias("b"))
    a, b, n = F.col("a"), F.col("b"), float(all0 + all1)
    chi = n * (b * (all0 - a) - a * (all1 - b)) * (b * (all0 - a) - a * (all1 - b)) / ((a + b) * (n - a - b) * float(all0) * float(all1))
    rated = held.where((a + b >= LEAST_HOLDERS) & (a + b < n)).select("f", F.round(chi, 6).alias("chi")).where(F.col("chi") >= least)
    return [r["f"] for r in rated.orderBy(F.desc("chi"), "f").limit(most).collect()]  # at most VOCABULARY rows


def count_terms(texts: list[bytes], number: dict[str, int]) -> tuple[pa.Array, pa.Array]:
    """For each text the numbers of its features in the vocabulary, ascending, and how often it holds them."""
    words, of = split_words(texts)
    codes = words.dictionary_encode()
    word, term = [], []
    for i, w in enumerate(codes.dictionary.to_pylist()):
        for f in (w, *(w[:k] + "~" for k in PREFIXES if len(w) > k)):
            if f in number:
                word.append(i)
                term.append(number[f])
    # Words with features, a row for each feature: where a word's rows start, and how many they are.
    word, term = np.array(word, np.int64), np.array(term, np.int64)
    start = np.searchsorted(word, np.arange(len(codes.dictionary) + 1))
    own = codes.indices.to_numpy().astype(np.int64)
    n = start[own + 1] - start[own]
    at = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    cell, count = np.unique(np.repeat(of, n).astype(np.int64) * max(len(number), 1) + term[at], return_counts=True)
    ends = np.searchsorted(cell, np.arange(len(texts) + 1) * max(len(number), 1)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (cell % max(len(number), 1), count)]
    return lists[0], lists[1]


def vectors(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, h (a hash of the text), terms (numbers in the vocabulary, ascending) and times, a row for each document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({f: i for i, f in enumerate(vocabulary)})

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            terms, times = count_terms([(t.as_py() or "").encode() for t in batch.column(2)], shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), terms, times], ["doc_id", "h", "terms", "times"])

    own = as_documents(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return own.mapInArrow(run, "doc_id long, h long, terms array<int>, times array<int>")


@releasing
def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of a task hold each term."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        own = np.bincount(batch.column(0).flatten().to_numpy())
        total = np.pad(total, (0, max(0, len(own) - len(total))))
        total[: len(own)] += own
    if len(total):
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["t", "n"])


def weighted(terms: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The weights of a vector of length 1."""
    w = (1 + np.log(times)) * idf[terms]
    size = math.sqrt(float((w * w).sum()))
    return w / size if size else w


class Index:
    """Examples by feature, in blocks with their largest weights."""

    def __init__(self, rows: list[tuple[int, int, list[int], list[int]]], idf: np.ndarray, block: int = BLOCK):
        rows = sorted(rows, key=lambda r: (r[2], r[0]))  # examples with the same features stand together: tighter bounds
        self.ids, self.toxic, self.idf, self.block = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), idf, block
        self.blocks = max(1, -(-len(rows) // block))
        own = [weighted(np.array(t, np.int64), np.array(n, np.int64), idf) for _, _, t, n in rows]
        term = np.concatenate([np.array(r[2], np.int64) for r in rows] or [np.zeros(0, np.int64)])
        example = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows]) if rows else term
        weight = np.concatenate(own or [np.zeros(0)])
        order = np.lexsort((example, term))
        self.example, self.weight, term = example[order], weight[order], term[order]
        cell = term * self.blocks + self.example // block
        #: Where the examples of each (feature, block) start.
        self.starts = np.searchsorted(cell, np.arange(len(idf) * self.blocks + 1))
        self.largest = np.zeros(len(idf) * self.blocks)
        np.maximum.at(self.largest, cell, self.weight)
        self.largest = self.largest.reshape(len(idf), self.blocks)

    def cosines(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """The cosines of a vector with all examples of blocks, block by block."""
        cell = (terms[:, None] * self.blocks + blocks).ravel()
        lo, n = self.starts[cell], self.starts[cell + 1] - self.starts[cell]
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shift = np.tile(np.arange(len(blocks)) * self.block - blocks * self.block, len(terms))
        return np.bincount(self.example[at] + np.repeat(shift, n), weights=self.weight[at] * np.repeat(np.repeat(weights, len(blocks)), n), minlength=len(blocks) * self.block)

    def nearest(self, terms: np.ndarray, times: np.ndarray, k: int = NEAREST, without: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(examples, cosines, blocks visited): the k examples of the highest cosines above 0, ties by number; `without`
        is a doc_id that is left out."""
        none = np.zeros(0, np.int64), np.zeros(0), 0
        if not len(terms):
            return none
        w = weighted(terms, times, self.idf)
        bound = w @ self.largest[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best, cosine, at, step = none[0], none[1], 0, 4
        while at < len(order):
            visit = order[at : at + step]
            if len(best) == k:
                visit = visit[bound[visit] * (1 + 1e-9) >= cosine[-1]]
                if not len(visit):
                    break
            value = self.cosines(terms, w, visit)
            own = np.flatnonzero(value > (cosine[-1] * (1 - 1e-12) if len(best) == k else 0))
            found, value = visit[own // self.block] * self.block + own % self.block, value[own]
            if without is not None:
                keep = self.ids[found] != without
                found, value = found[keep], value[keep]
            found, value = np.concatenate((best, found)), np.concatenate((cosine, value))
            top = np.lexsort((found, -value))[:k]
            best, cosine, at, step = found[top], value[top], at + step, step * 2
        return best, cosine, min(at, len(order))

    def vote(self, best: np.ndarray, cosine: np.ndarray) -> float:
        share = float(self.toxic.mean()) if len(self.toxic) else 0.5
        w = cosine * cosine
        return float(((w * self.toxic[best]).sum() + PRIOR * share) / (w.sum() + PRIOR))


def isotonic(votes: list[tuple[float, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(vote, rows, rows of label 1) in order of votes to steps: the least vote and the score of each.

    Neighbours whose shares fall are pooled; a pool's share takes one row at the whole share along, so that none is 0 or 1."""
    n, pos = sum(v[1] for v in votes), sum(v[2] for v in votes)
    pools: list[list[float]] = []
    for vote, rows, ones in sorted(votes):
        pools.append([vote, rows, ones])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            _, rows_, ones_ = pools.pop()
            pools[-1][1] += rows_
            pools[-1][2] += ones_
    score = [(ones + pos / n) / (rows + 1) for _, rows, ones in pools] if n else [0.5]
    return np.array([p[0] for p in pools] or [0.0]), np.maximum.accumulate(score)


class Model:
    """A vocabulary, an index and the steps that turn votes into scores."""

    def __init__(self, vocabulary: list[str], index: Index, steps: tuple[np.ndarray, np.ndarray]):
        self.vocabulary, self.index, self.steps = vocabulary, index, steps

    def score(self, vote: float) -> float:
        return float(self.steps[1][max(0, np.searchsorted(self.steps[0], round(vote, 6), side="right") - 1)])


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> tuple[Model, DataFrame]:
    """The model, and the vectors of all documents, written."""
    spark = docs.sparkSession
    ids = stage(example_ids(labels, examples), "examples")
    texts = as_documents(docs, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("long"))
    known = texts.join(checked_broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    known = stage(known, "example_texts")
    vocabulary = choose_features(known)
    drop_staged(known)
    rows = stage(vectors(docs, vocabulary), "vectors")
    n = rows.count()
    held = rows.select("terms").mapInArrow(_holders, "t int, n long").groupBy("t").agg(F.sum("n"))
    holders = {r[0]: r[1] for r in held.collect()}  # at most VOCABULARY rows
    idf = np.array([math.log((n + 1) / (holders.get(i, 0) + 0.5)) for i in range(len(vocabulary))])
    own = rows.join(checked_broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by(F.struct("terms", "times"), "h").alias("v"))
    own = stage(own.select("doc_id", "toxic", "v.terms", "v.times"), "example_vectors")
    drop_staged(ids)
    index = Index([(r["doc_id"], r["toxic"], r["terms"], r["times"]) for r in own.collect()], idf)  # at most EXAMPLES rows
    shared = spark.sparkContext.broadcast(index)

    @releasing
    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(round(shared.value.vote(*shared.value.nearest(np.array(t, np.int64), np.array(m, np.int64), without=i)[:2]), 6), y) for i, y, t, m in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in out], pa.float64()), pa.array([y for _, y in out], pa.int32())], ["vote", "toxic"])

    each = own.repartition(2 * spark.sparkContext.defaultParallelism).mapInArrow(votes, "vote double, toxic int")
    steps = isotonic([tuple(r) for r in each.groupBy("vote").agg(F.count("*").alias("n"), F.sum("toxic").alias("ones")).collect()])  # at most EXAMPLES rows
    drop_staged(own)
    return Model(vocabulary, index, steps), rows


def score(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, and evidence: the nearest examples with cosine and label, nearest first."""
    model, rows = fit(docs, labels, examples)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        known: dict[bytes, tuple] = {}
        for batch in batches:
            scores, why = [], []
            for terms, times in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                t, n = np.array(terms, np.int64), np.array(times, np.int64)
                key = t.tobytes() + n.tobytes()
                if key not in known:
                    best, cosine, _ = m.index.nearest(t, n)
                    known[key] = m.score(m.index.vote(best, cosine)), [{"doc_id": int(m.index.ids[e]), "cosine": c, "toxic": int(m.index.toxic[e])} for e, c in zip(best, cosine.tolist())]
                scores.append(known[key][0])
                why.append(known[key][1])
            if len(known) > 4096:
                known = {}
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(why, evidence)], ["doc_id", "score", "evidence"])

    out = rows.select("doc_id", "terms", "times").mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double, toxic: int>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "evidence")

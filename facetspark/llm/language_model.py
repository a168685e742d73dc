"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, over pairs of words.

Words are what white space separates, as they are; marks before the first and behind the last word count as words.

Training. Half of the trusted documents, drawn by a hash of the document, gives the counts of all its pairs, summed on
the map side and then by language and pair, so that the model grows with the corpus; joined with the counts of their first words (as contexts) and with the continuation counts of their second words (how
many different words stand before), they give probabilities. Either order has, by language, three discounts of its own,
estimated from its counts of counts.

Scoring. The log-probability of a document is a sum over its words and pairs: with the weights

    word w: log(share that w as a context leaves to single words) + log p(w) - log p(unknown word)
    pair vw: log p(w after v) - log(share that v leaves) - log p(w)

all that no count knows weighs 0, and every word adds log p(unknown word). So each document is joined, as counts, with
the weights of its words and pairs. The commonest of these, at most `HOT`, are broadcast, which leaves no hot key to the
join; the rest is dealt into shards of about `SHARD` weights each, and a filter of fixed size, broadcast too, leaves out
most keys that no shard has. A task packs, for each shard, the keys of a block of documents (four bytes each; with the shard they tell the key up to one chance in 16,000 that a key unknown to the model
is taken for another). Sorted behind its shard's weights, a pack becomes partial sums, which are added up by block.
Shards are dealt over as many tasks as the input has parts, so that their size doesn't grow with the corpus; all
documents are scored, over whole texts.

Limits. Perplexity is the exponential of the mean negative log-likelihood of a word. The mean of few words varies more,
so limits are set to the mean over the document and `PRIOR` words of its language's average. They are quantiles by
language, on scores rounded to 0.001 nats, and a margin: the upper one of trusted documents that the model hasn't seen,
the lower one (repeated words are all too likely) of all trusted ones, as copies of those it has seen may come. A
document beyond one is rejected.

Defined results: a null or empty text, or one of white space, has no perplexity and is rejected; a null language is one
of its own, ""; a language without trusted documents, or with all of them drawn, keeps its documents; labels may repeat and carry nulls (a document
is trusted if some row with its doc_id has quality 1); equal rows stay separate rows in classify(), and keep_good()
drops all rows of a doc_id of which one row is rejected, but for a null doc_id, whose rows stay; an empty table gives an
empty table; only doc_id, text and lang, and doc_id and quality of the labels, are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetspark.llm.common import as_documents, checked_broadcast, column, drop_staged, parts, release_memory, releasing, stage

#: Share of the trusted documents from which the model is counted; the others set the upper limits.
TRAINING_SHARE = 0.5
#: Quantiles of the trusted documents' scores between which documents are kept, and nats added on either side.
QUANTILE = 0.999
MARGIN = 0.05
#: Average words that a document's score has besides its own.
PRIOR = 20
#: Weights that are broadcast (12 bytes each), and weights in a shard.
HOT = 1 << 19
SHARD = 1 << 18
TRUSTED_ROWS = 4_000_000
#: A bit for each key by its first bits, 8 MB in all, tells most keys that the shards don't have.
FILTER_BITS = 26
#: Documents in a block.
BLOCK = 500
#: Least discount, so that every context leaves a share to words not seen in it.
LEAST_DISCOUNT = 0.05
#: Fixed odd multipliers of the keys.
_MIX = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)))


def _texts(docs: DataFrame) -> DataFrame:
    return as_documents(docs, ["doc_id", "text", "lang"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return as_documents(labels, ["doc_id", "quality"]).where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def numbers(text: str, lang: str) -> np.ndarray:
    """The words of a text in its language as 64-bit numbers, between those of the two marks."""
    words, seed, digest = text.split(), zlib.crc32(lang.encode()), xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in ("\n", *words, "\n\n")), np.uint64, len(words) + 2)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[2]
    return x ^ (x >> np.uint64(29))


def word_keys(w: np.ndarray) -> np.ndarray:
    return _mixed(w * _MIX[0])


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mixed(v * _MIX[0] + w * _MIX[1] + np.uint64(1))


def drawn(df: DataFrame, share: float, yes: bool = True) -> DataFrame:
    """The rows of df(doc_id, ...) that a hash draws for training, or those that it doesn't."""
    hit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    return df.where(hit if yes else ~hit)


def count_pairs(texts: DataFrame) -> DataFrame:
    """lang, v, w, cnt: the pairs of neighbouring words in texts(text, lang)."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = numbers(text, lang).view(np.int64)
                if len(own) > 2:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(own) - 1), pa.string()), pa.array(own[:-1]), pa.array(own[1:])], ["lang", "v", "w"])

    return texts.select("text", "lang").mapInArrow(run, "lang string, v long, w long").groupBy("lang", "v", "w").agg(F.count("*").alias("cnt"))


def discounts(counts: DataFrame) -> DataFrame:
    """lang, d1, d2, d3 of counts(lang, cnt): what is taken off counts of 1, 2 and more."""
    of = counts.groupBy("lang").agg(*[F.count_if(F.col("cnt") == r).alias(f"n{r}") for r in (1, 2, 3, 4)])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def share(r: int) -> Column:
        raw = F.lit(float(r)) - (r + 1) * y * F.try_divide(F.col(f"n{r + 1}"), F.col(f"n{r}"))
        return F.greatest(F.lit(LEAST_DISCOUNT), F.least(F.lit(float(r)), F.coalesce(raw, F.lit(r * 0.5)))).alias(f"d{r}")

    return of.select("lang", share(1), share(2), share(3))


def _off(cnt: Column) -> Column:
    return F.when(cnt == 1, F.col("d1")).when(cnt == 2, F.col("d2")).otherwise(F.col("d3"))


def train(texts: DataFrame, form: Callable[[DataFrame], DataFrame] = lambda weights: weights) -> tuple[DataFrame, DataFrame]:
    """The weights: lang, v (null: a single word), w, cnt, weight, or what form makes of them; and for each language lang, unknown.

    Pairs lie sorted by their first words, as repeated neighbours take little room; tables of words grow with the corpus,
    so both joins are shuffled ones at any size.
    """
    pairs = stage(count_pairs(texts).sortWithinPartitions("lang", "v", "w"), "pairs")
    taken = stage(discounts(pairs), "discounts")
    off = pairs.join(checked_broadcast(taken), "lang").withColumn("off", _off(F.col("cnt")))
    contexts = off.groupBy("lang", F.col("v").alias("word")).agg(F.sum("cnt").alias("total"), (F.sum("off") / F.sum("cnt")).alias("left"))
    contexts = stage(contexts, "contexts")
    follow = stage(pairs.groupBy("lang", F.col("w").alias("word")).agg(F.count("*").alias("cnt")), "continuations")
    lower = discounts(follow).join(follow.groupBy("lang").agg(F.sum("cnt").alias("sum"), F.count("*").alias("words")), "lang")
    marked = follow.join(checked_broadcast(lower), "lang").withColumn("off", _off(F.col("cnt")))
    unknown = stage(marked.groupBy("lang").agg(F.log(F.sum("off") / F.first("sum") / (F.first("words") + 1)).alias("unknown")), "unknown")
    single = marked.join(checked_broadcast(unknown), "lang").select("lang", "word", "unknown", ((F.col("cnt") - F.col("off")) / F.col("sum") + F.exp("unknown")).alias("p"))
    single = stage(single, "single")
    drop_staged(follow)
    # log p(w after v) - log(left) - log p(w) is log(1 + odds / p(w)), with odds from the pair and its context alone.
    odds = ((F.col("cnt") - F.col("off")) / F.col("total") / F.col("left")).cast("float").alias("odds")
    first = stage(off.join(contexts.withColumnRenamed("word", "v").hint("merge"), ["lang", "v"]).select("lang", "v", "w", "cnt", odds), "first")
    drop_staged(pairs)
    both = contexts.join(single, ["lang", "word"], "full").select("lang", F.lit(None).cast("long").alias("v"), F.col("word").alias("w"), F.coalesce("total", F.lit(1)).alias("cnt"), (F.coalesce(F.log("left"), F.lit(0.0)) + F.coalesce(F.log("p") - F.col("unknown"), F.lit(0.0))).alias("weight"))
    known = first.join(single.withColumnRenamed("word", "w").drop("unknown").hint("merge"), ["lang", "w"]).select("lang", "v", "w", "cnt", F.log1p(F.col("odds") / F.col("p")).alias("weight"))
    out = stage(form(both.unionByName(known)), "weights")
    for table in (taken, contexts, single, first):
        drop_staged(table)
    return out, unknown


def keyed(weights: DataFrame) -> DataFrame:
    """key, cnt and weight of the model's weights."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone, (v, w) = batch.column(0).is_null().to_numpy(False), (batch.column(i).fill_null(0).to_numpy().view(np.uint64) for i in (0, 1))
            key = np.where(alone, word_keys(w), pair_keys(v, w))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(2), batch.column(3).cast(pa.float32())], ["key", "cnt", "weight"])

    return weights.select("v", "w", "cnt", "weight").mapInArrow(run, "key long, cnt long, weight float")


def _place(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each key, and what tells it there."""
    return (keys & np.uint64(0xFFFFFFFF)) % np.uint64(shards), (keys >> np.uint64(32)).astype(np.uint32)


def _looked_up(keys: np.ndarray, weights: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights of asked in sorted keys (0 if absent), and whether they are there."""
    if not len(keys):
        return np.zeros(len(asked), np.float32), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    there = keys[at] == asked
    return np.where(there, weights[at], np.float32(0)), there


_PACK = "slot int, kind int, block long, keys binary, ends binary, doc_id array<long>, lang array<string>, n_words array<long>, own array<double>"


def _rows(of: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*of), kinds)], [x.split()[0] for x in _PACK.split(", ")])


def _packs(hot, shards: int, salts: int):
    """Blocks of (doc_id, text, lang) to a row (kind 2) of the documents with what the hot weights give them, and a row
    (kind 1) for each shard: four bytes for each key, and at which key each document ends."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, bits = hot.value
        first = TaskContext.get().partitionId() << 32
        for i, part in enumerate(parts(batches, BLOCK)):
            block, ids, langs = first + i, part.column(0).to_pylist(), part.column(2).to_pylist()
            sizes, own, cold, of = [], [], [], []
            for j, (text, lang) in enumerate(zip(part.column(1).to_pylist(), langs)):
                w = numbers(text, lang)
                sizes.append(len(w) - 2)
                asked = np.concatenate((word_keys(w), pair_keys(w[:-1], w[1:]))) if len(w) > 2 else w[:0]
                found, there = _looked_up(keys, weights, asked)
                own.append(float(found.sum(dtype=np.float64)))
                asked = asked[~there]
                at = asked >> np.uint64(64 - FILTER_BITS)
                cold.append(asked[bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1])
                of.append(np.full(len(cold[-1]), j, np.int64))
            place, rest = _place(np.concatenate(cold), shards)
            order = np.argsort(place.astype(np.uint16 if shards < 1 << 16 else np.uint64), kind="stable")
            place, rest, of = place[order], rest[order], np.concatenate(of)[order]
            salt = block % salts
            yield _rows([(int(block % shards) * salts + salt, 2, block, None, None, ids, langs, sizes, own)])
            starts = np.searchsorted(place, np.arange(shards + 1, dtype=np.uint64))
            out = []
            for s in np.flatnonzero(np.diff(starts)):
                here = slice(starts[s], starts[s + 1])
                ends = np.cumsum(np.bincount(of[here], minlength=len(ids))).astype(np.uint32)
                out.append((int(s) * salts + salt, 1, block, rest[here].tobytes(), ends.tobytes(), None, None, None, None))
                if len(out) == 64:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    return run


@releasing
def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of slots: a shard's weights (kind 0), then packs, which become partial sums by document."""
    slot, keys, weights = None, np.zeros(0, np.uint32), np.zeros(0, np.float32)
    for batch in batches:
        for i in range(batch.num_rows):
            row = {f.name: batch.column(k)[i] for k, f in enumerate(batch.schema)}
            if slot != row["slot"].as_py():
                slot, keys, weights = row["slot"].as_py(), keys[:0], weights[:0]
            kind = row["kind"].as_py()
            if kind == 0:
                keys, weights = (np.frombuffer(row[c].as_py(), t) for c, t in (("keys", np.uint32), ("ends", np.float32)))
            elif kind == 2:
                yield batch.slice(i, 1).select(["block", "ends", "doc_id", "lang", "n_words", "own"])
            else:
                found, _ = _looked_up(keys, weights, np.frombuffer(row["keys"].as_py(), np.uint32))
                upto = np.concatenate(([0.0], np.cumsum(found, dtype=np.float64)))[np.frombuffer(row["ends"].as_py(), np.uint32)]
                sums = np.diff(upto, prepend=0.0).astype(np.float32).tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(i, 1), pa.array([sums], pa.binary()), *[batch.column(k).slice(i, 1) for k in range(5, 9)]], ["block", "ends", "doc_id", "lang", "n_words", "own"])


def _added(table: pa.Table) -> pa.Table:
    """The rows of a block to its documents."""
    base = next(r for r in table.to_pylist() if r["doc_id"] is not None)
    total = np.array(base["own"], np.float64)
    for x in table.column("ends"):
        if x.is_valid:
            total = total + np.frombuffer(x.as_py(), np.float32)
    return pa.table({"doc_id": pa.array(base["doc_id"], pa.int64()), "lang": pa.array(base["lang"], pa.string()), "n_words": pa.array(base["n_words"], pa.int64()), "known": pa.array(total)})


def _packed(table: pa.Table) -> pa.Table:
    """A shard's rows (shard, rest, weight) to its row."""
    rest, weight = table.column("rest").to_numpy().view(np.int64).astype(np.uint32), table.column("weight").to_numpy()
    order, s = np.argsort(rest, kind="stable"), table.column("shard")[0].as_py()
    return pa.Table.from_batches([_rows([(s, 0, -1, rest[order].tobytes(), weight[order].astype(np.float32).tobytes(), None, None, None, None)])])


def _filter(keys: DataFrame) -> np.ndarray:
    """The filter's bytes: 64 bits to a row, which map sides combine, so that its size alone bounds what comes back."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("key", 64 - FILTER_BITS).bitwiseAND(F.lit(63)).cast("int"))
    rows = stage(keys.groupBy(F.shiftrightunsigned("key", 70 - FILTER_BITS).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits")), "filter")
    found, out = rows.toArrow(), np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    drop_staged(rows)
    return out.astype("<i8").view(np.uint8)


def score(docs: DataFrame, weights: DataFrame, unknown: DataFrame, hot_rows: int = HOT, shard_rows: int = SHARD) -> DataFrame:
    """doc_id, lang, n_words and nll (mean negative log-likelihood of a word; null without words or a model)."""
    return score_keyed(docs, stage(keyed(weights), "keys"), unknown, hot_rows, shard_rows)


def score_keyed(docs: DataFrame, model: DataFrame, unknown: DataFrame, hot_rows: int = HOT, shard_rows: int = SHARD) -> DataFrame:
    """score() with the weights as keyed() gives them, staged; they are deleted."""
    spark, texts = docs.sparkSession, _texts(docs)
    # The least count with at most hot_rows weights at or above it; counts are few different numbers.
    counts, least, rows = model.groupBy("cnt").agg(F.count("*").alias("n")).collect(), None, 0
    for r in sorted(counts, reverse=True):
        if rows + r["n"] > hot_rows:
            break
        least, rows = r["cnt"], rows + r["n"]
    n = model.count() - rows
    commonest = model.where(F.col("cnt") >= least).select("key", "weight").toArrow() if rows else None
    keys = commonest.column("key").to_numpy().view(np.uint64) if rows else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    cold = model if least is None else model.where(F.col("cnt") < least)
    hot = spark.sparkContext.broadcast((keys[order], commonest.column("weight").to_numpy()[order] if rows else np.zeros(0, np.float32), _filter(cold)))
    shards = max(1, math.ceil(n / shard_rows))
    salts = max(1, math.ceil(texts.rdd.getNumPartitions() / shards))
    low = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
    shares = cold.select((low % shards).cast("int").alias("shard"), F.shiftrightunsigned("key", 32).alias("rest"), "weight").groupBy("shard").applyInArrow(_packed, _PACK)
    packed = stage(shares, "shards")
    drop_staged(model)
    salted = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("slot", F.col("slot") * salts + F.col("salt")).drop("salt")
    packs = texts.mapInArrow(_packs(hot, shards, salts), _PACK)
    dealt = packs.union(salted).repartition(shards * salts, "slot").sortWithinPartitions("slot", "kind")
    sums = dealt.mapInArrow(_sums, "block long, ends binary, doc_id array<long>, lang array<string>, n_words array<long>, own array<double>")
    total = sums.groupBy("block").applyInArrow(_added, "doc_id long, lang string, n_words long, known double")
    nll = -(F.col("known") / (F.col("n_words") + 1) + F.col("unknown"))
    out = total.join(checked_broadcast(unknown), "lang", "left").select("doc_id", "lang", "n_words", F.when(F.col("n_words") > 0, nll).alias("nll"))
    out = stage(out, "scores")
    drop_staged(packed)
    hot.destroy()
    release_memory()
    return out


def limits(scored: DataFrame, trusted: DataFrame, share: float, quantile: float = QUANTILE, margin: float = MARGIN, prior: int = PRIOR) -> DataFrame:
    """lang, mean (of a word), low and high.

    high is a quantile, plus the margin, of trusted documents that the model hasn't seen; low one of all, less the margin.
    """
    own = scored.join(checked_broadcast(trusted, TRUSTED_ROWS), "doc_id", "left_semi").where("nll is not null")
    new, words = drawn(own, share, False), F.col("n_words") + 1
    means = stage(new.groupBy("lang").agg((F.sum(F.col("nll") * words) / F.sum(words)).alias("mean")), "means")
    rated = lambda df, q: df.join(checked_broadcast(means), "lang").groupBy("lang", "mean").agg(F.percentile(F.round(rating(prior), 3), F.lit(q)).alias("q"))
    low = rated(own, 1 - quantile).select("lang", (F.col("q") - margin).alias("low"))
    return rated(new, quantile).select("lang", "mean", (F.col("q") + margin).alias("high")).join(checked_broadcast(low), "lang")


def rating(prior: int = PRIOR) -> Column:
    """The mean over a document's words and prior words of its language's average."""
    words = F.col("n_words") + 1
    return (F.col("nll") * words + F.col("mean") * prior) / (words + prior)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, share: float = TRAINING_SHARE) -> DataFrame:
    """A row for each document: doc_id, lang, n_words, perplexity, score, low, high (limits of the score) and kept."""
    trusted = stage(trusted_ids(labels), "trusted")
    known = _texts(docs).join(checked_broadcast(trusted, TRUSTED_ROWS), "doc_id", "left_semi")
    model, unknown = train(drawn(known, share), keyed)
    scored = score_keyed(docs, model, unknown)
    bounds = stage(limits(scored, trusted, share, quantile, margin), "limits")
    judged = scored.join(checked_broadcast(bounds), "lang", "left").withColumn("score", F.round(rating(), 3))
    kept = F.when(F.col("n_words") == 0, False).otherwise(F.coalesce(F.col("score").between(F.col("low"), F.col("high")), F.lit(True)))
    return judged.select("doc_id", "lang", "n_words", F.exp("nll").alias("perplexity"), "score", "low", "high", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""
    bad = stage(classify(docs, labels).where("not kept and doc_id is not null").select("doc_id").distinct(), "rejected")
    return docs.join(checked_broadcast(bad, TRUSTED_ROWS), column(docs, "doc_id").cast("long") == bad["doc_id"], "left_anti")

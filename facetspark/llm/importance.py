"""Target-distribution importance resampling: hashed n-gram features, log ratios of target to raw text, a Gumbel draw.

Features are runs of 1 and 2 consecutive words, repeats counted. A dictionary of distinct features does the hashing:

* A task cuts its texts into blocks of about `BLOCK` bytes, counts each block's features (bytes, word ids and pairs of
  ids are numpy arrays; no string is made for a repeated feature), and sends each distinct feature of a block once, as a
  string with its count, to the feature's shard. Strings travel in packs, one for each block and shard. Which document
  holds which feature how often stays together in one row for each block, the block's counts.
* A shard puts its packs' strings together, counts each distinct string over the whole corpus, hashes it once, adds up
  its buckets, and answers each pack with the buckets of its features.
* Buckets of all shards, added up, give a gain for each bucket, against those of the target texts. Blocks' counts are
  joined with the answers to them, and gains are added up by document.

A feature in every document is one entry in each block, so no feature makes a hot task, and a shard grows with the blocks
that its features stand in only. Shards are dealt so that each has about `SHARD` bytes of text; packs are never more
than features of blocks. Sums are whole numbers, so the order of work plays no part. What the driver reads is bounded by
the number of buckets and of partitions.

Drawing. score = weight + floor(-1000 ln(-ln u)), u from a hash of the salted doc_id: the highest scores are a sample
without replacement in proportion to exp(weight / 1000). Ranks come from range partitions.

Defined results: a null or empty text has no features and weight 0; only A-Z is lower-cased; a document with a null
doc_id has a weight but no score and isn't drawn; rows of one doc_id are separate documents with the same u; equal
scores are drawn by doc_id, and equal rows in any order; an empty target, or one without words, leaves all gains to the
counts' smoothing; an empty table gives an empty table; a text of any length is cut into several blocks between words,
the pair across a cut included; only doc_id and text are read, and text of the target.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetspark.llm.common import as_documents, drop_staged, release_memory, releasing, stage
from facetspark.operators.numbering import numbered

BUCKETS = 10_000
#: Bytes of text in a block, and of the text whose features a shard holds.
BLOCK = 8 << 20
SHARD = 16 << 20
#: How hard strings and numbers are compressed.
LEVELS = (6, 3)
#: Documents with fewer words aren't drawn; the share of the others that is, in hundredths.
LEAST_WORDS = 20
PERCENT = 25
#: What a byte is in a lower-cased word, 0 outside of words.
_LOWER = np.array([b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 0 for b in range(256)], np.uint8)
#: Fixed odd multipliers that deal features to shards.
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

_SENT = "slot long, kind int, block long, shard int, n long, data binary, extra binary, row array<long>, doc_id array<long>, n_words array<long>, n_features array<long>"
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 4]
_NAMES = [c.split()[0] for c in _SENT.split(", ")]
PACK, COUNTS, ANSWER, SUMS = range(4)


def packed(a: np.ndarray | bytes) -> bytes:
    """Bytes, compressed, behind their number; of numbers all first bytes come first, then all second ones, and so on."""
    raw = a if isinstance(a, bytes) else np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
    codec = pa.Codec("zstd", compression_level=LEVELS[not isinstance(a, bytes)])
    return len(raw).to_bytes(8, "little") + (codec.compress(raw, asbytes=True) if raw else b"")


def unpacked(b: bytes, kind: type | None = None):
    size = int.from_bytes(b[:8], "little")
    raw = pa.decompress(b[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    if kind is None:
        return raw
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def _gap(text: bytes, at: int, limit: int) -> int:
    """Where to cut a stretch that starts at `at`: at the last gap within limit bytes, else the first one behind them."""
    gaps = np.flatnonzero(_LOWER[np.frombuffer(text, np.uint8, limit + 1, at)] == 0)
    if len(gaps) and gaps[-1] > 0:
        return at + int(gaps[-1])
    for lo in range(at + limit + 1, len(text), limit):
        gaps = np.flatnonzero(_LOWER[np.frombuffer(text, np.uint8, min(limit, len(text) - lo), lo)] == 0)
        if len(gaps):
            return lo + int(gaps[0])
    return len(text)


def pieces(texts: list[bytes], limit: int = BLOCK) -> Iterator[tuple[int, int, int, int]]:
    """(text's number, start, context, end) of stretches of at most limit bytes, cut between words: context is where the
    word before the stretch starts, so that the pair across the cut is known (start, if there is none)."""
    for i, text in enumerate(texts):
        at, context, seen = 0, 0, False
        while True:
            end = len(text)
            if end - at > limit:
                end = _gap(text, at, limit)
            yield i, at, context, end
            if end == len(text):
                break
            inside = np.flatnonzero(_LOWER[np.frombuffer(text, np.uint8, end - at, at)])
            if len(inside):
                last = at + int(inside[-1])
                gaps = np.flatnonzero(_LOWER[np.frombuffer(text, np.uint8, last - context, context)] == 0)
                context, seen = context + int(gaps[-1]) + 1 if len(gaps) else context, True
            at = end
            if not seen:
                context = at


def split_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All lower-cased words of texts, and the number of the text that each one stands in."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum([0, *map(len, texts)])
    x = _LOWER[data]
    word = x != 0
    before = np.concatenate(([False], word[:-1]))[: len(word)]
    before[starts[:-1][starts[:-1] < len(word)]] = False
    begins = np.flatnonzero(word & ~before)
    ends_here = np.concatenate((~word[1:] | (before[1:] != word[:-1]), [True]))[: len(word)]
    ends = np.flatnonzero(word & ends_here) + 1
    offsets = np.concatenate(([0], np.cumsum(ends - begins))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets.tobytes()), pa.py_buffer(x[word].tobytes()))
    return words, np.searchsorted(starts, begins, side="right") - 1


def count_features(texts: list[bytes], known: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, hash that deals each, where its places start, document and count of each place, words and features of
    each document). known: how many leading words of each text are context only, counted with the stretch before."""
    words, of = split_words(texts)
    n = len(texts)
    codes = words.dictionary_encode()
    order = pc.sort_indices(codes.dictionary).to_numpy()
    vocabulary = codes.dictionary.take(pa.array(order))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ids, size = rank[codes.indices.to_numpy()], len(order)
    first = np.searchsorted(of, np.arange(n + 1))
    place = np.arange(len(ids)) - first[of] if len(ids) else np.zeros(0, np.int64)
    own = place >= known[of] if len(ids) else np.zeros(0, bool)
    pair = np.zeros(len(ids), bool)
    pair[1:] = (of[1:] == of[:-1]) & own[1:]
    second = np.flatnonzero(pair)
    keys = np.concatenate((ids[own], size + ids[second - 1] * size + ids[second]))
    docs = np.concatenate((of[own], of[second])).astype(np.int64)
    n_words, n_features = np.bincount(of[own], minlength=n), np.bincount(docs, minlength=n)
    both = np.sort(keys * max(n, 1) + docs)
    new = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))[: len(both)])
    count = np.diff(np.append(new, len(both)))
    feature, doc = np.divmod(both[new], max(n, 1))
    starts = np.flatnonzero(np.concatenate(([True], feature[1:] != feature[:-1]))[: len(feature)])
    distinct = feature[starts]
    single, pairs = distinct[distinct < size], distinct[distinct >= size] - size
    a, b = np.divmod(pairs, max(size, 1))
    names = pa.concat_arrays([vocabulary.take(pa.array(single)), pc.binary_join_element_wise(vocabulary.take(pa.array(a)), vocabulary.take(pa.array(b)), " ")])
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary.to_pylist()), np.uint64, size)
    mixed = np.concatenate((h[single] * _MIX[0], h[a] * _MIX[0] + h[b] * _MIX[1] + np.uint64(1)))
    return names, mixed ^ (mixed >> np.uint64(29)), starts, doc, count, n_words, n_features


def _record(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(_NAMES, _TYPES)], names=_NAMES)


def _block(block: int, shards: int, rows: list[int], ids: list[int | None], texts: list[bytes], known: list[int]) -> Iterator[dict]:
    """The packs of a block, and its counts in the packs' order of features."""
    names, mixed, starts, doc, count, n_words, n_features = count_features(texts, np.array(known, np.int64))
    shard = (mixed % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    length = np.diff(np.append(starts, len(doc)))
    totals = np.add.reduceat(count, starts) if len(starts) else count
    shard, length, totals, names = shard[order], length[order], totals[order], names.take(pa.array(order))
    at = np.repeat(starts[order] - (np.cumsum(length) - length), length) + np.arange(len(doc))
    yield {"slot": -1 - block, "kind": COUNTS, "block": block, "n": len(order), "data": packed(length.astype(np.uint32)), "extra": packed(np.concatenate((doc[at], count[at])).astype(np.uint32)), "row": rows, "doc_id": ids, "n_words": n_words.tolist(), "n_features": n_features.tolist()}
    cuts = np.flatnonzero(np.diff(shard)) + 1
    for lo, hi in zip(np.concatenate(([0], cuts)), np.append(cuts, len(order))):
        if hi > lo:
            own = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), names.slice(lo, hi - lo)), "\n")[0].as_py()
            yield {"slot": int(shard[lo]), "kind": PACK, "block": block, "shard": int(shard[lo]), "n": int(hi - lo), "data": packed((own + "\n").encode()), "extra": packed(totals[lo:hi].astype(np.uint32))}


def _blocks(shards: int, limit: int):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 33
        block, row, held, size = task, task, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for r in _block(block, shards, *map(list, zip(*held))):
                yield _record([r])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_py().encode() if text.is_valid else b""
                for _, start, context, end in pieces([raw], limit):
                    if held and size + end - context > limit:
                        yield from flush()
                        block, held, size = block + 1, [], 0
                    held.append((row, doc_id, raw[context:end], int(context < start)))
                    size += end - context
                row += 1
        if held:
            yield from flush()

    return run


def _answers(table: pa.Table) -> pa.Table:
    """A shard's packs to the buckets of their features, and what its features add to the buckets; counts pass."""
    rows = table.to_pylist()
    if rows[0]["kind"] == COUNTS:
        return table
    raw = b"".join(unpacked(r["data"]) for r in rows)
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    codes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)]).dictionary_encode()
    distinct, index = codes.dictionary, codes.indices.to_numpy()
    times = np.bincount(index, weights=np.concatenate([unpacked(r["extra"], np.uint32) for r in rows]), minlength=len(distinct))
    strings = (s for lo in range(0, len(distinct), 1 << 16) for s in distinct.slice(lo, 1 << 16).to_pylist())
    bucket = np.fromiter((zlib.crc32(s[:-1]) % BUCKETS for s in strings), np.uint16, len(distinct))
    sums = np.bincount(bucket, weights=times, minlength=BUCKETS).astype(np.int64)
    out = [{"slot": rows[0]["slot"], "kind": SUMS, "data": packed(sums)}]
    found, at = bucket[index], 0
    for r in rows:
        out.append({"slot": -1 - r["block"], "kind": ANSWER, "block": r["block"], "shard": r["shard"], "n": r["n"], "data": packed(found[at : at + r["n"]])})
        at += r["n"]
    table = pa.Table.from_batches([_record(out)])
    del raw, codes, distinct, index, times, bucket, found, rows, out
    release_memory()
    return table


def hashed(docs: DataFrame, limit: int = BLOCK, shard_bytes: int = SHARD) -> DataFrame:
    """The blocks' counts, the answers to their packs and the shards' sums of buckets, written."""
    texts = as_documents(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = _blocks(max(1, math.ceil(size / shard_bytes)), limit)
    return stage(texts.mapInArrow(blocks, _SENT).groupBy("slot").applyInArrow(_answers, _SENT), "features")


@releasing
def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for x in batch.column(0):
            total += unpacked(x.as_py(), np.int64)
    if total.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(total)], ["bucket", "n"])


def bucket_counts(features: DataFrame) -> np.ndarray:
    """How many features of hashed() fall into each bucket: BUCKETS numbers."""
    sums = features.where(F.col("kind") == SUMS).select("data").mapInArrow(_added, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target's smoothed share / raw text's)) of each bucket, in doubles."""
    s_all, t_all = float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + BUCKETS) / ((float(s) + 1) * (t_all + BUCKETS)))) for s, t in zip(raw, target)], np.int64)


def _weights(gains: np.ndarray):
    def join(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        base = next(r for r in rows if r["kind"] == COUNTS)
        answers = sorted((r for r in rows if r["kind"] == ANSWER), key=lambda r: r["shard"])
        if sum(r["n"] for r in answers) != base["n"]:
            raise ValueError("answers of another run of the task: the documents come in no fixed order, write them first")
        bucket = np.concatenate([unpacked(r["data"], np.uint16) for r in answers]) if answers else np.zeros(0, np.uint16)
        doc, count = unpacked(base["extra"], np.uint32).reshape(2, -1)
        each = np.repeat(gains[bucket], unpacked(base["data"], np.uint32)) * count
        total = np.bincount(doc, weights=each, minlength=len(base["row"])).astype(np.int64)
        columns = [pa.array(base[c], pa.int64()) for c in ("row", "doc_id", "n_words", "n_features")]
        return pa.table([*columns, pa.array(total)], ["row", "doc_id", "n_words", "n_features", "total"])

    return join


def weigh(docs: DataFrame, target: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, n_words, n_features, weight: a row for each document, written."""
    goal = target.select(F.lit(None).cast("long").alias("doc_id"), as_documents(target, ["text"])["text"].alias("text"))
    aims = hashed(goal, **sizes)
    wanted = bucket_counts(aims)
    drop_staged(aims)
    features = hashed(docs, **sizes)
    gains = gains_of(bucket_counts(features), wanted)
    parts = features.where(F.col("kind") != SUMS).groupBy("block").applyInArrow(_weights(gains), "row long, doc_id long, n_words long, n_features long, total long")
    whole = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "total")])
    mean = F.expr("(total - pmod(total, n_features)) div n_features")
    out = stage(whole.select("doc_id", "n_words", "n_features", F.when(F.col("n_features") > 0, mean).otherwise(0).cast("long").alias("weight")), "weights")
    drop_staged(features)
    return out


def resample(docs: DataFrame, target: DataFrame, salt: str = "7:", percent: int = PERCENT, least_words: int = LEAST_WORDS, **sizes: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (from 1; null if not drawn): percent of the documents with at
    least least_words words are drawn, without replacement, towards the target texts' features."""
    weighed = weigh(docs, target, **sizes)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    scored = weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))))
    may = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    drawn = percent * scored.where(may).count() // 100
    ranked = numbered(scored.where(may), [F.desc("score"), F.col("doc_id")], "rank", 1).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")))

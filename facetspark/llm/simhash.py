"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint has a bit for each of 64 places, set if over half of the XXH64 values of its word
shingles have it. Documents whose fingerprints differ in at most `RADIUS` = 3 bits are linked; components are
the classes of near-duplicates.

Candidate search. Half of an odd radius is no whole number, so the 64 bits are cut into three blocks; with one
block masked, every fingerprint emits all variants within distance 1 of its other bits (132 variants in all,
against 2,081 for balls of radius 2), and the variants are shuffled. Two fingerprints with at most three differing
bits meet in some variant unless all three lie in the masked block itself; that case is found among those that
agree outside the block. What meets in a variant is dealt once more by the value of the masked block and its
one-bit neighbours, which verifies the distance without forming pairs: within such a cell all members are linked to
one of them (a star), so a group of n near copies makes O(n) links, not n squared.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked as any other;
fewer words than a shingle make one shingle of the whole sequence; equal rows stay separate rows with the same
result; an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetspark.llm.common import as_documents, checked_broadcast, column, drop_staged, fresh, parts, release_memory, releasing, stage

RADIUS = 3
SHINGLE = 3
SEED = 42
#: (lowest bit, width) of the blocks.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Similarity (Jaccard, shingles of five words) of near copies.
SIMILAR = 0.8
#: Shingles are counted in a sample of 1 in `SAMPLE` texts (of all, if they are few); the count from which one is
#: frequent, and how many of these are broadcast, the commonest. This is a matter of cost only.
SAMPLE = 16
ENOUGH = 5000
OFTEN = 4
FREQUENT = 1 << 18
#: How many of a group its texts are compared with, round by round; in the last, all.
FIRST = (16, None)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Rows of a group up to which they are compared one by one.
FEW = 8
#: Fingerprints whose variants one task makes.
DEALT = 25_000
#: Shingles whose bits are counted at once.
CHUNK = 1 << 18
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_OFFSET = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, ones, digest = len(words) - k + 1, np.zeros((8, 256), np.int64), xxhash.xxh64_digest
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist())])
        cells = np.frombuffer(hashes, np.uint8).reshape(-1, 8) + _OFFSET
        ones += np.bincount(cells.ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (ones @ _BITS) > n).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, axis=1).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long), a row for each document."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return as_documents(docs, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, fp long")


def _flips(bits: list[int], radius: int) -> np.ndarray:
    """All masks of at most radius of the bits."""
    one = np.array([1 << b for b in bits], np.uint64)
    out = [np.zeros(1, np.uint64), one]
    if radius == 2:
        i, j = np.triu_indices(len(bits), 1)
        out.append(one[i] | one[j])
    return np.concatenate(out)


def _block(b: int) -> np.uint64:
    low, width = BLOCKS[b]
    return np.uint64(((1 << width) - 1) << low)


#: For each block, the flips of at most one bit outside it.
_OUTSIDE = [_flips([i for i in range(64) if not int(_block(b)) >> i & 1], 1) for b in range(3)]


@releasing
def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block, all variants within distance 1 outside it, the block's own bits being 0.

    rest holds the block's number (2 bits), its value in the fingerprint (22) and the flip (6): with key, it tells the
    fingerprint, so that no more than these two numbers are shuffled.
    """
    for batch in batches:
        every = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(every), 4096):
            fp = every[at : at + 4096]
            for b, masks in enumerate(_OUTSIDE):
                key = (fp & ~_block(b))[:, None] ^ masks[None, :]
                value = ((fp & _block(b)) >> np.uint64(BLOCKS[b][0])).astype(np.int32)
                rest = (value[:, None] << 6) + np.arange(len(masks), dtype=np.int32)[None, :] + (b << 28)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(rest.ravel())], ["key", "rest"])


def _signed(x) -> int:
    return int(np.uint64(x).view(np.int64))


def _told(block: int) -> Column:
    """The fingerprint that key and rest tell, for a block."""
    flips = F.get(F.array(*[F.lit(_signed(m)) for m in _OUTSIDE[block]]), F.col("rest").bitwiseAND(63))
    return F.col("key").bitwiseXOR(flips).bitwiseOR(F.shiftleft(F.col("value"), BLOCKS[block][0]))


def _cells(inner: int, outer: int):
    """(key, block, fp, vary) to (key, block, cell, fp, core): core rows lie within inner of the cell in the block, others
    within outer. Only bits of vary, in which the group's rows differ at all, are flipped. Of two values one bit apart,
    one has a bit more; for (0, 1) it is enough that this one loses it."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = [_flips(list(range(low, low + width)), outer) for low, width in BLOCKS]
        cores = [1 if inner == 0 else 1 + width for _, width in BLOCKS]
        for batch in batches:
            keys, blocks, fps, vary = (batch.column(i).to_numpy() for i in range(4))
            for b in range(3):
                here = np.flatnonzero(blocks == b)
                for at in range(0, len(here), 4096):
                    i, masks = here[at : at + 4096], balls[b]
                    value = (fps[i].view(np.uint64) & _block(b))[:, None]
                    cell = value ^ masks[None, :]
                    core = np.broadcast_to(np.arange(len(masks)) < cores[b], cell.shape)
                    may = vary[i].view(np.uint64)[:, None]
                    if (inner, outer) == (0, 1):
                        may = may & value
                    use = (masks[None, :] & ~may) == 0
                    n = use.sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys[i], n)), pa.array(np.full(n.sum(), b, np.int8)), pa.array(cell[use].view(np.int64)), pa.array(np.repeat(fps[i], n)), pa.array(core[use])], ["key", "block", "cell", "fp", "core"])

    return run


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _linked(groups: DataFrame, inner: int, outer: int) -> DataFrame:
    """Links (fp, centre) within the groups of rows (key, block, fp) of equal key and block.

    Groups of up to `FEW` rows are compared row by row with those before; in larger ones all rows go to cells, and those
    in a cell with a core row are linked to the least core row, so that the work grows with the rows and not their square.
    """
    w = Window.partitionBy("key", "block")
    counted = groups.withColumn("n", F.count("*").over(w))
    before = F.array_compact(F.array(*[F.lag("fp", k).over(w.orderBy("fp")) for k in range(1, FEW)]))
    few = counted.where((F.col("n") > 1) & (F.col("n") <= FEW)).withColumn("before", before).select("fp", F.explode(F.filter("before", lambda x: F.bit_count(x.bitwiseXOR(F.col("fp"))) <= RADIUS)).alias("centre"))
    vary = F.bit_or("fp").over(w).bitwiseAND(F.bitwise_not(F.bit_and("fp").over(w)))
    cells = counted.where(F.col("n") > FEW).select("key", "block", "fp", vary.alias("vary")).mapInArrow(_cells(inner, outer), "key long, block tinyint, cell long, fp long, core boolean")
    centre = F.min(F.when(F.col("core"), F.col("fp"))).over(Window.partitionBy("key", "block", "cell"))
    stars = cells.withColumn("centre", centre).where("centre <> fp").select("fp", "centre")
    return few.union(stars)


def links(fps: DataFrame) -> DataFrame:
    """Links (u > v) between the distinct fingerprints of fps(fp) that differ in at most RADIUS bits.

    Not all such pairs: as many as keep components of fingerprints the same. So they are no candidates for a test of the
    texts, which may fail for a link and hold for a pair left out; near_copies has candidates of its own.
    """
    n = -(-fps.count() // DEALT) or 1
    dealt = fps.select("fp").repartition(n, "fp").mapInArrow(_variants, "key long, rest int").repartition("key").withColumn("block", F.shiftright("rest", 28))
    by_key = Window.partitionBy("key", "block")
    ordered = by_key.orderBy("rest")
    met = dealt.withColumn("before", F.lag("rest").over(ordered)).withColumn("after", F.lead("rest").over(ordered)).where("before is not null or after is not null").drop("before", "after")
    # Rows of one flip other than 0 agree outside the block; they meet in the key of flip 0 as well, which is enough.
    flip = F.col("rest").bitwiseAND(63)
    met = met.withColumn("low", F.min(flip).over(by_key)).withColumn("high", F.max(flip).over(by_key)).where("low = 0 or low < high")
    met = met.withColumn("value", F.shiftright("rest", 6).bitwiseAND((1 << 22) - 1).cast("bigint")).withColumn("own", F.col("rest").bitwiseAND(63) == 0)
    met = met.withColumn("fp", F.when(F.col("block") == 0, _told(0)).when(F.col("block") == 1, _told(1)).otherwise(_told(2)))
    met = met.withColumn("first", F.first("fp").over(Window.partitionBy("key", "block", "value").orderBy("rest"))).withColumn("mixed", F.min("value").over(by_key) != F.max("value").over(by_key))
    met = stage(met.select("key", "block", "own", "fp", "first", "mixed"), "simhash-met")
    same = met.where("fp <> first").select("fp", F.col("first").alias("centre"))
    near = _linked(met.where("mixed and fp = first").select("key", F.col("block").cast("tinyint").alias("block"), "fp"), 0, 1)
    # What differs lies, all of it, in the masked block: rows that agree outside it.
    inside = _linked(met.where("own and mixed").select("key", F.col("block").cast("tinyint").alias("block"), "fp"), 1, 2)
    found = same.union(near).union(inside).where(_apart("fp", "centre") <= RADIUS)
    out = stage(found.select(F.greatest("fp", "centre").alias("u"), F.least("fp", "centre").alias("v")).distinct(), "simhash-links")
    drop_staged(met)
    return out


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v), u > v, to (u, v): v the least node of u's component, for every node but the least ones.

    Large-star and small-star steps alternate until nothing changes; each round is written to the shared folder.
    """
    before = None
    least = lambda df: F.min("v").over(Window.partitionBy("u"))
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", least(both))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.withColumn("m", least(large))
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after = stage(small, "components")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_staged(edges)
        if state == before:
            return after
        before, edges = state, after


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id of the component), a row for each document."""
    marked = stage(fingerprints(docs, shingle), "fingerprints")
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(fps))
    linked = fps.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("v", "fp")).select("fp", "least", "root")
    named = stage(linked.withColumn("component_id", F.min("least").over(Window.partitionBy("root"))).select("fp", "component_id"), "simhash-names")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def word_fingerprint(words: list[str]) -> int:
    """The fingerprint of a text's words, each weighted by the root of its count; 0 without words."""
    counts = Counter(words)
    if not counts:
        return 0
    digest = xxhash.xxh64_digest
    bits = np.unpackbits(np.frombuffer(b"".join([digest(w.encode(), SEED) for w in counts]), np.uint8).reshape(-1, 8), axis=1)
    weights = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    return int.from_bytes(np.packbits(2 * (weights @ bits) > weights.sum()).tobytes(), "big")


def _words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _shingles(text: str | None) -> set[bytes]:
    """Digests of the shingles of five words; fewer words make one shingle."""
    words = _words(text)
    return {xxhash.xxh3_128_digest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a: str | None, b: str | None, least: float = SIMILAR) -> bool:
    """Whether the texts' sets of shingles of five words have a Jaccard similarity of at least least; texts without
    words are similar to each other."""
    x, y = _shingles(a), _shingles(b)
    return len(x & y) >= least * len(x | y)


def _shingle_numbers(words: list[str]) -> np.ndarray:
    """The sorted set of 64-bit numbers of the shingles of five words; fewer words make one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    each = np.fromiter((digest(w.encode(), SEED) for w in words), np.uint64, len(words))
    n = max(1, len(words) - 4)
    out = np.zeros(n, np.uint64)
    for i in range(min(5, len(words))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n]
        out ^= out >> np.uint64(31)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


def _frequent(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted numbers of frequent shingles in a sample of texts(node, text), and their counts."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for t in batch.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(_shingle_numbers(_words(t.as_py())).view(np.int64))], ["key"])

    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(max(1, min(SAMPLE, n // ENOUGH)))) == 0)
    counted = stage(some.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN), "frequent")
    least, rows = 1 << 62, 0
    for r in sorted(counted.groupBy("n").agg(F.count("*").alias("rows")).collect(), reverse=True):
        if rows + r["rows"] > FREQUENT:
            break
        least, rows = r["n"], rows + r["rows"]
    found = counted.where(F.col("n") >= least).toArrow()
    drop_staged(counted)
    keys = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found.column("n").to_numpy()[order]


def parities(own: np.ndarray) -> bytes:
    """A bit for each place that shingles fall on, 1 if an odd number does; as many places as shingles, at least 512.

    Where the bits of two sets differ, some shingle is in one set only, so the differing bits bound what they share.
    """
    places = 1 << max(9, (len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1, bitorder="little").tobytes()


def may_be_similar(a: bytes, b: bytes, n: int, least: float) -> bool:
    """Whether two sets of n shingles in all may have a similarity of least, by their parities."""
    x, y, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * min(len(a), len(b))
    fold = lambda z, size: fold((z & ((1 << size // 2) - 1)) ^ (z >> size // 2), size // 2) if size > bits else z
    apart = (fold(x, 8 * len(a)) ^ fold(y, 8 * len(b))).bit_count()
    return (n - apart) / 2 >= least * n / (1 + least) - 1e-6


def _signatures(texts: DataFrame, n: int, least: float) -> tuple[DataFrame, Broadcast]:
    """What follows, and the frequent shingles that it needs until it is written.

    node, fp (word fingerprint), size (shingles), bits (parities) and keys (the shingles of the prefix, in order) of
    texts(node, text).

    All texts order their shingles alike, the more frequent later. Of two texts with a similarity of least or more, each
    has at most size - least * size shingles without the other, so the first that they share is in both prefixes.
    """
    sent = texts.sparkSession.sparkContext.broadcast(_frequent(texts, n))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, counts = sent.value
        for batch in parts(batches):
            fps, sizes, bits, keys = [], [], [], []
            for t in batch.column(1):
                words = _words(t.as_py())
                own = _shingle_numbers(words)
                count = np.zeros(len(own), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                    count = np.where(often[at] == own, counts[at], 0)
                take = len(own) - math.ceil(least * len(own) - 1e-6) + 1 if len(own) else 0
                fps.append(word_fingerprint(words))
                sizes.append(len(own))
                bits.append(parities(own))
                keys.append(own[np.argsort(count, kind="stable")][:take])
            ends = np.cumsum([0, *map(len, keys)])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), listed], ["node", "fp", "size", "bits", "keys"])

    return texts.mapInArrow(run, "node long, fp long, size int, bits binary, keys array<long>"), sent


def _beside(pairs: DataFrame, table: DataFrame, *names: str) -> DataFrame:
    """pairs(u, v) with the columns names of table(node, ...) for u, then for v."""
    for node in ("u", "v"):
        pairs = pairs.join(table.select(F.col("node").alias(node), *[F.col(c).alias(f"{c}_{node}") for c in names]), node)
    return pairs.select("u", "v", *[f"{c}_{node}" for node in ("u", "v") for c in names])


def _similar_pairs(pairs: DataFrame, signatures: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Of pairs(u, v) of nodes, those whose texts(node, text) are similar(): parities rule most others out, texts decide."""

    @releasing
    def rule_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size_u, bits_u, size_v, bits_v = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = [may_be_similar(a, b, m + n, least) for m, a, n, b in zip(size_u, bits_u, size_v, bits_v)]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["u", "v"])

    @releasing
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 100):
            keep = [similar(a, b, least) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], ["u", "v"])

    left = stage(_beside(pairs, signatures, "size", "bits").mapInArrow(rule_out, "u long, v long"), "possible-pairs")
    asked = left.select("u").union(left.select("v")).distinct().withColumnRenamed("u", "node")
    some = texts.join(checked_broadcast(asked), "node", "left_semi")
    out = stage(_beside(left, some, "text").mapInArrow(check, "u long, v long"), "similar-pairs")
    drop_staged(left)
    return out


def _close(signatures: DataFrame) -> DataFrame:
    """Pairs (u > v) of nodes by their fingerprints: of those with one fingerprint, each with the least; of linked
    fingerprints, their least nodes."""
    leaders = stage(signatures.groupBy("fp").agg(F.min("node").alias("leader")), "leaders")
    same = signatures.select("node", "fp").join(leaders, "fp").where("node > leader").select(F.col("node").alias("u"), F.col("leader").alias("v"))
    linked = links(leaders)
    near = linked.join(leaders.select(F.col("fp").alias("u"), F.col("leader").alias("a")), "u").join(leaders.select(F.col("fp").alias("v"), F.col("leader").alias("b")), "v")
    out = stage(same.union(near.select(F.greatest("a", "b"), F.least("a", "b"))).distinct(), "close-pairs")
    drop_staged(leaders)
    drop_staged(linked)
    return out


def _classes(docs: DataFrame, least: float) -> DataFrame:
    """doc_id, hash (of the text) and root (a number of the class), a row for each row of docs."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            marks = [xxhash.xxh3_128_digest(" ".join(_words(t.as_py()))) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.binary())], ["doc_id", "hash", "mark"])

    texts = _hashed(docs)
    marked = stage(texts.mapInArrow(run, "doc_id long, hash long, mark binary"), "marks")
    nodes = marked.groupBy("mark").agg(F.min(F.struct("doc_id", "hash")).alias("first")).select("mark", "first.doc_id", "first.hash", F.monotonically_increasing_id().alias("node"))
    nodes = stage(nodes, "nodes")  # written, so that the numbers stay
    of = checked_broadcast(nodes.select(F.col("doc_id").alias("of_doc"), F.col("hash").alias("of_hash"), "node"))
    own = texts.join(of, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("hash") == F.col("of_hash"))).select("node", "text")
    signatures, sent = _signatures(own, nodes.count(), least)
    signatures = stage(signatures, "signatures")
    sent.destroy()
    release_memory()
    pairs = _close(signatures)
    roots = components(_similar_pairs(pairs, signatures, own, least))
    compared, by_key = pairs, Window.partitionBy("key")
    prefixes = signatures.select("node", "size", F.posexplode("keys").alias("pos", "key"))
    met = stage(prefixes.withColumn("n", F.count("*").over(by_key)).where("n > 1"), "prefixes")
    weights = met.groupBy("node").agg(F.sum("n").alias("weight"))
    ranked = stage(met.join(weights, "node").withColumn("rank", F.row_number().over(by_key.orderBy(F.desc("weight"), "node"))).drop("weight", "n"), "ranked")
    drop_staged(met)
    done = [pairs]
    for first in FIRST:
        named = ranked.join(roots, F.col("node") == F.col("u"), "left").withColumn("class", F.coalesce("v", "node")).drop("u", "v")
        mixed = named.withColumn("mixed", F.min("class").over(by_key) < F.max("class").over(by_key)).where("mixed").drop("mixed")
        a, b = mixed.alias("a"), (mixed if first is None else mixed.where(F.col("rank") <= first)).alias("b")
        rest = F.least(F.col("a.size") - F.col("a.pos"), F.col("b.size") - F.col("b.pos"))
        may = (F.least("a.size", "b.size") >= least * F.greatest("a.size", "b.size") - 1e-6) & ((1 + least) * rest >= least * (F.col("a.size") + F.col("b.size")) - 1e-6)
        met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.rank") > F.col("b.rank")) & (F.col("a.class") != F.col("b.class")) & may)
        met = met.select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")).distinct()
        pairs = stage(met.join(compared, ["u", "v"], "left_anti"), "colliding-pairs")
        found = _similar_pairs(pairs, signatures, own, least)
        before, roots = roots, components(stage(found.union(roots.select("u", "v")), "similar-pairs"))
        drop_staged(found)
        drop_staged(before)
        compared, done = compared.union(pairs), [*done, pairs]
    out = stage(marked.join(nodes.select("mark", "node"), "mark").join(roots, F.col("node") == F.col("u"), "left").select("doc_id", "hash", F.coalesce("v", "node").alias("root")), "classes")
    for table in (marked, nodes, signatures, ranked, roots, *done):
        drop_staged(table)
    return out


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, hash and text of all rows; a null text has a hash of its own."""
    return as_documents(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").isNull(), F.col("text")).alias("hash"), "text")


def near_copies(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """doc_id and component_id (the least doc_id), a row for each row of docs: classes of documents that are similar() to
    one another, directly or by way of others.

    Texts with the same words in the same order are one class from the start. Of the others, one of each class has a
    fingerprint of its words; those within `RADIUS` bits, found by ball hashing, are compared, which joins most copies
    with few comparisons. A similarity of least doesn't keep fingerprints that close, so the search is completed without
    them: texts that share a shingle of their prefixes (_signatures) are compared, but for pairs whose sizes or places of
    that shingle rule a similarity of least out. A group of texts with one shingle is first compared with the few of them
    that share most, then all with all; pairs that are in one class by then are left out, so that n copies of one text
    make about n comparisons, and in the end every pair that may be similar is compared or in one class.

    Defined results: null, empty and wordless texts are one class; a null doc_id is no least one, and a class of such
    rows only has none; rows with one doc_id and different texts are classed each by its own text; equal rows are in one
    class; an empty table gives an empty table; only doc_id and text are read.
    """
    found = _classes(docs, least)
    least_ids = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(least_ids, "root").select("doc_id", "component_id")


def first_of_group(docs: DataFrame) -> DataFrame:
    """Of each class of near_copies() the row with the least doc_id, with all its columns, whatever their names and types.

    Of several rows with that doc_id, the one with the least hash of its text, then with the least columns as JSON, stays.
    """
    found = _classes(docs, SIMILAR)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    kept = found.groupBy("root", "doc_id", "hash").agg(F.count("*").alias("n")).groupBy("root").agg(F.min_by(F.struct("doc_id", "hash", "n"), order).alias("first"))
    of, text, n = (fresh(docs, name) for name in ("first_doc", "first_hash", "first_rows"))
    kept = stage(kept.select(F.col("first.doc_id").alias(of), F.col("first.hash").alias(text), F.col("first.n").alias(n)), "first-of-group")
    drop_staged(found)
    one = column(docs, "doc_id").cast("long").eqNullSafe(F.col(of)) & (F.xxhash64(column(docs, "text").isNull(), column(docs, "text")) == F.col(text))
    single = docs.join(checked_broadcast(kept.where(F.col(n) == 1)), one, "left_semi")
    several = docs.join(checked_broadcast(kept.where(F.col(n) > 1)), one)
    number = fresh(several, "first_number")
    of_rows = Window.partitionBy(of, text).orderBy(F.to_json(F.struct(*[column(docs, c) for c in docs.columns])))
    several = several.withColumn(number, F.row_number().over(of_rows)).where(F.col(number) == 1).select(*[column(docs, c) for c in docs.columns])
    return single.union(several)

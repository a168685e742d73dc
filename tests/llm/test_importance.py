import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetspark.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def features(text):
    w = words(text)
    return collections.Counter([*w, *(" ".join(p) for p in zip(w, w[1:]))])


def brute_force(docs, target, percent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        for f, n in features(text).items():
            s[bucket(f)] += n
    for text in target:
        for f, n in features(text).items():
            t[bucket(f)] += n
    s_all, t_all = float(sum(s.values())), float(sum(t.values()))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10000) / ((s[b] + 1.0) * (t_all + 10000))))
    out = []
    for i, text in docs:
        own = features(text)
        n, score = sum(own.values()), None
        weight = sum(gain(bucket(f)) * c for f, c in own.items()) // n if n else 0
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(words(text)), n, weight, score, None])
    may = sorted((r for r in out if r[1] >= least and r[0] is not None), key=lambda r: (-r[4], r[0]))
    for rank, r in enumerate(may[: percent * len(may) // 100]):
        r[5] = rank + 1
    return sorted((tuple(r) for r in out), key=str)


def check(spark, docs, target, parts=3, **options):
    sizes = {k: v for k, v in options.items() if k in ("limit", "shard_bytes")}
    aims = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    out = importance.resample(spark.createDataFrame(docs, SCHEMA).repartition(parts), aims, **sizes)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == brute_force(docs, target)
    return got


def invented(n, seed=1, vocabulary=60):
    g = random.Random(seed)
    own = ["".join(g.choice("abcdefgéßü") for _ in range(g.randrange(1, 7))) for _ in range(vocabulary)]
    return [(i, " ".join(g.choice(own) + g.choice(["", ",", ".\n", " - "]) for _ in range(g.randrange(5, 90))).title()) for i in range(n)]


def test_equals_brute_force(spark):
    docs = invented(120)
    check(spark, docs, [t for _, t in invented(9, seed=2)] + [docs[3][1]])


def test_small_blocks_and_many_shards_give_the_same(spark):
    docs = invented(40, seed=5) + [(1000, "lang wort " * 400), (1001, "x" * 900), (1002, " " * 500 + "Ende")]
    check(spark, docs, ["lang wort ende"], limit=64, shard_bytes=128)


def test_nulls_repeats_empty_texts_and_ties(spark):
    text = "ein text " * 15
    docs = [(1, None), (2, ""), (3, " .,"), (None, text), (None, None), (4, text), (4, text), (4, "ganz anders " * 12), (5, text)]
    got = check(spark, docs * 3, ["text", "", None])
    assert sum(r[5] is not None for r in got) == 25 * 12 // 100


def test_empty_tables(spark):
    assert check(spark, [], ["a b c"]) == []
    check(spark, invented(30), [])


def test_other_columns_play_no_part(spark):
    docs, target = spark.createDataFrame(invented(30), SCHEMA), spark.createDataFrame([("ab cd",)], "text string")
    more = docs.withColumns({c: F.lit(1) for c in ("row", "rank", "weight", "_part", "block", "slot", "data")})
    assert sorted(importance.resample(more, target).collect(), key=str) == sorted(importance.resample(docs, target).collect(), key=str)


@pytest.mark.parametrize("limit", [3, 10, 64, 1 << 20])
def test_stretches_hold_every_feature_once(limit):
    g = random.Random(limit)
    for _ in range(60):
        text = "".join(g.choice("aAbZ9 .é漢\n") for _ in range(g.randrange(0, 150)))
        raw = text.encode()
        cut = list(importance.pieces([raw], limit))
        assert cut[0][1] == 0 and cut[-1][3] == len(raw) and all(a[3] == b[1] for a, b in zip(cut, cut[1:]))
        names, _, starts, _, count, n_words, n_features = importance.count_features([raw[c:e] for _, _, c, e in cut], np.array([int(c < s) for _, s, c, _ in cut]))
        total = collections.Counter()
        for name, n in zip(names.to_pylist(), np.add.reduceat(count, starts) if len(starts) else []):
            total[name] += int(n)
        assert total == features(text) and n_words.sum() == len(words(text)) and n_features.sum() == sum(total.values())


def test_a_feature_in_every_document_is_sent_once_a_block(spark):
    docs = spark.createDataFrame([(i, "immer") for i in range(2000)], SCHEMA).coalesce(1)
    sent = importance.as_documents(docs, ["doc_id", "text"]).mapInArrow(importance._blocks(4, 1 << 20), importance._SENT)
    assert sent.where(F.col("kind") == importance.PACK).count() == 1

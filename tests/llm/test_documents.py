"""Operators on documents against brute-force versions, with nulls, empty and very long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetspark.llm import decontamination, language_model, licenses, line_dedup, personal_data, pieces, quality_rules, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark string, words string, label string"


def fixture_docs():
    """Texts of all kinds; every column may be null, and some columns have names that operators use inside."""
    r = random.Random(7)
    vocabulary = [w + s for w in "the of and stone river light holz été ñu".split() for s in ("", "s", "ing", "er")]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = prose(300)
    long = "\n".join(prose(30) for _ in range(700))
    special = [
        None, "", " \n\t ", "word", "two words", "İ K CC BY", "all rights\nreserved. All Rights Reserved!", "cc by cc by",
        "Licensed under the GNU General Public License, version 3. " + prose(20), "x@y.example.com 1.2.3.4 4111 1111 1111 1111 +1 (234) 555-6789",
        base, base, base.replace("stone", "pebble", 1), base + " end", long, "same line here now\n" * 3 + prose(5), prose(60) + "\ncommon footer line of sites\n" + prose(8),
    ]
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 4}", None if t is None else len(t), None, "w", "l") for i, t in enumerate(special)]
    rows += [(100 + i, f"{prose(40)}\ncommon footer line of sites\n{prose(6)}", "en", f"site{i}" if i % 9 else None, 1, "m", None, None) for i in range(30)]
    return [*rows, rows[7], rows[10], (7, "another text under a known id", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return fixture_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def as_set(df):
    return Counter(tuple(r) for r in df.collect())


def test_licenses(docs, rows):
    got = as_set(licenses.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))
    expected = Counter()
    for i, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        at = [(k, label) for label, p in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in at]
        expected[i, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))] += 1
    assert got == expected


def test_notices_with_changed_words_are_found(spark):
    near = licenses.NOTICES["bsd"].replace("source", "sourced", 1)
    df = spark.createDataFrame([(1, f"intro {near} outro"), (2, licenses.NOTICES["mit"].upper()), (3, "redistribution and use of words")], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(df).collect()}
    assert got[1][0] == "bsd" and got[1][1] >= licenses.COVER
    assert got[2] == ("mit", 1.0) and got[3][0] == ""


def test_quality(docs, rows):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    expected = Counter()
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if windows[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)] += 1
    out = quality_rules.apply_rules(docs)
    assert as_set(out.select(*columns)) == expected
    assert out.where("kept and base_failed").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a.@+-% 0123456789()é\n", max_size=60))
def test_personal_data_is_a_leftmost_search(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    keep = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 13 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and personal_data.luhn(d), "phone": lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15}
    expected = [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, text) if keep[k](m[0])]
    assert [s for s in personal_data.spans(text) if s[0] in patterns] == expected


def test_personal_data(docs, rows):
    got = Counter(r["doc_id"] for r in personal_data.digests(docs).collect())
    assert got == Counter(r[0] for r in rows)
    text = "IBAN: GB82 WEST 1234 5698 7654 32, SSN 123-45-6789, token = \"04dbebab91ab85687d33\" https://me:pw@host.example/x"
    assert {k: text[s:e] for k, s, e in personal_data.spans(text) if k not in ("card", "email")} == {"iban": "GB82 WEST 1234 5698 7654 32", "ssn": "123-45-6789", "secret": "04dbebab91ab85687d33", "url_login": "https://me:pw@host.example"}
    assert personal_data.redact("mail a@b.cd now") == "mail [email] now" and personal_data.redact(None) == ""
    assert personal_data.spans("9" * 6000) == []


@pytest.mark.parametrize(("min_sites", "band"), [(5, 0.25), (5, 0.0), (2, 0.25), (1000, 0.25)])
def test_line_dedup(docs, rows, min_sites, band):
    sites, first = defaultdict(set), {}
    may = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x)) >= 1
    marks = {t: i for i, (t, *_) in enumerate((r[1],) for r in rows)}
    for i, t, _, source, *_ in rows:
        for p, x in enumerate((t or "").split("\n")):
            key = x.strip(" \t\r")
            if may(key):
                sites[key] |= {source} - {None}
    for i, t, *_ in rows:
        for p, x in enumerate((t or "").split("\n")):
            key = x.strip(" \t\r")
            if may(key):
                first[key] = min(first.get(key, (i, p, t)), (i, p, t), key=lambda f: f[:2])
    expected = Counter()
    for i, t, *_ in rows:
        keep = [x for p, x in enumerate((t or "").split("\n")) if not (may(k := x.strip(" \t\r")) and len(sites[k]) >= min_sites and first[k] != (i, p, t))]
        expected[i, None if t is None else "\n".join(keep)] += 1
    assert marks and as_set(line_dedup.dedup_lines(docs, min_sites, band).select("doc_id", "text")) == expected


def test_lines_of_documents_without_ids(spark):
    rows = [(i, f"one {i}\nshared", f"s{i}") for i in range(6)] + [(None, "shared\nother", "s9"), (None, "shared\nother", "s9"), (None, "nowhere else", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "7 AS n_lines", "'x' AS n_removed")
    got = as_set(line_dedup.dedup_lines(docs, 5).select("doc_id", "text"))
    assert got == Counter([(0, "one 0\nshared"), *[(i, f"one {i}") for i in range(1, 6)], (None, "other"), (None, "other"), (None, "nowhere else")])
    counted = line_dedup.dedup_lines(docs, 5, counts=True)
    assert sorted(counted.columns) == ["doc_id", "n_lines", "n_removed", "source", "text"]
    assert as_set(counted.where("doc_id is null").select("n_lines", "n_removed")) == Counter([(2, 1), (2, 1), (1, 0)])
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    kept = [r["text"] for r in line_dedup.dedup_lines(nameless, 5).collect() if "shared" in r["text"].split("\n")]
    assert len(set(kept)) == 1


CLASHES = ["_lines", "_drops", "_doc", "_mark", "of_document", "Of_Text", "drop_at", "split_lines", "a.b", "_n", "_kept", "class", "rank", "_row", "doc"]


def test_columns_of_all_names_pass_through(docs):
    more = docs
    for c in CLASHES:
        more = more.withColumn(c, F.col("doc_id"))
    for step in (lambda df: line_dedup.dedup_lines(df, 5), simhash.first_of_group, decontamination_of_nothing, lambda df: language_model.keep_good(df, df.selectExpr("doc_id", "1 AS quality"))):
        got = step(more)
        assert got.columns == more.columns
        assert got.count() and got.where(" or ".join(f"not `{c}` <=> doc_id" for c in CLASHES)).count() == 0


def decontamination_of_nothing(df):
    return decontamination.clean(df, df.sparkSession.createDataFrame([(1, "no such words anywhere at all")], "item_id long, text string"))


@pytest.mark.parametrize("shingle", [3, 5])
def test_fingerprints_by_definition(rows, shingle):
    import xxhash

    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        s = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        expected = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
        assert simhash.fingerprint(t, shingle) == expected


def classes(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates(docs, rows):
    fps = [simhash.fingerprint(r[1]) for r in rows]
    root = classes(fps)
    least = defaultdict(lambda: math.inf)
    for c, r in zip(root, rows):
        least[c] = min(least[c], r[0])
    expected = Counter((r[0], f - (1 << 64) * (f >> 63), least[c]) for r, f, c in zip(rows, fps, root))
    assert as_set(simhash.near_duplicates(docs).select("doc_id", "fp", "component_id")) == expected


def test_near_copies(docs, rows):
    """Against all pairs of documents within three bits of each other's word fingerprint and similar by definition."""
    texts = {}
    for i, t, *_ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        texts.setdefault(i, t)
    unique = [r for r in rows if sum(x[0] == r[0] for x in rows) == 1 or r[1] == rows[10][1]]
    root = {r[0]: r[0] for r in unique}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    words = {r[0]: tokens(r[1]) for r in unique}
    for a in unique:
        for b in unique:
            if a[0] < b[0]:
                x, y = five(a[1]), five(b[1])
                near = bin(simhash.word_fingerprint(words[a[0]]) ^ simhash.word_fingerprint(words[b[0]])).count("1") <= 3
                assert simhash.similar(a[1], b[1]) == (len(x & y) >= 0.8 * len(x | y))
                if words[a[0]] == words[b[0]] or (near and simhash.similar(a[1], b[1])):
                    p, q = sorted((find(a[0]), find(b[0])))
                    root[q] = p
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs.where(F.col("doc_id") != 7)).collect()}
    assert got == {i: find(i) for i in got} and got[11] == got[12] == got[13] == 10
    kept = [(r["doc_id"], r["text"]) for r in simhash.first_of_group(docs).collect()]
    assert len(kept) == len(set(kept)) and {11, 12, 13}.isdisjoint(i for i, _ in kept) and [i for i, _ in kept].count(10) == 1
    assert [t for i, t in kept if i == 7] and {t for i, t in kept if i == 7} == {r[1] for r in rows if r[0] == 7}


def test_first_of_group_keeps_whole_rows(spark):
    text, other = "some words that two rows share", "a text of its own with other words"
    given = [(None, text, {"a": 1}), (3, text, {"b": 2}), (3, text, {"b": 1}), (3, other, None), (None, None, None), (None, "", {"c": 1}), (9, other, {})]
    df = spark.createDataFrame(given, "doc_id long, text string, first_doc map<string, int>")
    kept = simhash.first_of_group(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"], r["first_doc"]) for r in kept.collect()), key=str)
    assert [x for x in got if x[0] == 3] == [(3, other, None), (3, text, {"b": 1})] and len(got) == 3 and not [x for x in got if x[0] is None][0][1]


def test_links_lose_nothing_in_dense_groups(spark):
    r, fps = random.Random(5), {0, 1, 7, 15, (1 << 64) - 1, 3 << 62, 5 << 43}
    for _ in range(25):
        c = r.getrandbits(64)
        fps.add(c)
        for _ in range(20):
            x = c
            where = range(64) if r.random() < 0.5 else range(*r.choice([(0, 22), (22, 43), (43, 64)]))
            for b in r.sample(where, r.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) * (f >> 63) for f in fps]
    expected = defaultdict(set)
    for c, s in zip(classes(fps), signed):
        expected[c].add(s)
    got = defaultdict(set)
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    assert links.count() < 60 * len(fps)
    for u, v in simhash.components(links).collect():
        got[v] |= {u, v}
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in expected.values() if len(x) > 1}


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeinrst  \n\t▁.,0é漢"), st.characters(exclude_categories=["Cs"])), max_size=50))
def test_encoding_equals_the_library(library, text):
    codec = pieces.codec(pieces.default_model())
    ids = codec.encode(text)
    assert ids == library.encode(text) and codec.decode(ids) == library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 300)), max_size=12))
def test_decoding_equals_the_library(library, ids):
    assert pieces.codec(pieces.default_model()).decode(ids) == library.decode(ids)


def test_pair_tests_along_spines_equal_the_procedure(library):
    codec, r = pieces.codec(pieces.default_model()), random.Random(1)
    ids = [i for p, i in codec.id.items() if pieces.SPACE not in p[1:]]
    own = r.sample([i for i in ids if codec.piece[i][0] != pieces.SPACE], 400)
    for a, b in [(r.choice(ids), r.choice(own)) for _ in range(4000)] + [(a, b) for a in own[:40] for b in own[:40]]:
        assert codec.compatible(a, b) == (codec.halves(a) is not None and codec.replayed(a, b))


def test_caches_turn_over_and_bad_bytes_are_many(library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 7)
    codec = pieces.Codec(pieces.default_model())
    text = " ".join(f"{a}{b}" for a in "abcdefgh" for b in ("in", "on", "", "é漢")) * 3
    assert codec.encode(text) == library.encode(text) and len(codec.packed) <= 7
    bad = [codec.bytes[0xC3]] * 5000
    assert codec.decode(bad) == "\ufffd" * 5000


def test_encoding(docs, rows, library):
    got = as_set(pieces.digests(docs))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == Counter((r[0], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else "")) for r in rows for ids in [library.encode(r[1] or "")])
    encoded = pieces.encode(docs)
    assert as_set(pieces.decode(encoded)) == Counter((r[0], library.decode(library.encode(r[1] or "")) if r[1] else "") for r in rows)
    assert library.encode(" " * 500 + "x") == pieces.codec(pieces.default_model()).encode(" " * 500 + "x")


def tokens(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())


def five(t):
    w = tokens(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_decontamination(spark, docs, rows):
    text = {r[0]: r[1] for r in rows}
    w = text[14].split()
    items = [(1, " ".join(w[500:540])), (2, " ".join(w[900:930] + ["new"] * 3)), (3, " ".join(w[10:25] + ["other"] * 9)), (4, "word"), (5, None), (6, ""), (1, " ".join(w[500:540])), (7, "Two, words")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = set()
    for i, t, *_ in rows:
        for item, x in items:
            own = five(x)
            shared = own & five(t)
            if shared and len(shared) >= 0.8 * len(own) - 1e-9:
                expected.add((i, item, len(shared), len(own)))
    got = as_set(decontamination.leaks(docs, benchmark).select("doc_id", "item_id", "n_shared", "n_item"))
    assert got == Counter(expected) and {14, 3} <= {i for i, *_ in expected}
    left = decontamination.clean(docs, benchmark)
    assert left.columns == docs.columns or set(left.columns) == set(docs.columns)
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(r[0] for r in rows if r[0] not in {i for i, *_ in expected})


def brute_force_model(texts):
    """Interpolated modified Kneser-Ney over pairs of words, by its formulas: the probability of a word after another."""
    pairs = Counter(p for t in texts for s in [["<", *t.split(), ">"]] if len(s) > 2 for p in zip(s, s[1:]))
    before = Counter(w for _, w in pairs)

    def discounts(counts):
        of = Counter(counts.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + of[2] else None
        return [max(language_model.LEAST_DISCOUNT, min(float(k), k - (k + 1) * y * of[k + 1] / of[k] if of[k] and y is not None else k / 2)) for k in (1, 2, 3)]

    high, low = discounts(pairs), discounts(before)
    off = lambda d, k: d[min(k, 3) - 1] if k else 0
    n = sum(before.values())
    unknown = sum(off(low, k) for k in before.values()) / n / (len(before) + 1)

    def p(v, w):
        own = {x: k for (u, x), k in pairs.items() if u == v}
        shorter = (before[w] - off(low, before[w])) / n + unknown
        if not own:
            return shorter
        total = sum(own.values())
        return (own.get(w, 0) - off(high, own.get(w, 0))) / total + sum(off(high, k) for k in own.values()) / total * shorter

    p.words = [*before, "never seen"]
    return p


TRAIN = ["the stone, the river", "the rivers\nof Stone 12", "of the river of the stone of the river", "the the stone", "", "a river a stone a hill of the hill"]


@pytest.mark.parametrize(("hot", "shard", "block"), [(1 << 19, 1 << 18, 500), (0, 3, 2), (6, 1 << 18, 1), (4, 2, 500)])
def test_language_model_against_its_formulas(spark, monkeypatch, hot, shard, block):
    """However many weights are broadcast or stand in a shard, and in however many blocks the documents are."""
    monkeypatch.setattr(language_model, "BLOCK", block)
    rows = [(i, t, lang) for lang in ("en", "de") for i, t in enumerate(TRAIN if lang == "en" else TRAIN[:2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    weights, unknown = language_model.train(docs)
    probe = [*TRAIN, "$$$ unseen", "a", "of of of of", None, " ", "the stone " * 500]
    df = spark.createDataFrame([(100 * k + i, t, lang) for k, lang in enumerate(("en", "de", "xx")) for i, t in enumerate(probe)], "doc_id long, text string, lang string").repartition(3)
    scored = language_model.score(df, weights, unknown, hot, shard).collect()
    assert len(scored) == 3 * len(probe)
    models = {"en": brute_force_model(TRAIN), "de": brute_force_model(TRAIN[:2])}
    for r in scored:
        words = (probe[r["doc_id"] % 100] or "").split()
        assert r["n_words"] == len(words) and r["lang"] == ("en", "de", "xx")[r["doc_id"] // 100]
        if not words or r["lang"] == "xx":
            assert r["nll"] is None
        else:
            s = ["<", *words, ">"]
            assert r["nll"] == pytest.approx(-sum(math.log(models[r["lang"]](*x)) for x in zip(s, s[1:])) / (len(s) - 1), abs=1e-4)
    for v in ("the", "of", "never seen"):
        assert sum(models["en"](v, w) for w in models["en"].words) == pytest.approx(1)


def test_classifier(spark, docs, none):
    r = random.Random(3)
    good = lambda: " ".join(r.choice("the stone river lights of holding waters".split()) for _ in range(60))
    texts = [(i, good(), "en") for i in range(60)] + [(100 + i, good().upper().replace(" ", "!! "), "en") for i in range(10)] + [(200, None, "en"), (201, good(), "xx"), (202, good(), None)]
    labels = spark.createDataFrame([(i, 1 if i < 50 else None) for i in range(60)] + [(0, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    kept = {x["doc_id"]: x["kept"] for x in language_model.classify(df, labels).collect()}
    assert sum(kept[i] for i in range(60)) >= 58 and not any(kept[100 + i] for i in range(10))
    assert not kept[200] and kept[201] and kept[202]
    left = language_model.keep_good(df, labels)
    assert left.columns == df.columns and left.count() == sum(kept.values())
    assert language_model.classify(docs, labels).count() == docs.count()
    assert language_model.classify(none, labels.limit(0)).count() == 0
    assert language_model.classify(docs, labels.limit(0)).where("kept").count() == docs.where("text rlike '[^ \\n\\t]'").count()


def test_limits_are_quantiles_by_language(spark):
    sf = "/root/testdata/sf0.01"
    df, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    trusted = language_model.trusted_ids(labels)
    known = language_model._texts(df).join(trusted, "doc_id", "left_semi")
    seen = {r["doc_id"] for r in language_model.drawn(known, language_model.TRAINING_SHARE).collect()}
    ids = {r["doc_id"] for r in trusted.collect()}
    out = [r for r in language_model.classify(df, labels).collect()]
    for lang in {r["lang"] for r in out}:
        own = [r for r in out if r["lang"] == lang and r["doc_id"] in ids and r["perplexity"] is not None]
        new = [r for r in own if r["doc_id"] not in seen]
        mean = sum(math.log(r["perplexity"]) * (r["n_words"] + 1) for r in new) / sum(r["n_words"] + 1 for r in new)
        score = lambda r: round((math.log(r["perplexity"]) * (r["n_words"] + 1) + mean * language_model.PRIOR) / (r["n_words"] + 1 + language_model.PRIOR), 3)  # noqa: E731, B023
        q = language_model.QUANTILE
        low, high = np.quantile([score(r) for r in own], 1 - q) - language_model.MARGIN, np.quantile([score(r) for r in new], q) + language_model.MARGIN
        assert 0 < len(new) < len(own)
        for r in out:
            if r["lang"] == lang:
                assert (r["low"], r["high"]) == (pytest.approx(low, abs=2e-3), pytest.approx(high, abs=2e-3))
                assert r["kept"] == (r["perplexity"] is not None and r["low"] <= r["score"] <= r["high"])
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    kept = {r["doc_id"] for r in out if r["kept"]}
    assert len(bad - kept) >= 0.6 * len(bad) and len(ids & kept) >= 0.99 * len(ids)


def test_empty_tables(spark, none):
    benchmark = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    for out in (licenses.scan(none), quality_rules.apply_rules(none), personal_data.digests(none), line_dedup.dedup_lines(none), simhash.near_duplicates(none), simhash.first_of_group(none), pieces.digests(none), decontamination.leaks(none, benchmark), decontamination.clean(none, benchmark)):
        assert out.count() == 0


def test_empty_benchmark(docs, spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(docs, empty).count() == 0 and decontamination.clean(docs, empty).count() == docs.count()


def test_templates_of_any_length(spark):
    r = random.Random(2)
    terms = " ".join(f"term{r.randrange(300)}" for _ in range(900))
    changed = terms.split()
    del changed[400], changed[100]
    df = spark.createDataFrame([(1, "x " + terms + " y"), (2, " ".join(changed)), (3, " ".join(changed[:600]))], "doc_id long, text string")
    assert {x["doc_id"]: x["labels"] for x in licenses.scan(df, {"terms": terms}).collect()} == {1: "terms", 2: "terms", 3: ""}
    assert {x["doc_id"]: x["labels"] for x in licenses.scan(df, {"terms": " ".join(terms.split()[:120])}).collect()} == {1: "terms", 2: "terms", 3: "terms"}


def test_identifiers_after_any_separators_and_names():
    found = lambda text: [(k, text[s:e]) for k, s, e in personal_data.spans(text) if k in ("iban", "ssn", "secret")]
    account, key = "DE89 3704 0044 0532 0130 00", "abcd1234efgh5678"
    for text in ("IBAN:" + " " * 500 + account, f"IBAN number {account}", f"pay to {account} AND NOTHING ELSE", f"({account})", account.replace(" ", "")):
        assert [k for k, _ in found(text)] == ["iban"] and found(text)[0][1].replace(" ", "") == account.replace(" ", "")
    for text in (f"x{account}", account.replace("89", "88", 1), account[:-1], account + "1", "ZZ89 3704 0044 0532 0130 00"):
        assert found(text) == []
    for cue in ("api-key: ", "api-key      =     ", "password is ", "the password was: ", "access_key\n\n\n:\n\n\n", "secret key = "):
        assert found(cue + key) == [("secret", key)], cue
    for cue in ("SSN" + " " * 100, "social security number is ", "ssn no. : "):
        assert found(cue + "123-45-6789") == [("ssn", "123-45-6789")], cue
    assert found("the password is incomprehensibilities") == found("token " + key) == []
    start = time.monotonic()
    for text in ("token" + " " * 1_000_000, "password is " * 100_000, "DE89 " * 200_000, "ssn ssn" + " :" * 500_000):
        assert found(text) == []
    assert time.monotonic() - start < 20


def test_personal_data_of_all_spellings_and_lengths():
    for cue in ("API key", "api KEY", "Access Key", "PassWord", "TOKEN"):
        assert personal_data.spans(f"{cue}: abcd1234efgh5678")[-1] == ("secret", len(cue) + 2, len(cue) + 18)
    scheme = "a" * 400 + "+b"
    assert personal_data.spans("12 " + scheme + "://user:pw@host.org")[-1] == ("url_login", 3, 3 + len(scheme) + 19)
    start = time.monotonic()
    assert personal_data.spans("token=" * 100_000) == [] and time.monotonic() - start < 5
    assert [s for s in personal_data.spans("token=token=" + "x" * 20 + "9") if s[0] == "secret"] == [("secret", 6, 33)]

"""The pipeline's stages against brute-force versions of their decisions, each on its own input."""

import re
from collections import defaultdict

import pytest
import sentencepiece

import corpus_pipeline
from facetspark.llm import pieces, simhash
from facetspark.llm.common import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        after = stage(step(spark, docs, SF), name)
        out.append((name, docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return {name: rest for name, *rest in out}


def test_names_and_columns(results):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    for name, (_, _, before, after) in list(results.items())[:-1]:
        assert set(after) == set(before), name


def test_quality_keeps_trusted_documents(spark, results):
    before, after, *_ = results["quality_classifier"]
    trusted = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    kept = {r["doc_id"] for r in after}
    assert len({r["doc_id"] for r in before} & trusted - kept) <= 1
    junk = {r["doc_id"] for r in before if re.search(r"[#*$%&]{3}.*[#*$%&]{3}", r["text"] or "", re.S)}
    assert len(junk) > 5 and len(junk & kept) <= 0.2 * len(junk)


def test_line_dedup(results):
    before, after, *_ = results["line_dedup"]
    sites, first = defaultdict(set), {}
    may = lambda x: not x.isspace() and x != ""
    for r in sorted(before, key=lambda r: r["doc_id"]):
        for p, x in enumerate(r["text"].split("\n")):
            sites[x.strip(" \t\r")].add(r["source"])
            first.setdefault(x.strip(" \t\r"), (r["doc_id"], p))
    expected = {r["doc_id"]: "\n".join(x for p, x in enumerate(r["text"].split("\n")) if not (may(k := x.strip(" \t\r")) and len(sites[k]) >= 10 and first[k] != (r["doc_id"], p))) for r in before}
    assert {r["doc_id"]: r["text"] for r in after} == expected and all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_duplicates(results):
    """All pairs with a similarity of 0.8 or more are near copies, however far apart their fingerprints are."""
    before, after, *_ = results["simhash_near_dedup"]
    texts = {r["doc_id"]: r["text"] for r in before}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if simhash.similar(texts[i], texts[j]):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    assert sorted(r["doc_id"] for r in after) == sorted({find(i) for i in ids})


def test_decontamination(spark, results):
    before, after, *_ = results["benchmark_decontamination"]
    five = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())] for i in range(max(1, len(w) - 4))}
    items = [five(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in before if not any(len(s & five(r["text"])) >= 0.8 * len(s) - 1e-9 for s in items)}
    assert {r["doc_id"] for r in after} == clean


def test_encoding_and_run(spark, results):
    before, after, *_ = results["sentencepiece_encoding"]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    expected = {r["doc_id"]: library.encode(r["text"]) if r["text"] else [] for r in before}
    assert {r["doc_id"]: r["ids"] for r in after} == expected and all(r["n_tokens"] == len(r["ids"]) for r in after)
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()} == expected


def test_empty_and_null_documents_go_through_all_stages(spark):
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    nulls = spark.createDataFrame([(None, None, None, None, None), (None, "a text without an id", "en", "src0", 20), (9, None, None, "src1", None)], whole.schema)
    for docs, least in ((whole.limit(0), 0), (nulls.union(whole.limit(5)), 2)):
        for name, step in corpus_pipeline.STAGES:
            docs = stage(step(spark, docs, SF), name)
        assert docs.count() >= least
        assert least == 0 or [r["n_tokens"] for r in docs.where("doc_id is null").collect()][-1:] != []

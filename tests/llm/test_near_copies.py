"""near_copies against all pairs of texts."""

import random

import pytest

from facetspark.llm import simhash


def classes(texts, bits=64):
    """The least text of each text's class, by all pairs that are similar and whose word fingerprints differ in at most bits."""
    root = list(range(len(texts)))
    fps = [simhash.word_fingerprint(simhash._words(t)) for t in texts]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(texts):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits and simhash.similar(a, texts[j]):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return [find(i) for i in range(len(texts))]


def edited(r, words, n):
    out = list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = f"new{r.randrange(10**6)}"
    return " ".join(out)


def copies(at, n=60):
    """A text at place at, and copies that are similar to it but mostly not to each other."""
    r = random.Random(3)
    words = [f"w{r.randrange(400)}" for _ in range(300)]
    texts = [edited(r, words, 5) for _ in range(n - 1)]
    return [*texts[:at], " ".join(words), *texts[at:]]


def got(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    return [found[i] for i in range(len(texts))]


@pytest.mark.parametrize("at", [0, 30, 59])
def test_every_colliding_pair_is_compared(spark, at):
    """However many texts collide, and whichever of them are least."""
    texts = copies(at)
    found, least = got(spark, texts), classes(texts, simhash.RADIUS)
    assert all(found[i] == found[least[i]] for i in range(len(texts))) and len(set(least)) < len(texts) - 9


def test_texts_on_one_fingerprint_are_compared_with_one_another(spark):
    """The least of them has the same words in another order, so it is similar to none."""
    words = [f"w{i}" for i in range(200)]
    other = list(words)
    random.Random(5).shuffle(other)
    swapped = [*words[:100], words[101], words[100], *words[102:]]
    texts = [" ".join(x) for x in (other, words, swapped)]
    assert len({simhash.word_fingerprint(x.split()) for x in texts}) == 1 and got(spark, texts) == [0, 1, 1]


def test_pairs_that_links_leaves_out_are_compared(spark):
    texts = copies(59)
    fps = [simhash.word_fingerprint(simhash._words(t)) for t in texts]
    df = spark.createDataFrame([(f - (1 << 64) * (f >> 63),) for f in set(fps)], "fp long")
    linked = {frozenset((r["u"] % (1 << 64), r["v"] % (1 << 64))) for r in simhash.links(df).collect()}
    found = got(spark, texts)
    near = [(i, j) for i in range(60) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= simhash.RADIUS and simhash.similar(texts[i], texts[j])]
    out = [(i, j) for i, j in near if fps[i] != fps[j] and frozenset((fps[i], fps[j])) not in linked]
    assert out and all(found[i] == found[j] for i, j in out)


def test_similar_texts_are_found_whatever_their_fingerprints(spark):
    texts = copies(30) + ["", "one two", "one two", "one two three"]
    assert len(set(classes(texts, simhash.RADIUS))) > len(set(classes(texts))) and got(spark, texts) == classes(texts)


def test_parities_rule_no_similar_pair_out():
    r = random.Random(9)
    for n in (0, 1, 5, 100, 600, 3000):
        for _ in range(60):
            own = [r.getrandbits(64) for _ in range(n)]
            k = r.randrange(n + 1)
            other = own[: n - k] + [r.getrandbits(64) for _ in range(r.randrange(k + 1))]
            x, y = (simhash.np.unique(simhash.np.array(s, simhash.np.uint64)) for s in (own, other))
            both = len(set(own) & set(other))
            if both >= 0.8 * (len(x) + len(y) - both):
                assert simhash.may_be_similar(simhash.parities(x), simhash.parities(y), len(x) + len(y), 0.8)
    x, y = (simhash.np.array([r.getrandbits(64) for _ in range(500)], simhash.np.uint64) for _ in range(2))
    assert not simhash.may_be_similar(simhash.parities(x), simhash.parities(y), 1000, 0.8)

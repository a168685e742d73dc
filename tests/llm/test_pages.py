import base64
import gzip
import hashlib
import random
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetspark.llm import archives, html_text

PAGES = [
    (1, "http://a.example/x", "<p>one</p>"), (2, "http://a.example/y z", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "u\nv", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"),
    (0, "late", "<p>one</p>"), (6, "long", "y\n" * 40_000), (6, "long", "y\n" * 40_000), (-7, "neg", "été 🙂"), (8, "o", "été 🙂"),
    (11, "a", "<p>one</p>"), (11, "a", "only here"), (11, "b", ""), (None, "none", "<p>one</p>"), (None, "none", "no page with a number has it"), (None, None, None),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "digest", 5) for p in PAGES], "page_id long, url string, html string, digest string, n int")


@pytest.mark.parametrize("min_bytes", [0, 9])
def test_archives_round_trip(pages, min_bytes):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    least = {}
    for i, _, h in PAGES:
        if i is not None:
            least[digest(h)] = min(least.get(digest(h), i), i)
    expected = Counter()
    for i, _, h in PAGES:
        d, n = digest(h), len((h or "").encode())
        again = n >= min_bytes and d in least and least[d] != i
        expected[i, n, d, "revisit" if again else "response", least[d] if again else None] += 1
    got = archives.round_trip(pages, min_bytes)
    assert Counter(tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == expected
    assert archives.round_trip(pages.limit(0)).count() == 0


RECORDS = st.builds(archives.Record, st.text(st.characters(exclude_categories=["Cs", "Cc", "Zl", "Zp"]), min_size=1, max_size=20).filter(lambda s: s != "-" and s == s.strip() and not s.startswith("filedesc://")), st.just("19960102030405"), st.just("text/html"), st.binary(max_size=60), st.none())


@settings(max_examples=150, deadline=None)
@given(st.lists(RECORDS, max_size=4), st.sampled_from([1, 2]))
def test_arc_files_keep_their_records(records, version):
    back = list(archives.parse_arc(archives.write_arc(records, version)))
    assert [(r.url, r.date, r.kind, r.payload) for r in back] == [(r.url, r.date, r.kind, r.payload) for r in records]


def test_legacy_files_with_any_bytes(spark, tmp_path):
    payloads = ["déjà vu".encode("latin-1"), bytes(range(256)) * 3, b"", b"\0\r\n\r\nWARC/1.1", b"z" * (17 << 20)]
    records = [archives.Record(f"http://x.example/{i}", "19970506", "image/gif", p) for i, p in enumerate(payloads)]
    for version in (1, 2):
        (tmp_path / "in").mkdir(exist_ok=True)
        whole = archives.write_arc(records, version)
        (tmp_path / "in" / f"{version}.arc").write_bytes(gzip.compress(whole) if version == 2 else whole)
    archives.convert_archives(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    got = archives.read_archives(spark, f"file://{tmp_path}/out").collect()
    assert Counter((r["url"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter({(r.url, len(r.payload), archives.sha1(r.payload)): 2 for r in records})
    files = [f.read_bytes() for f in (tmp_path / "out").glob("part-*")]
    back = [archives.parse_warc(gzip.decompress(f)) for f in files]
    assert sorted(block.partition(b"\r\n\r\n")[2] for f in back for _, block in f) == sorted(payloads * 2)
    first = next(archives.unpacked(files[0]))
    assert first.startswith(b"WARC/1.1") and len(list(archives.parse_warc(first))) == 1


def test_members_are_unpacked_without_the_rest_of_their_file(monkeypatch):
    """Each member's unpacking took a copy of all that follows it, so that a file cost the square of its length."""
    members = [archives.member(bytes(random.Random(i).choices(range(256), k=700 * (i % 9)))) + b"\0" for i in range(200)]
    whole, held, taken, own = b"".join(members), [gzip.decompress(m) for m in members], [], zlib.decompressobj

    class Counting:
        def __init__(self, bits):
            self.one = own(bits)

        def decompress(self, piece):
            taken.append(len(piece))
            return self.one.decompress(piece)

        def __getattr__(self, name):
            return getattr(self.one, name)

    monkeypatch.setattr(archives.zlib, "decompressobj", Counting)
    out = list(archives.unpacked(whole))
    assert [x for x in out if x] == held
    assert sum(taken) <= len(whole) + archives.PIECE * len(out)
    with pytest.raises(ValueError):
        list(archives.unpacked(whole[:-40]))
    assert list(archives.unpacked(b"WARC/1.1")) == [b"WARC/1.1"]


@given(st.one_of(st.none(), st.integers(-(1 << 63), (1 << 63) - 1)))
def test_record_ids_tell_their_numbers(number):
    assert archives.number_of(archives.record_id(number)) == number


def test_broken_files_are_refused():
    whole = archives.write_arc([archives.Record("u", "1999", "text/plain", b"abc")])
    for broken in (whole[:-3], whole[10:], b"x\n", whole.replace(b"1 0 Example", b"9 0 Example")):
        with pytest.raises(ValueError):
            list(archives.parse_arc(broken))
    with pytest.raises(ValueError):
        list(archives.parse_warc(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"))
    assert archives.iso_date("1999") == "1999-01-01T00:00:00Z" and archives.iso_date("19960102030405") == "1996-01-02T03:04:05Z"


def test_held_out_pages():
    field, right, blocks, whole = html_text.default_field(), 0, 0, 0
    pages = html_text.labelled_pages(200, seed=99)
    for page, truth in pages:
        found = html_text.labelled_blocks(page, truth)
        labels = field.decode(html_text.features(found))
        hits = [a == b.label for a, b in zip(labels, found)]
        right, blocks, whole = right + sum(hits), blocks + len(hits), whole + all(hits)
    assert right / blocks > 0.99 and whole / len(pages) > 0.93


PAGE = """<html><head><title>No</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>menu</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div>
<article><h1>Title &amp; more&amp</h1><p><b>First <i>line</i>.<br><p>Second\n  line&nbsp;here.<ul><li>Point one.</li></ul></article>
<section class="comments"><h2>Comments</h2><p>I agree with all of this.</p></section><footer>&copy; site</footer>"""


def test_main_text():
    assert html_text.extract(PAGE, html_text.default_field()) == "Title & more& First line. Second line here. Point one."


def test_attributes_of_any_length():
    long = "x>" * 10_000
    page = f"<article><p>One.<img alt=\"{long}\" title='{long}'><p class=a data-x='{{\"class\": \"advert\"}}'>Two \"quoted\".<a \"odd>three</a> a=\"b</article>"
    assert [b.text for b in html_text.blocks(page)] == ["One.", 'Two "quoted".three a="b'] and not any(b.inside.all_hints for b in html_text.blocks(page))
    assert html_text.blocks("<p>seen<p class=\"cut> gone </p>")[-1].text == "seen"
    start = time.monotonic()
    html_text.blocks("<a b=\"><c d='" * 200_000)
    html_text.blocks("<a \"><b\" \">" * 200_000)
    assert time.monotonic() - start < 20


def texts(page):
    return [b.text for b in html_text.blocks(page)]


def test_pages_without_optional_tags():
    assert texts("<head><title>x</title><article><p>Hello there.") == ["Hello there."]
    assert texts("<title>x</title><meta charset=utf-8><script>var a = '<p>';</script><p>One.<p>Two.") == ["One.", "Two."]
    assert texts("<head>\n<style>p{}</style></head>\n<body>y") == ["y"]


def test_drawings_take_no_text_with_them():
    assert texts('<p>One <svg width="1"/> two.</p><p>Three') == ["One two.", "Three"]
    assert texts("<svg><svg><text>no</text></svg>no</svg>yes") == texts("<svg><foreignObject><p>no</p></foreignObject>no</svg>yes") == ["yes"]
    assert texts("<p>a<svg><g><title>q</title><p>broke out</p>after") == ["a", "broke out", "after"]
    assert texts("<math><mi>x</mi></math>yes<template><template>no</template>no</template> too") == ["yes too"]
    assert texts("<svg/><svg><style>a > b</style>") == []


def test_character_references_of_any_length():
    assert texts("&#" + "9" * 6000 + ";x &#00000000065;&#x00000000042; &#x110000000;") == ["\ufffdx AB \ufffd"]


def test_nesting_is_read_in_linear_time():
    n, start = 100_000, time.monotonic()
    found = html_text.blocks("<div class=menu>x" * n)
    names = html_text.features(found)
    assert len(found) == len(names) == n and "hint:menu" in names[-1] and time.monotonic() - start < 10
    start = time.monotonic()
    assert len(html_text.blocks("<div>x" * n + "</p>" * n + "</div>" * n)) == n
    for page in ("<svg>x", "<template>x", "<svg><p>x", "<div><svg><title>", "<math><script>", "<select><title></p>"):
        html_text.blocks(page * n)
    assert time.monotonic() - start < 20


def test_pages_without_semantic_tags_and_names():
    page = """<html><body><div><ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul></div>
    <div><p>The first paragraph tells of a long walk along the river.</p><p>The second one tells of the way back, which was longer.</p></div>
    <div>&copy; 2020 Somebody</div></body></html>"""
    assert html_text.extract(page, html_text.default_field()) == "The first paragraph tells of a long walk along the river. The second one tells of the way back, which was longer."


class Articles(HTMLParser):
    """Brute force for pages with one article each: the blocks inside it."""

    def __init__(self):
        super().__init__()
        self.inside, self.skipped, self.blocks = False, 0, [""]

    def handle_starttag(self, tag, _):
        self.inside |= tag == "article"
        self.skipped += tag in ("script", "style")
        if tag in html_text.BLOCKS or tag == "br":
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.skipped -= tag in ("script", "style")
        if tag in html_text.BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.blocks[-1] += data


def test_the_query_against_another_parser(spark):
    from facetspark.llm import queries

    sf, expected = "/root/testdata/sf0.01", {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        parser = Articles()
        parser.feed(r["html"])
        parser.close()
        expected[r["page_id"]] = r["url"], " ".join(t for b in parser.blocks if (t := " ".join(b.split())))
    got = {r["page_id"]: (r["url"], r["text"]) for r in queries.op8_html_text(spark, sf).collect()}
    wrong = [i for i in expected if got[i] != expected[i]]
    assert set(got) == set(expected) and len(wrong) <= 0.01 * len(got), wrong


def test_viterbi_is_the_best_path():
    field = html_text.default_field()
    names = html_text.features(html_text.blocks(PAGE))[:9]
    scores, n = field.scores(names), len(names)
    value = lambda ys: field.start[ys[0]] + sum(scores[i][y] for i, y in enumerate(ys)) + sum(field.step[a, b] for a, b in zip(ys, ys[1:]))
    best = max(([m >> i & 1 for i in range(n)] for m in range(1 << n)), key=value)
    assert value(field.decode(names)) == pytest.approx(value(best))


def test_pages_of_all_kinds(spark):
    odd = [None, "", "<", "<p", "<!-- x", "</p>plain words here.", "<script>", "<div " * 3000, "<p>" * 5000 + "x", "<article><p>" + "Words go on. " * 20_000 + "</article>"]
    df = spark.createDataFrame([(i, None, h, "t") for i, h in enumerate(odd)] * 2, "page_id long, url string, html string, text string")
    got = html_text.main_text(df).collect()
    assert Counter(r["page_id"] for r in got) == Counter({i: 2 for i in range(len(odd))})
    by = {r["page_id"]: r for r in got}
    assert by[0]["text"] == by[1]["text"] == "" and by[9]["n_chars"] == len("Words go on. " * 20_000) - 1
    assert html_text.main_text(df.limit(0)).count() == 0

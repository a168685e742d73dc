"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes its leaf blocks in page order: the texts between the starts and ends of block elements, each with its
open elements. Features of a block are its ancestors' tags, kinds of words in their classes, ids and roles, and shapes
of its text (length, link density, punctuation, place). The field has two labels, main text and the rest, weights for
feature and label and for neighbouring labels; it is trained on labelled pages (`labelled_pages`, made by rule with
known truth, `TRAINING_PAGES` of them) by gradient ascent on the regularised likelihood, once on the driver, and is
decoded by Viterbi on the executors. The weights, a few hundred numbers, are all that is broadcast.

Each page is one row's work, nothing is shuffled. Defined results: a null or empty html, or one without main text,
gives an empty text; unclosed elements end with the page, stray ends are skipped, and a cut tag, quoted value or
comment is markup to the page's end; html, head and body need no tags; drawings and formulas (svg, math) end with their
own end, when closed by themselves, or at an element that can't stand in them. Pages, attributes, texts and nesting of
any length are read whole in linear time: open elements are a chain that blocks share, and what features ask of a
block's ancestors is kept with each element. Equal rows stay separate rows; an empty table gives an empty table; only
page_id, url and html are read.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from facetspark.llm.common import arrow_rows, as_documents

TRAINING_PAGES = 400
TRAINING_STEPS = 150
SEED = 11
#: Elements that begin and end blocks, elements without an end, elements whose content is no text.
BLOCKS = frozenset("address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea select title".split())
#: Elements whose content is no text, with elements of their own kind inside; those that may be closed by themselves;
#: elements that end these, and those in them that hold HTML again.
NESTED = frozenset("svg math template object".split())
FOREIGN = frozenset("svg math".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: Starts that end an open element of the same kind.
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCKS - {"body", "html", "button", "label", "title"}
ANCESTORS = ("article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "div", "figure", "figcaption", "blockquote", "pre", "p", "h1", "h2", "h3", "button", "label", "dl", "dialog", "address")
#: Kinds of words in classes, ids and roles.
HINTS = {
    "advert": "ad ads advert advertisement adsense banner promo promoted sponsor sponsored dfp",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip",
    "side": "sidebar side aside widget rail complementary related recommended trending popular more",
    "comment": "comment comments commentlist reply replies disqus discussion respond reader",
    "foot": "footer foot copyright contentinfo legal colophon",
    "head": "masthead topbar header logo branding site",
    "notice": "cookie cookies consent notice gdpr popup modal alert overlay toast message warning",
    "share": "share sharing social follow tags meta byline",
    "form": "form login signup signin subscribe newsletter search register",
    "text": "content article post entry story body main maincontent text articlebody prose",
}
_HINT = {w: k for k, ws in HINTS.items() for w in ws.split()}
#: A quote opens a value only behind an equals sign, and one that isn't closed is markup to the page's end; nothing is
#: ever scanned twice.
_QUOTED = r"=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]|{_QUOTED})*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)|</[^>]*+(?:>|\Z)|([^<]++)|(<)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|(\S++))?+)?+")
_NOTICE = re.compile(r"©|\(c\)|copyright|all rights reserved", re.I)
#: Words from which a block with a copyright notice is more than the notice.
NOTICE_WORDS = 64
_SPACE = re.compile(r"[\s\x1c-\x1f]+")


@dataclass(frozen=True, eq=False, slots=True)
class Element:
    """An open element and what its ancestors and itself have: known tags and hints."""

    parent: Element | None
    tag: str
    hints: frozenset
    tags: frozenset = frozenset()
    all_hints: frozenset = frozenset()

    def child(self, tag: str, hints: frozenset) -> Element:
        tags = self.tags if tag in self.tags or tag not in ANCESTORS else self.tags | {tag}
        return Element(self, tag, hints, tags, self.all_hints if hints <= self.all_hints else self.all_hints | hints)


#: What stands outside all elements.
ROOT = Element(None, "", frozenset())


@dataclass
class Block:
    """inside: the innermost element that is open, with its chain of parents up to ROOT."""

    inside: Element
    text: str
    linked: int
    label: int | None = None


def _hints(attributes: str) -> frozenset:
    if not attributes or attributes.isspace():
        return frozenset()
    return _known_hints(attributes) if len(attributes) < 256 else _found_hints(attributes)


def _found_hints(attributes: str) -> frozenset:
    found = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        if name.lower() in ("class", "id", "role"):
            for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
                if w in _HINT:
                    found.add(_HINT[w])
        elif name.lower() == "hidden" or name.lower() == "style" and "display:none" in value.replace(" ", "").lower():
            found.add("hidden")
    return frozenset(found)


_known_hints = functools.lru_cache(4096)(_found_hints)


def _after_raw(page: str, tag: str, at: int) -> int:
    """Where the content of a raw element that begins at `at` ends: at its end tag, or with the page."""
    close = _raw_end(tag).search(page, at)
    return close.start() if close else len(page)


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I)


def _after_nested(page: str, tag: str, at: int) -> int:
    """Where the content of an element of NESTED that begins at `at` ends: behind its own end, those of its kind in it
    counted, or, for a foreign one, before an element that can't stand in it."""
    depth, html, foreign = 1, [], tag in FOREIGN
    while at < len(page):
        m = _TOKEN.match(page, at)
        inner, closed = (m[2] or "").lower(), foreign and (m[3] or "").endswith("/")
        if m[1]:
            depth -= inner == tag
            if html and inner == html[-1]:
                html.pop()
        elif inner and foreign and not html and inner in BREAKOUT:
            return at
        elif inner and not closed:
            depth += inner == tag
            if foreign and inner in HOLDS_HTML:
                html.append(inner)
            elif inner in RAW and not (foreign and not html and inner != "script"):
                at = _after_raw(page, inner, m.end())
                continue
        at = m.end()
        if not depth:
            return at
    return at


def _number(m: re.Match) -> str:
    """A long character reference without leading zeros; one beyond all characters is the replacement character."""
    base, digits = (16, m[2]) if m[1] else (10, m[3])
    digits = digits.lstrip("0") or "0"
    known = len(digits) < 8 and int(digits, base) < 0x110000
    return f"&#{m[1] or ''}{digits};" if known else "\ufffd"


_LONG_REFERENCE = re.compile(r"&#(?:([xX])([0-9a-fA-F]{7,}+)|([0-9]{8,}+));?")


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page that have text."""
    page, out = page or "", []
    inside, opened = ROOT, Counter()
    parts: list[str] = []
    state = {"links": 0, "linked": 0}

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", entities.unescape(_LONG_REFERENCE.sub(_number, "".join(parts)))).strip()
            if text:
                out.append(Block(inside, text, state["linked"]))
            parts.clear()
        state["linked"] = 0

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[4] or m[5]:
            parts.append(m[4] or m[5])
            if state["links"]:
                state["linked"] += len(m[0])
            continue
        if not m[2]:
            continue
        tag, end = m[2].lower(), bool(m[1])
        if tag == "a":
            state["links"] = 0 if end else 1
            continue
        if end:
            if opened[tag]:
                flush()
                while True:
                    opened[inside.tag] -= 1
                    last, inside = inside.tag, inside.parent
                    if last == tag:
                        break
            elif tag == "p":
                flush()
            continue
        if tag in NESTED:
            if not (tag in FOREIGN and m[3].endswith("/")):
                at = _after_nested(page, tag, at)
            continue
        if tag in RAW:
            at = _after_raw(page, tag, at)
            continue
        if tag == "br" or tag == "hr" or tag == "wbr":
            parts.append(" " if tag != "wbr" else "")
            if tag == "hr":
                flush()
            continue
        if tag in BLOCKS and tag not in VOID:
            flush()
            closes = IMPLIED.get(tag, frozenset()) | ({"p"} if tag in CLOSES_P else frozenset())
            while inside.tag in closes:
                opened[inside.tag] -= 1
                inside = inside.parent
            if not m[3].endswith("/") or tag not in ("p",):
                opened[tag] += 1
                inside = inside.child(tag, _hints(m[3]))
    flush()
    return out


def features(found: list[Block]) -> list[list[str]]:
    """The names of each block's features."""
    n, out = len(found), []
    for i, b in enumerate(found):
        own, here = {"bias"}, b.inside
        own |= {f"in:{t}" for t in here.tags}
        own.add(f"at:{here.tag if here.tag in ANCESTORS else 'other'}")
        near = here.hints | here.parent.hints if here.parent else here.hints
        own |= {f"hint:{h}" for h in here.all_hints} | {f"near:{h}" for h in near}
        words, size = b.text.count(" ") + 1, len(b.text)
        own.add(f"words:{min(words.bit_length(), 7)}")
        own.add(f"linked:{min(4, 4 * b.linked // size)}")
        own.add("stop" if b.text[-1] in ".!?…:\"'”»" else "nostop")
        if _NOTICE.search(b.text):
            own.add("copyright" if words < NOTICE_WORDS else "mentions copyright")
        own.add("first" if i == 0 else "last" if i == n - 1 else f"place:{4 * i // n}")
        if here.tag in ("h1", "h2", "h3", "h4") and not here.tags & {"nav", "aside", "footer", "form"}:
            own.add("heading")
        if not here.all_hints:
            own.add("nohint")
        out.append(sorted(own))
    return out


@dataclass
class Field:
    """Weights: of feature and label (n x 2), of label and next label, of the first label."""

    index: dict[str, int]
    w: np.ndarray
    step: np.ndarray
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def scores(self, names: list[list[str]]) -> np.ndarray:
        return np.array([self.w[[self.index[x] for x in own if x in self.index]].sum(axis=0) for own in names])

    def decode(self, names: list[list[str]]) -> list[int]:
        """The best labels, by Viterbi."""
        if not names:
            return []
        e = self.scores(names).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = self.start[0] + e[0][0], self.start[1] + e[0][1]
        back = []
        for x, y in e[1:]:
            from0, from1 = int(b + s10 > a + s00), int(b + s11 > a + s01)
            back.append((from0, from1))
            a, b = max(a + s00, b + s10) + x, max(a + s01, b + s11) + y
        label = int(b > a)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def train(pages: list[list[Block]], steps: int = TRAINING_STEPS, l2: float = 0.02, rate: float = 0.15) -> Field:
    """Gradient ascent (Adam) on the mean log-likelihood of labelled pages, less l2 times the squared weights."""
    names = [features(p) for p in pages]
    index = {x: i for i, x in enumerate(sorted({x for page in names for own in page for x in own}))}
    n, t = len(pages), max(map(len, pages))
    x, y, mask = np.zeros((n, t, len(index))), np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (page, own) in enumerate(zip(pages, names)):
        for j, (b, fs) in enumerate(zip(page, own)):
            x[i, j, [index[f] for f in fs]] = 1
            y[i, j], mask[i, j] = b.label, True
    hot = np.eye(2)[y] * mask[..., None]
    steps_seen = np.einsum("ija,ijb->ab", hot[:, :-1], hot[:, 1:])
    theta = [np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros(2)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in theta]
    lse = lambda a, axis: np.logaddexp.reduce(a, axis=axis)
    for k in range(1, steps + 1):
        w, step, start = theta
        e = x @ w
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = start + e[:, 0]
        for j in range(1, t):
            nxt = lse(alpha[:, j - 1, :, None] + step[None], 1) + e[:, j]
            alpha[:, j] = np.where(mask[:, j, None], nxt, alpha[:, j - 1])
        for j in range(t - 2, -1, -1):
            nxt = lse(step[None] + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
            beta[:, j] = np.where(mask[:, j + 1, None], nxt, 0)
        z = lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        both = np.exp(alpha[:, :-1, :, None] + step + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        grads = [np.einsum("ijf,ija->fa", x, hot - p) / n - l2 * w, (steps_seen - both.sum(axis=(0, 1))) / n - l2 * step, (hot[:, 0] - p[:, 0]).sum(axis=0) / n - l2 * start]
        for i, g in enumerate(grads):
            m, v = moments[i]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            moments[i] = m, v
            theta[i] = theta[i] + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Field(index, *theta)


def labelled_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> list[tuple[str, list[str]]]:
    """n pages made by rule, each with the blocks of its main text; templates with and without semantic elements and telling classes."""
    r = random.Random(seed)
    syllables = [a + b for a in "b d f g h l m n p r s t v st tr".split() for b in "a e i o u an er in on ou".split()]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a=3, b=25: words(a, b).capitalize() + "."
    prose = lambda: " ".join(sentence() for _ in range(r.choice((1, 1, 2, 3, 5))))
    short = lambda: sentence(1, 4) if r.random() < 0.3 else prose()
    pick = lambda *xs: r.choice(xs)
    named = lambda kind, likely=0.8: f' {pick("class", "id")}="{pick(*HINTS[kind].split())}"' if r.random() < likely else ""
    links = lambda: "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(r.randint(2, 8)))

    def boiler(kind: str) -> str:
        if kind == "menu":
            return pick(f"<nav{named('menu', 0.4)}><ul>{links()}</ul></nav>", f"<div{named('menu', 1)}><ul>{links()}</ul></div>", f"<div><ul>{links()}</ul></div>", "<div>" + " ".join(f"<a href=/{word()}>{words(1, 2)}</a>" for _ in range(r.randint(2, 8))) + "</div>")
        if kind == "head":
            return f"<header{named('head', 0.5)}>{pick('<h1>', '<p>', '<div>')}{words(1, 4)}{pick('', f'<p>{sentence()}</p>')}</header>"
        if kind == "foot":
            return pick(f"<footer>&copy; {word()}.example &middot; {prose()}</footer>", f"<footer{named('foot')}><p>{prose()}</p><ul>{links()}</ul></footer>", f"<div{named('foot', 1)}><p>Copyright {words(1, 3)}</p></div>", f"<div>&copy; {word()} {pick('', prose())}</div>")
        if kind == "side":
            return pick(f"<aside{named('side', 0.6)}><h3>{words(1, 3)}</h3><p>{prose()}</p></aside>", f"<div{named('side', 1)}><h3>{words(1, 3)}</h3><ul>{links()}</ul><p>{prose()}</p></div>", f"<aside>{prose()}</aside>")
        if kind == "form":
            return f"<form{named('form', 0.5)}><label>{words(1, 3)}</label><input name=q><p>{sentence()}</p><button>{word()}</button></form>"
        if kind == "comment":
            inner = "".join(pick(f"<li><p>{short()}</p></li>", f"<div class=comment><p>{short()}</p></div>") for _ in range(r.randint(1, 5)))
            return f"<{(t := pick('section', 'div'))}{named('comment', 1)}><h2>{words(1, 2)}</h2>{inner}</{t}>"
        return f"<div{named(kind, 1)}>{pick('<p>', '')}{prose()}</div>"

    out = []
    for _ in range(n):
        truth: list[str] = []

        def keep(text: str) -> str:
            truth.append(text)
            return text

        body = []
        if r.random() < 0.85:
            body.append(f"<{(h := pick('h1', 'h1', 'h2'))}>{keep(words(2, 9))}</{h}>")
        for i in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.7:
                body.append(f"<p>{keep(short())}{pick('</p>', '</p>', '')}")
            elif kind < 0.76:
                body.append(f"<p><b>{keep(short())}<br>")
            elif kind < 0.82:
                body.append(f"<h2>{keep(words(1, 6))}</h2>")
            elif kind < 0.87:
                body.append("<ul>" + "".join(f"<li>{keep(sentence(2, 9))}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif kind < 0.9:
                body.append(f"<blockquote><p>{keep(prose())}</p></blockquote>")
            elif kind < 0.93:
                body.append(f"<table><tr><td>{keep(words(1, 3))}</td><td>{keep(words(1, 3))}</td></tr></table>")
            else:
                body.append(boiler(pick("advert", "share", "side", "notice", "form")))
        if r.random() < 0.15:
            body.append(boiler("comment"))
        inside = "".join(body)
        plain = r.random() < 0.2
        inside = pick(f"<div>{inside}</div>", f"<div><div>{inside}</div></div>", inside) if plain else pick(f"<article{named('text', 0.2)}>{inside}</article>", f"<article>{inside}</article>", f"<main>{inside}</main>", f"<div{named('text', 1)}>{inside}</div>", f"<main><article>{inside}</article></main>")
        before = [boiler(k) for k in ("head", "menu", "advert", "notice", "form", "side") if r.random() < 0.45]
        after = [boiler(k) for k in ("comment", "side", "share", "advert", "notice", "form", "menu", "foot") if r.random() < 0.45]
        r.shuffle(before)
        page = f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title><style>p{{margin:0}}</style></head><body>{''.join(before)}{inside}{''.join(after)}"
        out.append((page + pick("</body></html>", ""), truth))
    return out


def labelled_blocks(page: str, truth: list[str]) -> list[Block]:
    """The page's blocks with labels: those of the truth, in order, are labelled 1."""
    found, at = blocks(page), 0
    for b in found:
        b.label = int(at < len(truth) and b.text == truth[at])
        at += b.label
    if at < len(truth):
        raise ValueError("blocks and truth don't agree")
    return found


@functools.cache
def default_field() -> Field:
    return train([found for page, truth in labelled_pages() if (found := labelled_blocks(page, truth))])


def extract(page: str | None, model: Field) -> str:
    """The main text."""
    found = blocks(page)
    return " ".join(b.text for b, label in zip(found, model.decode(features(found))) if label)


def main_text(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """A row for each page: page_id, url, text, n_chars."""
    model = model or default_field()

    def row(page_id: int, url: str | None, page: str | None) -> list[tuple]:
        text = extract(page, model)
        return [(page_id, url, text, len(text))]

    return arrow_rows(as_documents(pages, ["page_id", "url", "html"]), "page_id long, url string, text string, n_chars long", row, 500)

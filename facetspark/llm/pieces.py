"""SentencePiece encoding and decoding for merge-type (BPE) models, by a prefix table.

For every prefix of a run of characters, the encoding's last piece is unique: it is the one piece that ends there
(an automaton lists these, longest first) and is compatible with the last piece of the prefix before it, two pieces
being compatible if the merge procedure leaves their joint text as just these two: if no merge over their border would
have come before one of the merges along the first piece's right spine or the second one's left spine. The table of
last pieces is filled from left to right and the ids are recovered backwards, in linear time and without replaying
merges over the text.

No piece continues over a white space, nor from a letter to a sign, as the model's own pieces tell; so a text is cut
there, and what stands between the cuts is encoded one by one and kept, with the decimal form of its ids and the text
decoded from these, in a bounded cache of two generations; pieces of white space alone rank below all others and are merged by the procedure itself, run by run. Characters that no piece has
become bytes.

Each document is one row's work, nothing is shuffled. Defined results: a null or empty text has no ids and decodes
to an empty text; texts of any length are encoded whole; equal rows stay separate rows; an empty table gives an empty
table; only doc_id and text are read. The vocabulary is read from the model file on the executors (`model` is a path
there); the library is used for reading it only.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from facetspark.llm.common import arrow_rows, as_documents, parts, releasing

SPACE = "▁"
#: Words, or pairs of pieces, in a generation of a worker's cache.
CACHE = 150_000
LONGEST_KEPT = 64


class Kept(dict):
    """Values made on demand. When a generation is full it becomes the old one, from which what is asked for again moves
    to the new one; the one before is forgotten."""

    def __init__(self, make: Callable, times: int = 1):
        super().__init__()
        self.make, self.old, self.times = make, {}, times

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.times * CACHE:
            self.old = dict(self)
            self.clear()
        if not isinstance(key, str) or len(key) <= LONGEST_KEPT:
            self[key] = value
        return value


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    def __init__(self, model: str):
        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        every = range(lib.get_piece_size())
        self.piece = [lib.id_to_piece(i) for i in every]
        self.bytes = {int(self.piece[i][3:5], 16): i for i in every if lib.is_byte(i)}
        plain = [i for i in every if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.score = {self.piece[i]: lib.get_score(i) for i in plain}
        self.id = {self.piece[i]: i for i in plain}
        if any(SPACE in p[1:] and p.strip(SPACE) for p in self.id) or max(map(len, self.id)) > LONGEST_KEPT:
            raise ValueError("pieces over white space aren't supported")
        own = [s for p, s in self.score.items() if p.strip(SPACE)]
        if len(set(own)) < len(own) or any(s >= min(own) for p, s in self.score.items() if not p.strip(SPACE) and p != SPACE):
            raise ValueError("the model's scores leave merges undecided")
        self.chars = frozenset(p for p in self.id if len(p) == 1)
        self.ends = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.ends.add_word(p, (i, len(p)))
        self.ends.make_automaton()
        of_byte = {i: b for b, i in self.bytes.items()}
        self.byte_of = [of_byte.get(i, -1) for i in every]
        self.shown = [" ⁇ " if lib.is_unknown(i) else "" if lib.is_control(i) else "" if self.byte_of[i] >= 0 else p.replace(SPACE, " ") for i, p in enumerate(self.piece)]
        self.decimal = [str(i) for i in every]
        self.controls = frozenset(i for i in every if lib.is_control(i))
        self.byte_ids = frozenset(self.bytes.values())
        ranked = sorted((p for p in self.id if p.strip(SPACE) and len(p) > 1), key=lambda p: -self.score[p])
        self.rank = {p: n for n, p in enumerate(ranked)}
        self.spines: dict[int, tuple[int, int] | None] = {}
        self.fits = Kept(lambda pair: self.compatible(*pair))
        self.packed = Kept(lambda w: array("i", self.word(w)).tobytes())
        self.told = Kept(self.tell, 2)
        own = "".join(map(re.escape, sorted(self.joined("e"))))
        self.atoms = re.compile(f"{SPACE}?(?:[{own}]+|[^{own}{SPACE}]+)")
        self.gaps = re.compile(f"{SPACE}{{2,}}|{SPACE}\\Z")

    def joined(self, start: str) -> set[str]:
        """start and all characters that stand beside it in a piece, or beside one of these, and so on."""
        beside: dict[str, set[str]] = {}
        for p in self.id:
            for a, b in zip(p, p[1:]):
                if SPACE not in (a, b):
                    beside.setdefault(a, set()).add(b)
                    beside.setdefault(b, set()).add(a)
        found, new = {start}, [start]
        while new:
            new = [b for a in new for b in beside.get(a, ()) if b not in found and not found.add(b)]
        return found

    def merged(self, text: str, last: list | None = None) -> list[str]:
        """The merge procedure: of all neighbours that join to a piece, the best score goes first, then the leftmost.

        last is given the two parts of the last merge.
        """
        part, after, before = list(text), [*range(1, len(text)), -1], [-1, *range(len(text) - 1)]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) >= 0 and (s := self.score.get(both := part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, j, both))

        for i in range(len(text)):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if after[i] == j and part[i] and part[j] and part[i] + part[j] == both:
                if last is not None:
                    last[:] = part[i], part[j]
                part[i], part[j], after[i] = both, "", after[j]
                if after[i] >= 0:
                    before[after[i]] = i
                offer(before[i])
                offer(i)
        return [p for p in part if p]

    def halves(self, i: int) -> tuple[int, int] | None:
        """The pieces that the procedure joins last to make piece i; (i, i) for a character, None if it doesn't make i."""
        if i not in self.spines:
            text, last = self.piece[i], []
            if len(text) == 1:
                self.spines[i] = i, i
            else:
                self.spines[i] = (self.id[last[0]], self.id[last[1]]) if self.merged(text, last) == [text] else None
        return self.spines[i]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the procedure leaves piece a (-1: the start), then piece b, as they are.

        Going back in time, the later made of the two pieces at the border is replaced by its half there. While they
        stand, a merge of both would come first if its rank is less than that of the merge undone before; if the ranks
        are equal, the one further left comes first.
        """
        if self.halves(b) is None:
            return False
        if a < 0:
            return True
        rank, piece, until = self.rank, self.piece, 2 * len(self.rank)
        while True:
            if 2 * rank.get(piece[a] + piece[b], until) < until:
                return False
            made_a, made_b = rank.get(piece[a], -1), rank.get(piece[b], -1)
            if made_a == made_b == -1:
                return True
            if made_a > made_b:
                until, half = 2 * made_a, self.halves(a)[1]
                if rank.get(piece[half], -1) > made_a:
                    return self.replayed(a, b)
                a = half
            else:
                until, half = 2 * made_b + 1, self.halves(b)[0]
                if rank.get(piece[half], -1) > made_b:
                    return self.replayed(a, b)
                b = half

    def replayed(self, a: int, b: int) -> bool:
        """compatible() where a half ranks after its whole, so that ranks don't tell the times."""
        both = [self.piece[a], self.piece[b]]
        return self.merged("".join(both)) == both

    def run(self, text: str) -> list[int]:
        """The ids of characters that all are pieces."""
        last, size, fits = [-1] * (len(text) + 1), [0] * (len(text) + 1), self.fits
        for end, (i, n) in self.ends.iter(text):
            end += 1
            if not size[end] and (n == end or size[end - n]) and fits[last[end - n], i]:
                last[end], size[end] = i, n
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def word(self, text: str) -> list[int]:
        """The ids of what stands between two cuts."""
        if self.chars.issuperset(text):
            return self.run(text)
        out, known = [], ""
        for c in text:
            if c in self.chars:
                known += c
            else:
                out += self.run(known) + [self.bytes[b] for b in c.encode()]
                known = ""
        return out + self.run(known)

    def spaces(self, n: int) -> list[int]:
        return [self.id[p] for p in self.merged(SPACE * n)]

    def tell(self, text: str) -> tuple[str, str]:
        """The ids of word(text) in decimal, and what they decode to."""
        ids, shown = self.shown_as(self.word(text))
        return ids, text if shown == text else shown

    def shown_as(self, ids: list[int]) -> tuple[str, str]:
        return ",".join(map(self.decimal.__getitem__, ids)), self.text_of(ids)

    def walk(self, text: str | None, known: Kept, other: Callable) -> list:
        """known[w] for each w between two cuts, but other(ids) from several white spaces to the next cut."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        out, at = [], 0
        for gap in self.gaps.finditer(text):
            if at < gap.start():
                out += [known[w] for w in self.atoms.findall(text, at, gap.start())]
            at = gap.end()
            if at == len(text):
                out.append(other(self.spaces(at - gap.start())))
            else:  # the last white space belongs to what follows if it merged with it
                first = self.atoms.match(text, at - 1)
                ids, at = self.word(first[0]), first.end()
                alone = self.piece[ids[0]] == SPACE
                out.append(other(self.spaces(gap.end() - gap.start() - (not alone)) + ids[alone:]))
        return out + [known[w] for w in (self.atoms.findall(text, at) if at else self.atoms.findall(text))]

    def pack(self, text: str | None) -> bytes:
        """The ids as 32-bit numbers."""
        return b"".join(self.walk(text, self.packed, lambda ids: array("i", ids).tobytes()))

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.pack(text)).tolist()

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """The number of ids, digests of their decimal forms and of the text that they decode to."""
        told = self.walk(text, self.told, self.shown_as)
        ids, shown = ",".join([x for x, _ in told]), "".join([x for _, x in told])
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return ids.count(",") + 1 if ids else 0, sha(ids), sha(shown[1:])  # all ids are of words and white space

    def text_of(self, ids: list[int]) -> str:
        """What the ids show, the white space before the first word too."""
        if self.byte_ids.isdisjoint(ids):
            return "".join(map(self.shown.__getitem__, ids))
        out, raw = [], bytearray()
        for i in ids:
            if self.byte_of[i] >= 0:
                raw.append(self.byte_of[i])
            else:
                if raw:
                    out.append(_utf8(bytes(raw)))
                    raw.clear()
                out.append(self.shown[i])
        return "".join(out) + _utf8(bytes(raw))

    def decode(self, ids: list[int]) -> str:
        text = self.text_of(ids)
        first = next((i for i in ids if i not in self.controls), None)  # controls show nothing
        return text[1:] if first is not None and self.piece[first].startswith(SPACE) else text


codecs.register_error("facetspark-each-byte", lambda e: ("\ufffd", e.start + 1))


def _utf8(raw: bytes) -> str:
    """A replacement character for every byte that belongs to no character."""
    return raw.decode(errors="facetspark-each-byte")


@functools.cache
def codec(model: str) -> Codec:
    """One for each Python worker."""
    return Codec(model)


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """A row for each document: doc_id, and its ids."""
    model = model or default_model()

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 100):
            packed = [codec(model).pack(t.as_py()) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, packed)]) // 4
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), ids], ["doc_id", "ids"])

    return as_documents(docs, ["doc_id", "text"]).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """A row for each row of encoded(doc_id, ids): doc_id, and the text; null ids give an empty text."""
    model = model or default_model()
    return arrow_rows(encoded.select("doc_id", "ids"), "doc_id long, text string", lambda i, ids: [(i, codec(model).decode(ids or []))], 200)


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """A row for each document: doc_id, n_tokens, and digests of the ids and of the text decoded from them."""
    model = model or default_model()

    def row(doc_id: int, text: str | None) -> Iterable[tuple]:
        return [(doc_id, *codec(model).digest(text))]

    return arrow_rows(as_documents(docs, ["doc_id", "text"]), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row)

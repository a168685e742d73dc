"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in the whole text: at-signs, plus signs, digits, "://" and identifier cues (in
letters of either case). Between a cue and its identifier may stand words that name it ("IBAN number", "password is") and
separators of any length. An account number of its country's length with a right checksum needs no cue: a country's
letters before a digit do.
A deterministic local parser expands each anchor to the span around it and validates it; every parser starts where
its last span ended, so that spans of a kind never overlap and the work stays linear.

Kinds, in order: email, ip, card and phone (the base kinds, with the meaning of a leftmost search for their patterns),
then iban, secret, ssn and url_login, which the method adds.

Each document is one row's work, nothing is shuffled. Defined results: a null or empty text has no spans; texts of
any length are scanned whole; equal rows stay separate rows; an empty table gives an empty table; only doc_id and
text are read. Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame

from facetspark.llm.common import arrow_rows, as_documents

KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn", "url_login")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
CUES = {
    "ssn": "ssn", "social security": "ssn", "social-security": "ssn",
    **dict.fromkeys(["token", "secret", "password", "passwd", "passphrase", "pwd", "credential"], "secret"),
    **{first + gap + "key": "secret" for first in ("api", "access", "auth", "private") for gap in ("", " ", "_", "-")},
}
#: Words that may stand between a cue and its identifier.
NAMING = r"(?:\s++(?:number|no\.|no|nr\.|nr|code|key|is|was)(?![A-Za-z0-9]))*+"
LOWER = {c: c + 32 for c in range(65, 91)}
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The length of account numbers by country (ISO 13616).
ACCOUNT_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
SSN = re.compile(NAMING + r"[\s:#=-]*+((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9])")
SECRET = re.compile(NAMING + r"(?:\s*+[=:]|(?<=\sis)|(?<=\swas))\s*+[\"']?([A-Za-z0-9_/+.=-]{16,}+)")
SIGN = re.compile(r"[A-Za-z0-9]")
LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+(?::[0-9]+)?")


@functools.cache
def anchors() -> ahocorasick.Automaton:
    """Value of a match: what it starts, and its length."""
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    found.add_word("://", ("url_login", 3))
    for cue, kind in CUES.items():
        found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    account = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


@functools.cache
def _account(country: str) -> re.Pattern:
    return re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{{ACCOUNT_LENGTHS[country] - 4}}}(?![A-Za-z0-9])")


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind in the order of KINDS, then by start."""
    text = text or ""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    past = dict.fromkeys(KINDS, 0)
    for last, (anchor, size) in anchors().iter(text.translate(LOWER)):
        at, after = last - size + 1, last + 1
        if anchor == "digit":
            start = at - 2
            if start >= past["iban"] and text[start:at] in ACCOUNT_LENGTHS and not (start and SIGN.match(text, start - 1)):
                if (m := _account(text[start:at]).match(text, start)) and mod97(m[0]):
                    past["iban"] = m.end()
                    found["iban"].append(m.span())
            if at >= past["card"] and (m := CARD.match(text, at)):
                past["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
            if at >= past["ip"]:
                if m := IP.match(text, at):
                    past["ip"] = m.end()
                    if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m.groups()):
                        found["ip"].append(m.span())
                else:  # nor can a match begin later in this run of digits
                    past["ip"] = DIGITS.match(text, at).end()
        elif anchor == "email":
            start = at
            while start > past["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, after)):
                past["email"] = m.end()
                found["email"].append((start, m.end()))
        elif anchor == "phone":
            if at >= past["phone"] and (m := PHONE.match(text, at)):
                past["phone"] = m.end()
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    found["phone"].append(m.span())
        elif anchor == "url_login":
            start = at
            while start > past["url_login"] and text[start - 1] in SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            if start < at and (m := LOGIN.match(text, after)):
                past["url_login"] = m.end()
                found["url_login"].append((start, m.end()))
        elif after >= past[anchor]:
            if m := {"ssn": SSN, "secret": SECRET}[anchor].match(text, after):
                value = m[1]
                if anchor == "ssn" or any(map(str.isdigit, value)) and any(map(str.isalpha, value)):
                    past[anchor] = m.end(1)
                    found[anchor].append(m.span(1))
                elif anchor == "secret":  # nor has what follows a later cue in it both letters and digits
                    past[anchor] = m.end(1)
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def redact(text: str | None) -> str:
    """text with each span, or union of overlapping spans, replaced by the kind of its first one in brackets."""
    text, out, at = text or "", [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans(text)):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, and spans as an array of (kind, start, end)."""
    return arrow_rows(as_documents(docs, ["doc_id", "text"]), "doc_id long, spans array<struct<kind: string, start: int, end: int>>", lambda i, t: [(i, [{"kind": k, "start": s, "end": e} for k, s, e in spans(t)])])


def redacted(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, and its text without personal data."""
    return arrow_rows(as_documents(docs, ["doc_id", "text"]), "doc_id long, text string", lambda i, t: [(i, redact(t))])


def digests(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, counts of the base kinds, their digest, and all spans as text."""

    def row(doc_id: int, text: str | None) -> list[tuple]:
        found = [(k, f"{k}:{s}:{e}") for k, s, e in spans(text)]
        base = ",".join(x for k, x in found if k in KINDS[:4])
        counts = [sum(k == kind for k, _ in found) for kind in KINDS[:4]]
        return [(doc_id, *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in found))]

    return arrow_rows(as_documents(docs, ["doc_id", "text"]), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", row)

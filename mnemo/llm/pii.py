"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) follow their patterns alone, cards also Luhn; they always stay.
The method adds kinds whose pattern is not enough: ``iban`` (mod-97 must hold, at the country's length), ``ssn`` and
``secret`` (hexadecimal or key-shaped strings, values given to a password). Each proposal has a score: that of its
pattern and checksum, raised when a word of its context stands within ``CONTEXT_CHARS`` before or after it; spans
under ``ACCEPT`` are dropped. A number without context passes only when its country's length is known, a key only
when it is given to a password.

Positions are code points, end exclusive. Null and empty texts have no spans. Every pattern is
anchored at the head of a run (or at ``@`` and ``+``), so a very long run of digits or letters is
read a bounded number of times. Rows are handled one by one: repeated rows give equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import lean

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret", "ssn")
CONTEXT_CHARS = 48
ACCEPT = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_ANY = re.compile(r"[0-9@]")

#: Lengths of account numbers by country, from the public registry.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29,
    ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20,
    LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25,
    QA=29, RO=24, RS=22, SA=24, SC=31, SD=18, SE=24, SI=19, SK=24, SM=27, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20)
_IBAN = re.compile(r"(?<![0-9A-Za-z])(?=([A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30}))")
_SECRET = re.compile(
    r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,128}|xox[abprs]-[A-Za-z0-9-]{10,128}"
    r"|eyJ[A-Za-z0-9_-]{8,2048}\.[A-Za-z0-9_-]{8,2048}\.[A-Za-z0-9_-]{8,2048})(?![0-9A-Za-z])")
_PASSWORD = re.compile(r"(?:password|passwd|pwd|passphrase)\"?[ \t]{0,3}[:=][ \t]{0,3}\"?(?P<value>[^\s\"]{6,128})", re.I)
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Context words by kind.
_CONTEXT = {
    "iban": re.compile(r"iban|bank|account|konto|compte|cuenta", re.I),
    "secret": re.compile(r"token|secret|key|passw|auth|bearer|credential", re.I),
    "ssn": re.compile(r"ssn|social|security", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ibans(text: str) -> Iterator[tuple[int, int, float]]:
    """Spans with a true checksum. Where the country's length is known the number ends there; else at the last group that confirms it."""
    done = 0
    for m in _IBAN.finditer(text):
        if m.start() < done:
            continue
        at = [k for k in range(*m.span(1)) if text[k] != " "]
        length = IBAN_LENGTHS.get(m[1][:2])
        tried = [length] if length else range(min(len(at), 34), 14, -1)
        for n in tried:
            end = at[n - 1] + 1 if n <= len(at) else -1
            if end > 0 and (end == len(text) or not text[end].isascii() or not text[end].isalnum()) and mod97(text[m.start() : end]):
                yield m.start(), end, 0.6 if length else 0.4
                done = end
                break


def _secrets(text: str) -> Iterator[tuple[int, int, float]]:
    end = 0
    found = [(*m.span(), 0.3) for m in _SECRET.finditer(text)] + [(*m.span("value"), 0.6) for m in _PASSWORD.finditer(text)]
    for a, b, score in sorted(found):
        shown = text[a:b]
        if a >= end and re.search("[0-9]", shown) and (re.search("[A-Za-z]", shown) or score > 0.5):
            yield a, b, score
            end = b


def _ssns(text: str) -> Iterator[tuple[int, int, float]]:
    for m in _SSN.finditer(text):
        yield *m.span(), 0.3


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
            at = text.find("@", floor)
        else:
            floor = at + 1
            at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p := q.lstrip("0")) <= 3 and int(p or "0") <= 255 for q in four):
                yield at, end
            at = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


_BASE = (("email", _emails), ("ip", _ips), ("card", _cards), ("phone", _phones))
_METHOD = (("iban", _ibans), ("secret", _secrets), ("ssn", _ssns))


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind in the order of ``KINDS``, then start."""
    if not text or not _ANY.search(text):
        return []
    out = []
    for kind, propose in _BASE:
        out += [(kind, a, b, 1.0) for a, b in propose(text)]
    for kind, propose in _METHOD:
        for a, b, score in propose(text):
            near = _CONTEXT[kind]
            if near.search(text, max(0, a - CONTEXT_CHARS), a) or near.search(text, b, b + CONTEXT_CHARS):
                score += 0.4
            if score >= ACCEPT:
                out.append((kind, a, b, score))
    return out


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def spans(text: Column | str) -> Column:
    """The spans of a text column as an array of (kind, start, end, score)."""

    @F.pandas_udf(SPANS)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_spans(t)] for t in batch], dtype=object)

    return run(text)


def with_spans(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    lean(docs.sparkSession)
    return docs.withColumn(into, spans(F.col(text)))


def mask(text: str | None) -> str | None:
    """The text with every span replaced by its kind in capitals, as ``[EMAIL]``; overlaps become one."""
    found = sorted((a, b, k) for k, a, b, _ in find_spans(text))
    if not found:
        return text
    out, at = [], 0
    for a, b, kind in found:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with the personal data of ``text`` masked (null stays null)."""
    lean(docs.sparkSession)

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([mask(t) for t in batch], dtype=object)

    return docs.withColumn(text, run(F.col(text)))

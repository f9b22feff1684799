"""Personal data behind disguises: transducers normalise the text and keep the way back to the source."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import merged, slices, table, tidy
from .folding import codes, homoglyphs, string

SCHEMA = "doc_id bigint, kind string, start bigint, end bigint, value string, source string"

_DIGITS = {w: str(d) for d, ws in enumerate(("zero oh null cero", "one uno eins", "two deux dos zwei", "three trois tres drei", "four quatre cuatro vier", "five cinq cinco fünf", "six seis sechs", "seven sept siete sieben", "eight huit ocho acht", "nine neuf nueve neun")) for w in ws.split()}
_WORD = "(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + ")"
_TLD = r"(?:com|org|net|edu|gov|mil|int|info|biz|io|ai|co|uk|us|de|fr|es|it|nl|eu|ch|at|be|ca|au|in|jp|ru|br|mx|dev|app|me|test|example|invalid)"
#: White space is entered at its beginning only, so that long runs are read once.
_GAP = r"(?:(?<!\s)\s+)?"
_DOTS = rf"(?:(?<!\s)\s+(?:dot|punkt|punto|point)\s+|{_GAP}[\[({{<]\s*(?:dot|punkt|punto|point|\.)\s*[\])}}>]\s*|\.)"
#: Characters that are not seen.
_NONE = "[̀-ͯ­​-‏⁠﻿]"
#: What a transducer rewrites; in one pass, so that each has its place in the source.
_DISGUISE = re.compile(
    rf"(?P<at>{_GAP}[\[({{<]\s*(?:at|ät|arroba|arobase|@)\s*[\])}}>]\s*|(?<!\s)\s+(?:at|arroba|arobase)\s+(?=[a-z0-9-]+(?:{_DOTS}[a-z0-9-]+)*?{_DOTS}{_TLD}\b))"
    rf"|(?P<dot>{_GAP}[\[({{<]\s*(?:dot|punkt|punto|point|\.)\s*[\])}}>]\s*|(?<=[a-z0-9])\s+dot\s+(?=[a-z0-9]))"
    rf"|(?P<digits>\b{_WORD}(?:[\s().,\-]{{1,3}}(?:{_WORD}\b|\d+))+|(?<=\d)[\s\-]{_WORD}(?:[\s().,\-]{{1,3}}(?:{_WORD}\b|\d+))*\b)"
    rf"|(?P<none>{_NONE}+)"
)
#: Where alone it may begin: by a bracket or what is not seen, by white space before a word, by a spelled digit.
_MARK = re.compile(rf"[\[({{<{_NONE[1:]}")
_SAID = re.compile(r"\s(?=(?:at|arroba|arobase|dot)\s)")
_COUNTED = re.compile(rf"\W(?={_WORD}\b)")
_SPELLED = re.compile(rf"{_WORD}\b")
_BETWEEN = re.compile(r"[\s,\-]+\Z")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"(?:[a-z0-9]++(?:-++[a-z0-9]++)*+\.)+[a-z]{2,24}")
#: Behind a disguised @, dots may have spaces around.
_SPACED = re.compile(rf"(?:[a-z0-9]++(?:-++[a-z0-9]++)*+ ?\. ?)+{_TLD}\b")
_BEFORE = re.compile(r" ?\. ?\Z")
_NUMBER = re.compile(r"(?:\+|\(\+?)?\d(?:[ .()/\-]{0,3}\d){6,}")
#: Identifiers inside a longer run of digits, at the borders of its groups.
_INSIDE = re.compile(
    r"(?<!\d)(?:(?:4\d{3}|5[1-5]\d{2}|2[2-7]\d{2}|6(?:011|5\d{2}))([ \-]?)\d{4}\1\d{4}\1\d{4}|3[47]\d{2}([ \-]?)\d{6}\2\d{5}"
    r"|(?!000|666|9)\d{3}([ \-])(?!00)\d{2}\3(?!0000)\d{4}"
    r"|(?:\+?\d{1,3}[ .\-])?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4})(?!\d)"
)
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")
_IBAN = re.compile(r"(?<![a-z0-9])[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,4})?(?![a-z0-9])")
_CARD = re.compile(r"(?:4\d{3}|5[1-5]\d{2}|2[2-7]\d{2}|6(?:011|5\d{2}))([ \-]?)\d{4}\1\d{4}\1\d{4}\Z|3[47]\d{2}([ \-]?)\d{6}\2\d{5}\Z")
_SSN = re.compile(r"(?!000|666|9)\d{3}([ \-])(?!00)\d{2}\1(?!0000)\d{4}\Z")
_PHONE = re.compile(r"(?:\+\d{1,3}[ .\-]?)?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-/]?\d{2,4}){1,4}\Z")


@cache
def _fold() -> np.ndarray:
    """Homoglyphs and lower case, one code point for one."""
    t = homoglyphs().copy()
    for c in range(0x3000):
        low = chr(int(t[c])).lower()
        if len(low) == 1:
            t[c] = ord(low)
    return t


def disguises(flat: str) -> Iterator[re.Match]:
    """The matches of _DISGUISE, which is tried only where one may begin: the same as those of finditer."""
    starts = {0}
    for pattern in (_MARK, _SAID):
        for m in pattern.finditer(flat):
            k = m.start()
            starts.add(k)
            while k and flat[k - 1].isspace():  # white space before belongs to it
                k -= 1
            starts.add(k)
    for m in _COUNTED.finditer(flat):
        starts.update(m.span())
    at = 0
    for k in sorted(starts):
        if k >= at and (m := _DISGUISE.match(flat, k)):
            yield m
            at = m.end()


class Normalised:
    """A normalised text and, for each of its pieces, where it begins there and in the source."""

    def __init__(self, text: str):
        flat = string(_fold()[codes(text)])
        out: list[str] = []
        self.here: list[int] = [0]
        self.there: list[tuple[int, int, bool]] = []  # source start, source end, whether as it was
        n = at = 0

        def put(piece: str, a: int, b: int, same: bool) -> None:
            nonlocal n
            if piece:
                out.append(piece)
                self.there.append((a, b, same))
                n += len(piece)
                self.here.append(n)

        for m in disguises(flat):
            a, b = m.span()
            if m.lastgroup == "digits":
                first = True
                for w in _SPELLED.finditer(flat, a, b):
                    if first or not _BETWEEN.match(flat[at : w.start()]):  # what is between two spelled digits goes
                        put(flat[at : w.start()], at, w.start(), True)
                    first = False
                    put(_DIGITS[w.group()], w.start(), w.end(), False)
                    at = w.end()
                continue
            put(flat[at:a], at, a, True)
            put({"at": "@", "dot": ".", "none": ""}[m.lastgroup], a, b, False)
            at = b
        put(flat[at:], at, len(flat), True)
        self.text = "".join(out)

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a span of the normalised text."""
        i, j = bisect_right(self.here, start) - 1, bisect_right(self.here, end - 1) - 1
        a, _, same = self.there[i]
        lo = a + (start - self.here[i]) if same else a
        c, d, same = self.there[j]
        return lo, c + (end - self.here[j]) if same else d

    def rewritten(self, start: int, end: int) -> bool:
        """Whether some of the span isn't in the source as it is here."""
        i, j = bisect_right(self.here, start) - 1, bisect_right(self.here, end - 1) - 1
        return not all(same for _, _, same in self.there[i : j + 1])


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def iban(value: str) -> bool:
    s = value.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def detect(n: Normalised) -> list[tuple[str, int, int]]:
    """Kind, start and end of each identifier in a normalised text, in order; none overlap."""
    text = n.text
    found: list[tuple[int, int, str]] = []
    at = text.find("@")
    while at >= 0:
        hidden = n.rewritten(at, at + 1)
        domain = _DOMAIN.match(text, at + 1) or (hidden and _SPACED.match(text, at + 1))
        lo = at
        while domain:  # to the left as far as the characters of a name go
            while lo and text[lo - 1] in _LOCAL:
                lo -= 1
            gap = _BEFORE.search(text, max(0, lo - 3), lo) if hidden and lo < at else None
            if not gap or not gap.start() or text[gap.start() - 1] not in _LOCAL:
                break
            lo = gap.start()
        while lo < at and text[lo] in "._%+-":
            lo += 1
        if lo < at and text[at - 1] != ".":
            found.append((lo, domain.end(), "email"))
        at = text.find("@", at + 1)
    found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text)]
    found += [(m.start(), m.end(), "iban") for m in _IBAN.finditer(text) if iban(m.group())]
    taken = merged([x[:2] for x in found])
    taken_from = [x[0] for x in taken]
    for m in _NUMBER.finditer(text):
        a, b = m.span()
        if (a and (text[a - 1].isalnum() or text[a - 1] in "_.")) or (b < len(text) and (text[b].isalnum() or text[b] == "_")):
            continue
        k = bisect_left(taken_from, b) - 1
        if k >= 0 and taken[k][1] > a:
            continue
        parts = [(a, b)]
        if not _kind(text[a:b], n.rewritten(a, b)):  # several in a row: each by itself
            parts, at = [], a
            for w in [*_INSIDE.finditer(text, a, b), None]:
                parts += [(at + p.start(), at + p.end()) for p in re.finditer(r"[^ /]+", text[at : w.start() if w else b])]
                if w:
                    parts.append(w.span())
                    at = w.end()
        for x, y in parts:
            if kind := _kind(text[x:y], n.rewritten(x, y)):
                found.append((x, y, kind))
    found.sort()
    out: list[tuple[str, int, int]] = []
    for a, b, kind in found:
        if not out or a >= out[-1][2]:
            out.append((kind, a, b))
    return out


def _kind(value: str, spelled: bool) -> str | None:
    digits = re.sub(r"\D", "", value)
    bare = value.replace(" ", "")
    single = re.sub(r"(?<=\d)[ \-.,](?=\d)", "", value) if re.fullmatch(r"\d(?:[ \-.,]\d)+", value) else value  # spelled digit by digit
    if _CARD.match(value) or (_CARD.match(single) or 13 <= len(digits) <= 19 and bare.replace("-", "").isdigit()) and luhn(digits):
        return "card"
    if _SSN.match(value):
        return "ssn"
    if 9 <= len(digits) <= 15 and (single != value or spelled or _PHONE.match(value) and (value[0] in "+(" or len(digits) >= 10 and not value.isdigit())):
        return "phone"
    if len(digits) == 7 and re.fullmatch(r"\d{3}-\d{4}", value):
        return "phone"
    return None


def find(text: str) -> list[tuple[str, int, int, str]]:
    """Kind, source start and end, normalised value of each identifier of a text."""
    n = Normalised(text)
    return [(kind, *n.source(a, b), n.text[a:b]) for kind, a, b in detect(n)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("source", pa.string())])
    for batch in slices(batches):
        rows: list[tuple] = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text"), "").to_pylist()):
            if text:
                rows += [(doc, kind, a, b, value, text[a:b]) for kind, a, b, value in find(text)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), kinds)], schema=kinds)
    tidy()


def personal_data(docs: DataFrame) -> DataFrame:
    """One row for each e-mail and IP address, phone, card, social security and bank account number: doc_id, kind, start and end in characters of the source, the normalised value, the source's own string.

    Before detection homoglyphs are folded, invisible characters left out, and spelled digits and disguises of @ and . rewritten; spans
    go back to the source. Card numbers of a known grouping count without a right check digit too. Null and empty texts have none; a
    null doc_id is carried through; repeated rows give repeated results; other columns are not read. Texts of any length are
    normalised whole.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))

"""PII: offset-preserving deobfuscation.

Base detectors run on the text as it is. Two rewriting transducers then normalise disguises
(look-alike characters first; then spelled digits, separators and at/dot words) while an
alignment keeps, for every normalised character, the source characters it came from. The same
detectors run on the normalised text and their spans are mapped back.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_arrow

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

# --- base detectors -------------------------------------------------------------------------

# A match of these starts at the first character of a run, so looking behind changes no result
# and spares a restart at each character of a long run.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterable[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part is the whole run before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def detect(text: str) -> list[Span]:
    """Spans of all kinds, by start and then kind as listed."""
    found: list[Span] = [(a, b, "email") for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((*m.span(), "card"))
    for m in PHONE.finditer(text):
        if 10 <= len(digits_of(m[0])) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# --- alignment ------------------------------------------------------------------------------


class Aligned:
    """A text with, for its characters, the source spans they came from.

    Kept as edits: (start in this text, end in this text, source start, source end), in order;
    between edits characters map one to one.
    """

    def __init__(self, text: str, edits: list[tuple[int, int, int, int]] | None = None) -> None:
        self.text, self.edits = text, edits or []
        self.starts = [e[0] for e in self.edits]

    def source(self, start: int, end: int) -> tuple[int, int]:
        """Source span of the characters start to end, end exclusive."""
        return self._at(start)[0], self._at(end - 1)[1]

    def _at(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.starts, i) - 1
        while k >= 0 and self.edits[k][0] == self.edits[k][1]:  # an edit that left nothing holds no character
            if self.edits[k][0] < i or k == 0 or self.edits[k - 1][1] <= i:
                break
            k -= 1
        if k < 0:
            return i, i + 1
        a, b, s, e = self.edits[k]
        if a <= i < b:
            return s, e
        return e + i - b, e + i - b + 1

    def touched(self, start: int, end: int) -> bool:
        """Does an edit lie in or at this span?"""
        k = bisect_right(self.starts, end - 1) - 1
        return k >= 0 and self.edits[k][1] >= start and (self.edits[k][1] > start or self.edits[k][0] >= start)

    def rewrite(self, changes: list[tuple[int, int, str]]) -> Aligned:
        """Replace spans of this text (in order, apart from each other); edits stay aligned to the source."""
        parts, edits, at, grown, k = [], [], 0, 0, 0

        def keep(until: int) -> None:  # earlier edits outside the changes only move
            nonlocal k
            while k < len(self.edits) and self.edits[k][1] <= until and self.edits[k][0] < max(until, 1):
                a, b, s, e = self.edits[k]
                if a >= at:
                    edits.append((a + grown, b + grown, s, e))
                k += 1

        for start, end, new in changes:
            keep(start)
            parts += [self.text[at:start], new]
            source = self.source(start, end)
            edits.append((start + grown, start + grown + len(new), *source))
            at, grown = end, grown + len(new) - (end - start)
            while k < len(self.edits) and self.edits[k][0] < end:
                k += 1
        keep(len(self.text) + 1)
        parts.append(self.text[at:])
        return Aligned("".join(parts), edits)


# --- transducers ----------------------------------------------------------------------------

#: Characters of other scripts that look like a Latin letter or digit.
CONFUSABLES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "п": "n", "г": "r",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "τ": "t", "ε": "e", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l", "ⅰ": "i", "ո": "n", "օ": "o", "ս": "u", "։": ":", "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@", "＠": "@",
}
#: Characters without width that split an identifier.
INVISIBLE = "­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
#: Blocks whose compatibility form (NFKC) is a plain character: superscripts, enclosed, full-width, mathematical and segmented forms.
COMPATIBLE = " ²³¹ -  ⁰-ₜ①-⓿！-～\U0001d400-\U0001d7ff\U0001fbf0-\U0001fbf9"
#: Digits of other scripts, by the code point of each script's zero.
ZEROS = (0x660, 0x6F0, 0x7C0, 0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66, 0xE50, 0xED0, 0xF20, 0x1040, 0x17E0)
ODD = re.compile("[" + "".join(CONFUSABLES) + INVISIBLE + COMPATIBLE + "".join(f"{chr(z)}-{chr(z + 9)}" for z in ZEROS) + "]")


def plain(c: str) -> str:
    if c in CONFUSABLES:
        return CONFUSABLES[c]
    if c in INVISIBLE:
        return ""
    if (d := unicodedata.digit(c, -1)) >= 0:
        return str(d)
    return unicodedata.normalize("NFKC", c)


#: Spelled digits and multipliers.
DIGITS = {"zero": "0", "oh": "0", "nought": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"}
TIMES = {"double": 2, "triple": 3, "treble": 3}
NUMBER = f"(?:(?:{'|'.join(TIMES)})[ -]+)?(?:{'|'.join(sorted(DIGITS, key=len, reverse=True))}|[0-9]+)"
DOT_WORD, AT_WORD, JOIN = r"(?:dot|point|punkt|punto)", r"(?:at|arroba)", r"(?:dash|hyphen|minus)"
#: A run of spelled digits, with digits, dots, dashes and a plus among them.
SPELLED = re.compile(rf"(?<!\w)(?:plus[ ,-]*)?{NUMBER}(?:[ ,.-]{{1,3}}(?:{DOT_WORD}[ ]+|{JOIN}[ ]+)?{NUMBER})*(?!\w)", re.I)
SPELLED_TOKEN = re.compile(rf"(?P<plus>plus)|(?P<dot>{DOT_WORD})|(?P<join>{JOIN})|(?:(?P<times>{'|'.join(TIMES)})[ -]+)?(?P<digit>{'|'.join(sorted(DIGITS, key=len, reverse=True))})|(?P<number>[0-9]+)|(?P<gap>[ ,.-]+)", re.I)
SEPARATORS = str.maketrans(",.-", "   ")
#: Words that stand before a noun in prose, never first in a domain.
PROSE = {"the", "a", "an", "this", "that", "his", "her", "my", "our", "your", "their", "its", "one", "each", "every", "some", "no"}
#: An at or a dot in brackets, with or without spaces around.
OPEN, CLOSE = r"[\[({<]\s{0,2}", r"\s{0,2}[\])}>]"
BRACKET_AT = re.compile(rf"\s{{0,3}}{OPEN}(?:at|arroba|@|ät){CLOSE}\s{{0,3}}", re.I)
BRACKET_DOT = re.compile(rf"\s{{0,3}}{OPEN}(?:{DOT_WORD}|\.){CLOSE}\s{{0,3}}", re.I)
#: name at host dot domain in bare words: the dot word is asked for, so that prose stays prose.
NAME = r"[A-Za-z0-9_%+-]+"
BARE = re.compile(rf"(?<![\w.%+-])({NAME}(?:(?:\.|\s{{1,2}}{DOT_WORD}\s{{1,2}}){NAME}){{0,4}})(\s{{1,2}}{AT_WORD}\s{{1,2}}|\s{{0,2}}@\s{{0,2}})([A-Za-z0-9-]+(?:(?:\.|\s{{1,2}}{DOT_WORD}\s{{1,2}})[A-Za-z0-9-]+){{1,5}})", re.I)
DOT_GAP = re.compile(rf"\s{{1,2}}{DOT_WORD}\s{{1,2}}", re.I)
#: An at sign or dot that spaces set apart inside an address, such as "a @ b . com".
WIDE_AT = re.compile(r"(?<=[A-Za-z0-9])\s{1,2}@\s{0,2}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@\s{1,2}(?=[A-Za-z0-9])")
WIDE_DOT = re.compile(r"(?<=[A-Za-z0-9]) \. (?=[A-Za-z0-9])")
AT_HINT = re.compile(rf"[\[({{<]\s*(?:at|dot|punkt|punto|arroba|@|\.|ät)\s*[\])}}>]|\s{DOT_WORD}\s|\s@|@\s", re.I)


def spelled_number(text: str) -> str | None:
    """The plain form of a run of digits of which some are spelled: three, or any where all make ten digits or four dotted parts; else null."""
    out, spelled, gap = [], 0, ""
    for m in SPELLED_TOKEN.finditer(text):
        if m["gap"]:
            gap = m["gap"]
            continue
        if m["plus"]:
            out.append("+")
        elif m["dot"]:
            out.append(".")
        elif m["join"]:
            out.append("-")
        else:
            if m["number"] and gap.strip(" ,") and out:
                out.append(gap.strip(" ,")[0])
            out.append(m["number"] or DIGITS[m["digit"].lower()] * TIMES.get((m["times"] or "").lower(), 1))
            spelled += bool(m["digit"])
        gap = ""
    plain_form = "".join(out)
    enough = spelled >= 3 or (spelled and (sum(map(str.isdigit, plain_form)) >= 10 or IP.fullmatch(plain_form)))
    return plain_form if enough else None


def normalise(text: str) -> Aligned:
    """The text after the transducers, aligned to its source."""
    out = Aligned(text)
    if not text.isascii():
        out = out.rewrite([(m.start(), m.end(), plain(m[0])) for m in ODD.finditer(text) if plain(m[0]) != m[0]])
    if not DIGITS.keys().isdisjoint(out.text.lower().translate(SEPARATORS).split()):  # of three digits the middle one stands between separators
        changes = [(m.start(), m.end(), new) for m in SPELLED.finditer(out.text) if (new := spelled_number(m[0])) is not None]
        out = out.rewrite(changes) if changes else out
    if AT_HINT.search(out.text):
        for pattern, new in ((BRACKET_AT, "@"), (BRACKET_DOT, "."), (WIDE_AT, "@")):
            if changes := [(m.start(), m.end(), new) for m in pattern.finditer(out.text)]:
                out = out.rewrite(changes)
        changes = []
        for m in BARE.finditer(out.text):
            bare_at = "@" not in m[2]
            if bare_at and (not DOT_GAP.search(m[3]) or re.split(r"\W", m[3].lower(), maxsplit=1)[0] in PROSE):
                continue
            changes += [(m.start(1) + d.start(), m.start(1) + d.end(), ".") for d in DOT_GAP.finditer(m[1])]
            changes += [(m.start(2), m.end(2), "@")] if m[2] != "@" else []
            changes += [(m.start(3) + d.start(), m.start(3) + d.end(), ".") for d in DOT_GAP.finditer(m[3])]
        out = out.rewrite(changes) if changes else out
        if changes := [(m.start(), m.end(), ".") for m in WIDE_DOT.finditer(out.text) if "@" in out.text[max(0, m.start() - 64) : m.start()].rpartition(" ")[2]]:
            out = out.rewrite(changes)
    return out


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base ones and those that only the normalised text shows.

    An added span must come from rewritten characters and overlap no base span of its kind;
    added email addresses end in a domain of letters. Spans of several kinds may overlap or be
    equal: all are kept, in the order of KINDS where they start together.
    """
    text = text or ""
    base = detect(text)
    seen = normalise(text)
    if not seen.edits:
        return base, base
    added = []
    for start, end, kind in detect(seen.text):
        a, b = seen.source(start, end)
        found = seen.text[start:end]
        if not seen.touched(start, end) or any(k == kind and a < e and s < b for s, e, k in base):
            continue
        if kind == "email" and not re.search(r"\.[A-Za-z]{2,24}\Z", found):
            continue
        added.append((a, b, kind))
    return base, sorted({*base, *added}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def render(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def mask(text: str, spans: list[Span]) -> str:
    """Each stretch of spans that overlap becomes the name of the first one's kind in brackets."""
    parts, at, start, end, name = [], 0, -1, -1, ""
    for a, b, k in [*spans, (len(text) + 1, len(text) + 1, "")]:
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            parts += [text[at:start], f"[{name.upper()}]"]
            at = end
        start, end, name = a, b, k
    return "".join([*parts, text[at:]])


# --- DataFrame operator ---------------------------------------------------------------------

SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,source:string>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Per row: id, spans (kind, start, end exclusive in code points, base, source text), masked.

    masked is the text with its spans replaced (only with_text). A null text has no spans and a
    null masked text; repeated rows give repeated rows; an empty table gives none; other columns
    are ignored. Whole texts are searched in time about linear in their length.
    """

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, masked = [], []
            for text in batch.column(1).to_pylist():
                base, spans = find(text)
                known = set(base)
                rows.append([{"kind": k, "start": a, "end": b, "base": (a, b, k) in known, "source": text[a:b] if with_text else None} for a, b, k in spans])
                masked.append(text if text is None or not with_text else mask(text, spans))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("source", pa.string())]))
            columns = [batch.column(0), pa.array(rows, kind)] + ([pa.array(masked, pa.string())] if with_text else [])
            return pa.RecordBatch.from_arrays(columns, names=["id", "spans"] + ["masked"] * with_text)

        return each

    out = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {id_type(docs, id_col)}, spans {SPANS}" + ", masked string" * with_text)
    return out.withColumnRenamed("id", id_col)


def pii_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of find_pii: counts of the base spans by kind, their digest, and all spans as text."""
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))

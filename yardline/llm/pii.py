"""Personal data with offsets, also where it is disguised.

Base identifiers are found in the text as it is. Transducers then rewrite a
text that may hold disguises: look-alike characters to ASCII, invisible ones to
nothing, spelled digits to digits, words for "at" and "dot" to signs (in four
languages; without brackets told by a machine of name, at, label, dot), blanks
between the single characters of an address to nothing. Each rewritten
character knows the source characters it stands for, so identifiers found in
the rewritten text map back to spans of the source. These are added where they
touch no base span. Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

import re
import string
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yardline.llm import textcols as tc

KINDS = ("email", "ip", "card", "phone")

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ belongs to one match at most: the run of local characters before it and the domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        local = at - free - len(text[free:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if local else None
        free = at + 1
        if domain:
            yield at - local, domain.end()
            free = domain.end()
        at = text.find("@", free)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """A chain of dotted numbers splits into fours from its left."""
    for chain in _DOTTED.finditer(text):
        start, parts = chain.start(), chain[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, end
            start = end + 1


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield m.span()


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all identifiers of a text as it is, by start and kind."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [(a, 1, b) for a, b in _addresses(text)]
        found += [(a, 2, b) for a, b in _cards(text)]
        found += [(a, 3, b) for a, b in _phones(text)]
    return sorted(found)


# Letters of other scripts that look like ASCII ones, in the order of the ASCII letters.
_LOOK_ALIKE = {
    "аⲁα": "a", "с": "c", "ԁ": "d", "еҽ": "e", "һ": "h", "іι": "i", "ј": "j", "ӏ": "l", "ոп": "n", "оοօ": "o", "рρ": "p", "ѕ": "s", "υ": "u", "ν": "v", "ԝ": "w", "хχ": "x", "уγ": "y",
    "АΑ": "A", "ВΒ": "B", "СϹ": "C", "ЕΕ": "E", "НΗ": "H", "ІΙ": "I", "Ј": "J", "КΚ": "K", "МΜ": "M", "Ν": "N", "ОΟ": "O", "РΡ": "P", "Ѕ": "S", "ТΤ": "T", "ХΧ": "X", "УΥ": "Y", "Ζ": "Z",
    "﹫": "@", "․·。｡": ".", "‐‑‒–—−": "-", "\u00a0\u2002\u2003\u2009\u202f\u3000": " ",
}
_SINGLE = {c: to for many, to in _LOOK_ALIKE.items() for c in many}
_SINGLE |= {c: "" for c in "­​‌‍⁠﻿"}
_SINGLE |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
_SINGLE |= {chr(c): str(unicodedata.decimal(chr(c))) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Nd"}
_ODD = re.compile(f"[{re.escape(''.join(_SINGLE))}]")

# Names of the digits, and of the signs in addresses, in English, German, French and Spanish.
_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_DIGITS |= {"null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9"}
_DIGITS |= {"zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9"}
_DIGITS |= {"cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"}
_PLUS = "plus|más|mas"
_AT = "at|ät|klammeraffe|arobase|arobas|arroba"
_DOT = "dot|punkt|point|punto"
#: Endings of domains that a plain "at" may stand before, and words before it that name nobody.
_ENDINGS = {"com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "at", "ch", "fr", "be", "es", "mx", "uk", "us"}
_NOBODY = {"is", "are", "was", "were", "be", "look", "looked", "looking", "find", "found", "me", "us", "them", "it", "him", "her", "you", "here", "or", "and", "available", "page", "site"}

_NAME = "|".join(sorted(_DIGITS, key=len, reverse=True))
_UNIT = rf"(?:{_NAME}|[0-9]+)"
#: Three digits or more of which some are spelled.
_SPELLED = re.compile(rf"(?<!\w)(?:\+|(?:{_PLUS})[ -]?)?{_UNIT}(?:[ .,()-]{{1,2}}{_UNIT}){{2,}}(?!\w)", re.I)
_SPELLED_HINT = re.compile(rf"(?<!\w)(?:(?:{_NAME})[ .,()-]{{1,2}}{_UNIT}|[0-9]+[ .,()-]{{1,2}}(?:{_NAME}))(?!\w)")
_SPELLED_PART = re.compile(rf"(?:{_PLUS})[ -]?|{_NAME}|[ ,]+", re.I)
_BRACKETED = re.compile(rf"[\[({{<]{{1,2}}[ \t]*({_AT}|{_DOT}|@|\.)[ \t]*[\])}}>]{{1,2}}[ \t]*", re.I)
_SIGNS = re.compile(rf"(?<!\w)(?:{_AT}|{_DOT})(?!\w)|_(?:{_AT})_|[ \t]@", re.I)
#: The signs of the address machine: between blanks or underscores, a dot also as it is.
_PLAIN_AT = re.compile(rf"(?<![ \t])[ \t]+(?:{_AT}|@)[ \t]+|_(?:{_AT})_", re.I)
_PLAIN_DOT = re.compile(rf"[ \t]{{1,4}}(?:{_DOT}|\.)[ \t]{{1,4}}|_(?:{_DOT})_|\.", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_NUMBERS = re.compile(rf"(?<![0-9A-Za-z])[0-9]{{1,3}}(?:[ \t]{{1,4}}(?:{_DOT})[ \t]{{1,4}}[0-9]{{1,3}}){{3}}(?![0-9A-Za-z])", re.I)
_WORD_DOT = re.compile(rf"(?<![ \t])[ \t]+(?:{_DOT})[ \t]+", re.I)
#: Single characters with blanks between them, as many as an identifier has at least.
_SPACED = re.compile(r"(?<![^\s])(?:[A-Za-z0-9@._%+-][ \t]){6,}[A-Za-z0-9@._%+-](?![A-Za-z0-9@_%+-])")


class _Rewritten:
    """A text and, for each character of it, the source span it stands for."""

    def __init__(self, text: str):
        self.text, self.froms, self.tos = text, range(len(text)), range(1, len(text) + 1)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        if not edits:
            return
        text, froms, tos, at = [], [], [], 0
        for start, end, new in edits:
            text += (self.text[at:start], new)
            froms += self.froms[at:start]
            tos += self.tos[at:start]
            if start < end:
                froms += [self.froms[start]] * len(new)
                tos += [self.tos[end - 1]] * len(new)
            at = end
        text.append(self.text[at:])
        froms += self.froms[at:]
        tos += self.tos[at:]
        self.text, self.froms, self.tos = "".join(text), froms, tos


def _address_edits(text: str) -> list[tuple[int, int, str]]:
    """Signs of addresses without brackets, told by a machine: name, at, label, then dots and labels.

    A word for "at" is taken for the sign where a name stands before it and a
    spelled dot follows in the domain. Before a domain written as usual it is
    so only if the domain ends like one and the name is no common word.
    """
    edits, free = [], 0
    for at in _PLAIN_AT.finditer(text):
        if at.start() < free or not at.start() or text[at.start() - 1] not in _LOCAL:
            continue
        state, own, spelled, here = "label", [(at.start(), at.end(), "@")], at[0].startswith("_") or "@" in at[0], at.end()
        label = None
        while True:
            m = (_LABEL if state == "label" else _PLAIN_DOT).match(text, here)
            if not m:
                break
            if state == "label":
                state, here, label = "dot", m.end(), m[0]
            else:
                if not _LABEL.match(text, m.end()):
                    break
                if m[0] != ".":
                    own.append((m.start(), m.end(), "."))
                    spelled = spelled or m[0].strip(" \t_") != "."
                state, here = "label", m.end()
        dots = here > at.end() and state == "dot" and text.find(".", at.end(), here) >= 0 or len(own) > 1
        if not dots:
            continue
        name = text[max(0, at.start() - 24) : at.start()].rsplit(None, 1)[-1].lower()
        if spelled or label.lower() in _ENDINGS and name.strip(".,;:") not in _NOBODY:
            edits += own
            free = here
    return edits


def _sign_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _BRACKETED.finditer(text):
        start = m.start()
        while start and text[start - 1] in " \t":
            start -= 1
        is_at = m[1].lower() in _AT.split("|") or m[1] == "@"
        edits.append((start, m.end(), "@" if is_at else "."))
    edits += _address_edits(text)
    for m in _NUMBERS.finditer(text):
        edits += [(m.start() + d.start(), m.start() + d.end(), ".") for d in _WORD_DOT.finditer(m[0])]
    ats = sorted(end for _, end, new in edits if new == "@")
    if ats:
        # Behind a bracketed "at" the dots may be plain words.
        for m in _WORD_DOT.finditer(text):
            i = bisect_right(ats, m.start())
            if i and m.start() - ats[i - 1] <= 64:
                edits.append((m.start(), m.end(), "."))
    edits.sort()
    out, end = [], 0
    for e in edits:
        if e[0] >= end:
            out.append(e)
            end = e[1]
    return out


def rewrite(text: str) -> _Rewritten | None:
    """The text without disguises, or None where there is nothing to rewrite."""
    odd = not text.isascii() and not _SINGLE.keys().isdisjoint(set(text))
    signs = _SIGNS.search(text) or any(c in text for c in "[({<") and _BRACKETED.search(text)
    spelled = _SPELLED_HINT.search(text.lower())
    spaced = "@ " in text and _SPACED.search(text)
    if not (odd or signs or spelled or spaced):
        return None
    out = _Rewritten(text)
    if odd:
        out.replace([(m.start(), m.end(), _SINGLE[m[0]]) for m in _ODD.finditer(text)])
    out.replace(_sign_edits(out.text))
    edits = []
    for m in _SPELLED.finditer(out.text) if _SPELLED_HINT.search(out.text.lower()) else ():
        for part in _SPELLED_PART.finditer(m[0]):
            word = part[0].lower()
            new = _DIGITS.get(word, "+" if word.rstrip(" -") in _PLUS.split("|") else "")
            edits.append((m.start() + part.start(), m.start() + part.end(), new))
    out.replace(edits)
    if "@ " in out.text:
        blanks = [(m.start() + i, m.start() + i + 1, "") for m in _SPACED.finditer(out.text) if "@" in m[0] for i in range(1, len(m[0]), 2)]
        out.replace(blanks)
    return None if out.text == text else out


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans with those found behind disguises."""
    text = text or ""
    base = identifiers(text)
    plain = rewrite(text)
    if plain is None:
        return base, base
    taken = sorted((a, b) for a, _, b in base)
    reach, most = [], 0
    for _, b in taken:
        most = max(most, b)
        reach.append(most)
    more = []
    for a, kind, b in identifiers(plain.text):
        start, end = plain.froms[a], plain.tos[b - 1]
        i = bisect_right(taken, (end - 1, float("inf")))
        if not (i and reach[i - 1] > start):
            more.append((start, kind, end))
    return base, sorted(base + more)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Replace the spans by the names of their kinds; of overlapping spans the first one names all."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += (text[at:start], f"<{KINDS[kind]}>")
        at = max(at, end)
    out.append(text[at:])
    return "".join(out)


def _named(spans: list[tuple[int, int, int]]) -> list[dict]:
    return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def detect(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base_spans``, ``spans`` (arrays of kind, start, end) and ``masked_text``.

    Null texts count as empty and stay null when masked. Columns of ``docs``
    with the new names are replaced; all others stay. Repeated rows each give a
    row, an empty table none; time grows with the length of a text.
    """
    new = ["base_spans", "spans", "masked_text"]
    docs = docs.drop(*new)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    names = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offs = tc.utf8(batch.column(names.index("text")))
            for first, end, _, _ in tc.slices(offs, offs):
                part = batch.slice(first, end - first)
                base, every, masked = [], [], []
                for text in part.column(names.index("text")).to_pylist():
                    own, more = find(text)
                    base.append(_named(own))
                    every.append(_named(more))
                    masked.append(mask(text, more) if more else text)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(base, _SPANS), pa.array(every, _SPANS), pa.array(masked, pa.string())], names + new)

    kinds = [span, span, T.StringType()]
    return docs.mapInArrow(scan, T.StructType([*docs.schema, *map(T.StructField, new, kinds)]))


def summary(docs: DataFrame) -> DataFrame:
    """Counts per kind and digests of the spans: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``; counts are of base spans."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return detect(docs.select("doc_id", "text")).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(text("base_spans").cast("binary"), 256).alias("base_sha256"),
        text("spans").alias("spans"),
    )

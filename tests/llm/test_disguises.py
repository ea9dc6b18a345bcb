"""Disguised identifiers in four languages, texts that hold none, and the base columns against plain patterns."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from yardline.llm import pii


def found(text: str) -> list[tuple[str, str]]:
    return [(pii.KINDS[k], text[a:b]) for a, k, b in pii.find(text)[1]]


@pytest.mark.parametrize(
    "kind,text",
    [
        ("email", "bob at example.com"),
        ("email", "juan arroba ejemplo punto es"),
        ("email", "max klammeraffe beispiel punkt de"),
        ("email", "paul arobase exemple point fr"),
        ("email", "user_at_example_dot_com"),
        ("email", "jane [at] example [dot] org"),
        ("email", "sue (at) mail dot example dot com"),
        ("email", "ana [arroba] correo (punto) mx"),
        ("email", "j o h n @ e x a m p l e . c o m"),
        ("email", "tom @ example . com"),
        ("phone", "plus four nine one seven six one two three four five six seven"),
        ("phone", "más tres cuatro nueve uno 23 45 67 ocho"),
        ("card", "vier eins eins eins 1111 1111 1111"),
        ("card", "quatre un un un 1111 1111 un un un un"),
        ("ip", "10 dot 0 dot 12 dot 250"),
        ("ip", "192 punkt 168 punkt 0 punkt 7"),
    ],
)
def test_disguises_map_back_to_their_source(kind, text):
    inside = f"Zuvor é {text}, danach."
    assert (kind, text) in found(inside)
    start = inside.index(text)
    assert (start, pii.KINDS.index(kind), start + len(text)) in pii.find(inside)[1]


@pytest.mark.parametrize(
    "text",
    [
        "look at example.com",
        "we were at home. Then we left",
        "un deux trois, dos tres, one two",
        "a point of order, no punto final",
        "meet us at noon. Or not",
        "a b c d e f g",
        "at at at",
        "1 dot 2",
    ],
)
def test_plain_prose_is_left_alone(text):
    assert found(text) == []


def test_base_columns_equal_plain_patterns(spark):
    """The patterns as they are given, on texts that mix their parts."""
    rng = random.Random(5)
    parts = ["ann@example.org", "a.b+c@x-y.co.uk", "@", "@@", "x@y", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (170) 123-4567", "+1", "999999999999", ".", " ", "word", "é", "007.08.9.010", "+", "12"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ","]) for _ in range(rng.randrange(1, 14))) for _ in range(400)] + ["", None]
    rows = [(i % 390, t, "x", 7) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_ip int")

    def luhn(digits):
        return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, digits[::-1]))) % 10 == 0

    def base(text):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and luhn(d)]
        out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        return sorted(out)

    want = []
    for i, text, *_ in rows:
        own = base(text or "")
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in own)
        want.append((i, *(sum(k == n for _, k, _ in own) for n in range(4)), hashlib.sha256(told.encode()).hexdigest()))
    got = pii.summary(frame)
    columns = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want)
    assert sum(sum(w[1:5]) for w in want) > 400
    assert pii.summary(frame.where("false")).isEmpty()


@pytest.mark.parametrize("text", [" " * 200_000 + "at", "a at " * 60_000, "[ " * 80_000, "a " * 100_000 + "@ b", "one " * 60_000, "1 dot " * 50_000, "x dot " * 40_000 + "[at] y", "_at_" * 60_000, "1" * 200_000])
def test_long_texts_take_time_with_their_length(text):
    began = time.process_time()
    pii.find(text)
    assert time.process_time() - began < 10

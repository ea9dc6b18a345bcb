"""Spelling variants by finite-state composition.

The words that one insertion, deletion or replacement apart are the pairs that
acceptor o one-edit transducer o acceptor accepts. The vocabulary's acceptor is
never built whole. A partition holds the words that share what stands left and
right of a window in which the edit may lie: the state that the left part leads
to is its initial state. There the parts inside the window make a minimised
acceptor, and the composition is walked from that state: equal symbols up to
the edit, the edit, then the common continuations of two states.

Each word goes to the two halves of its length; halves with more than ``MOST``
words are halved again until none has. A pair's first differing place lies in
just one window, so each pair is found once. Words of the same length meet in
one class, words with one code point more visit it.

Counts are per lower-cased run; one run in ``DROP`` loses a code point before
it is counted. A null id counts as an empty text, null texts have no runs;
repeated rows count again; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardline.llm.storage import partitions, stored

#: Maximal runs of A-Z, a-z and U+00C0 to U+00FF in lower-cased UTF-8.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
DROP = 31
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: Words of a partition that are composed at once.
MOST = 20_000
#: Distinct words a worker holds before it hands counts on.
HELD = 1 << 17

_KEY = ["m", "a", "b", "lhs", "rhs"]


def count_words(name: str | None, text: str, counts: Counter) -> None:
    """Add the long enough words of one text to ``counts`` (by UTF-8)."""
    start = zlib.crc32(f"{name or ''}:".encode())
    for run, n in Counter(RUN.findall(text.encode().lower())).items():
        hashed = zlib.crc32(run, start)
        if hashed % DROP == 0:
            points = run.decode()
            at = hashed % len(points)
            run = (points[:at] + points[at + 1 :]).encode()
        if len(run) - run.count(b"\xc3") >= LEAST_LENGTH:
            counts[run] += n


def vocabulary(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``word, n`` of all words that occur at least ``LEAST_COUNT`` times."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def told() -> pa.RecordBatch:
            words = pa.array(list(counts), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                count_words(name.as_py(), text.as_py(), counts)
                if len(counts) >= HELD:
                    yield told()
                    counts.clear()
        if counts:
            yield told()

    texts = docs.where(F.col("text").isNotNull()).select(F.col(id_column).cast("string").alias("name"), "text")
    counted = texts.mapInArrow(scan, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


class Acceptor:
    """The least deterministic automaton of some words (distinct, in code-point order)."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        path, before = [0], ""

        def settle(depth: int) -> None:
            """States of the last word below ``depth`` are final in form: equal ones become one."""
            while len(path) > depth + 1:
                state = path.pop()
                same = known.setdefault((self.final[state], *self.arcs[state].items()), state)
                self.arcs[path[-1]][before[len(path) - 1]] = same

        for word in words:
            shared = 0
            while shared < min(len(word), len(before)) and word[shared] == before[shared]:
                shared += 1
            settle(shared)
            for c in word[shared:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[path[-1]][c] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            before = word
        settle(0)

    def common(self, p: int, q: int) -> list[str]:
        """What both states accept."""
        found, open_ = [], [(p, q, "")]
        while open_:
            p, q, text = open_.pop()
            if self.final[p] and self.final[q]:
                found.append(text)
            left, right = self.arcs[p], self.arcs[q]
            for c in left.keys() & right.keys():
                open_.append((left[c], right[c], text + c))
        return found

    def edits(self, p: int) -> list[tuple[str, str]]:
        """Pairs whose first difference stands at this state: one symbol for another, or one more in the second."""
        arcs, out = sorted(self.arcs[p].items()), []
        for k, (c, x) in enumerate(arcs):
            for d, y in arcs[k + 1 :]:
                out += [(c + t, d + t) for t in self.common(x, y)]
            out += [(t, c + t) for t in self.common(p, x) if t[:1] != c]
        return out

    def one_edit_pairs(self) -> Iterator[tuple[str, str]]:
        """All accepted pairs one edit apart, from the initial state on; of two lengths the shorter first."""
        made: dict[int, list[tuple[str, str]]] = {}
        open_ = [(0, "")]
        while open_:
            p, text = open_.pop()
            if p not in made:
                made[p] = self.edits(p)
            for x, y in made[p]:
                yield text + x, text + y
            open_ += [(q, text + c) for c, q in self.arcs[p].items()]


def window_pairs(middles: list[str], width: int, is_last: bool) -> Iterator[tuple[str, str]]:
    """The near pairs of a partition whose first difference is in its window of ``width`` code points.

    Middles of ``width`` are words of the partition's class, longer ones (by
    one) visitors: two of them are no pair here. An insertion behind the window belongs to the next.
    """
    for x, y in Acceptor(sorted(middles)).one_edit_pairs():
        if len(x) == width and (len(y) == width or is_last or y[:width] != x):
            yield x, y


def _windowed(words: DataFrame) -> DataFrame:
    """The rows ``word, n, m, more, a, b`` of windows as partition rows."""
    past = F.col("b") + F.col("more")
    return words.select(
        "m",
        "a",
        "b",
        F.substring("word", F.lit(1), F.col("a")).alias("lhs"),
        F.substring("word", past + 1, F.greatest(F.length("word") - past, F.lit(0))).alias("rhs"),
        "more",
        "word",
        "n",
    )


def _halved(rows: DataFrame) -> DataFrame:
    half = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    parts = F.inline(F.array(F.struct(F.col("a"), half.alias("b")), F.struct(half.alias("a"), F.col("b"))))
    return rows.select("word", "n", "m", "more", parts).where("a < b")


def _pairs(rows: DataFrame) -> DataFrame:
    """``x, x_n, y, y_n`` of the near words of all partitions."""
    dealt = rows.repartition(partitions(rows.sparkSession), *_KEY).sortWithinPartitions(*_KEY)
    names = ["x", "x_n", "y", "y_n"]

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def told(key: tuple, held: list) -> Iterator[tuple]:
            m, a, b, left, right = key
            if len(held) > 1:
                of = {word[a : b + more]: (word, n) for more, word, n in held}
                for x, y in window_pairs(list(of), b - a, b == m):
                    yield *of[x], *of[y]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        out: list[tuple] = []
        for batch in batches:
            for *own, more, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if tuple(own) != key:
                    if key is not None:
                        out += told(key, held)
                    key, held = tuple(own), []
                    if len(out) >= 4096:
                        yield batch_of(out)
                        out = []
                held.append((more, word, n))
        if key is not None:
            out += told(key, held)
        if out:
            yield batch_of(out)

    return dealt.mapInArrow(compose, "x string, x_n long, y string, y_n long")


def near_pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """``x, x_n, y, y_n`` of each two words of ``words`` (``word, n``) that one edit parts, once."""
    size = F.length("word")
    own = F.struct(size.alias("m"), F.lit(0).alias("more"))
    visit = F.struct((size - 1).alias("m"), F.lit(1).alias("more"))
    classes = F.when(size > 1, F.array(own, visit)).otherwise(F.array(own))
    rows = words.select("word", "n", F.inline(classes)).select("*", F.lit(0).alias("a"), F.col("m").alias("b"))
    found = []
    while True:
        rows = _windowed(_halved(rows))
        heavy = stored(rows.groupBy(*_KEY).count().where((F.col("count") > most) & (F.col("b") - F.col("a") > 1)).drop("count"))
        if heavy.isEmpty():
            found.append(stored(_pairs(rows)))
            break
        rows = stored(rows)
        found.append(stored(_pairs(rows.join(heavy, _KEY, "left_anti").select(rows.columns))))
        rows = rows.join(heavy, _KEY, "left_semi").select(rows.columns)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words of ``forms`` (``word, form``). A form has ten times the count, so ways are short; each round doubles them."""
    roots = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return roots


def variants(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs``: its commonest near word if that is ``TIMES`` as common, and where that leads."""
    words = stored(vocabulary(docs, id_column))
    pairs = near_pairs(words)
    both = pairs.select(F.col("x").alias("word"), F.col("y").alias("other"), F.col("y_n").alias("other_n"))
    both = both.union(pairs.select("y", "x", "x_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best)
    told = words.join(near, "word", "left")
    common = -F.col("best.less")
    is_form = common >= TIMES * F.col("n")
    told = stored(
        told.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best.other")).alias("form"),
            F.when(is_form, common).alias("form_n"),
        )
    )
    roots = _roots(told.where("form IS NOT NULL"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

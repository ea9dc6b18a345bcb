"""Benchmark decontamination with suffix arrays over the training text.

Each slice of the documents is a shard with its own suffix array over words.
Every suffix of every benchmark item is searched in it by bisection, which
gives where the item's windows of ``WINDOW`` words stand in the documents and
how long the verbatim matches are. An array holds the suffixes that start with
the first words of some benchmark suffix; others cannot match.

The benchmark is the query set: it is searched against all documents in blocks
of about ``BLOCK_BYTES`` of text, one block at a time on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from yardline.llm import textcols as tc
from yardline.llm.storage import stored

WINDOW = 13
BLOCK_BYTES = 16 << 20
START = 3
_BITS = 22
_MASK = np.uint64((1 << _BITS) - 1)
_PAD = np.uint64(0)
#: Suffixes that are searched at once.
_STRIP = 1 << 16


class Suffixes:
    """The benchmark suffixes of one block: the first WINDOW words of each, or the whole of a shorter item.

    Only word hashes travel; the tables over all suffixes are made where they are used.
    """

    def __init__(self, ids: list, texts: list):
        data, offs = tc.utf8(pa.array(texts, pa.string()))
        data = tc.LOWER[data]
        starts, ends, self.firsts = tc.words(data, offs, tc.NO_ALNUM)
        self.ids, self.hashes = ids, tc.word_hashes(data, starts, ends)
        self.at = None

    def ready(self) -> Suffixes:
        """With the first word, length, item and opening gram of each suffix."""
        if self.at is None:
            counts = np.diff(self.firsts)
            sizes = np.minimum(counts, WINDOW)
            held = np.where(counts > 0, counts - sizes + 1, 0)
            self.item = np.repeat(np.arange(len(counts)), held)
            self.length = sizes[self.item]
            at = self.firsts[self.item] + np.arange(len(self.item)) - np.repeat(np.cumsum(held) - held, held)
            self.opening = np.zeros(len(at), np.uint64)
            self.filters = {}
            for k in range(1, START + 1):
                of = np.minimum(self.length, START) == k
                if of.any():
                    self.opening[of] = tc.gram_hashes(self.hashes, k)[at[of]]
                    self.filters[k] = bits = np.zeros(1 << _BITS, bool)
                    bits[self.opening[of] & _MASK] = True
            self.at = at
        return self

    def __getstate__(self) -> dict:
        return {"ids": self.ids, "hashes": self.hashes, "firsts": self.firsts, "at": None}

    def words(self, which: np.ndarray) -> np.ndarray:
        """The words of some suffixes, short ones padded."""
        inside = np.arange(WINDOW) < self.length[which][:, None]
        spots = np.minimum(self.at[which][:, None] + np.arange(WINDOW), len(self.hashes) - 1)
        return np.where(inside, self.hashes[spots], _PAD)


def _less(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row by row: whether a < b and whether a = b in the first ``length`` words; and a's common prefix with b."""
    differ = (a != b) & (np.arange(WINDOW) < length[:, None])
    first = np.argmax(differ, axis=1)
    some = differ[np.arange(len(a)), first]
    rows = np.arange(len(a))
    return some & (a[rows, first] < b[rows, first]), np.where(some, first, length)


def _bisect(array: np.ndarray, words: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
    """For every suffix the first row of ``array`` not below it, or (``upper``) above all rows that start with it."""
    low, high = np.zeros(len(words), np.int64), np.full(len(words), len(array))
    while (open_ := low < high).any():
        mid = np.minimum((low + high) // 2, len(array) - 1)
        below, common = _less(array[mid], words, length)
        right = below | (upper & (common >= length))
        low, high = np.where(open_ & right, mid + 1, low), np.where(open_ & ~right, mid, high)
    return low


def search(data: np.ndarray, offs: np.ndarray, suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, and the occurrences of windows as (text, first word of it, words, item)."""
    data = tc.LOWER[data]
    starts, ends, firsts = tc.words(data, offs, tc.NO_ALNUM)
    counts = np.diff(firsts)
    hashes = tc.word_hashes(data, starts, ends)
    mask = np.zeros(len(hashes), bool)
    asked = np.zeros(len(suffixes.at), bool)
    for k, bits in suffixes.filters.items():
        grams = tc.gram_hashes(hashes, k)
        hit = bits[grams & _MASK]
        mask[: len(grams)] |= hit
        present = np.zeros(1 << _BITS, bool)
        present[grams[hit] & _MASK] = True
        asked |= (np.minimum(suffixes.length, START) == k) & present[suffixes.opening & _MASK]
    at, asked = np.flatnonzero(mask), np.flatnonzero(asked)
    none = np.zeros(0, np.int64)
    if not len(at) or not len(asked):
        return counts, none, none, none, none
    text = np.searchsorted(firsts, at, "right") - 1
    spots = at[:, None] + np.arange(WINDOW)
    inside = spots < firsts[text + 1][:, None]
    array = np.where(inside, hashes[np.minimum(spots, len(hashes) - 1)], _PAD)
    order = np.lexsort(array.T[::-1])
    array, at, text = array[order], at[order], text[order]
    found = []
    for first in range(0, len(asked), _STRIP):
        own = asked[first : first + _STRIP]
        words, length = suffixes.words(own), suffixes.length[own]
        low, high = _bisect(array, words, length, False), _bisect(array, words, length, True)
        n = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(n)), n)
        row = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found.append((text[row], at[row] - firsts[text[row]], length[which], suffixes.item[own][which]))
    return counts, *(np.concatenate(x) for x in zip(*found))


def _spans(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Merged spans of words, by text."""
    out: dict[int, list[tuple[int, int]]] = {}
    for t, a, b in sorted(set(zip(text.tolist(), start.tolist(), (start + length).tolist()))):
        own = out.setdefault(t, [])
        if own and a <= own[-1][1]:
            own[-1] = (own[-1][0], max(b, own[-1][1]))
        else:
            own.append((a, b))
    return out


def _scanner(sent, columns: list[str], item_type: pa.DataType, only_hits: bool):
    """A function over batches (``columns``, then ``text``): the columns, ``n_words, spans, items`` of each text."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = sent.value.ready()
        for batch in batches:
            data, offs = tc.utf8(batch.column("text"))
            for first, end, part, part_offs in tc.slices(data, offs):
                counts, text, start, length, item = search(part, part_offs, suffixes)
                spans = _spans(text, start, length)
                found = {}
                for t, i in set(zip(text.tolist(), item.tolist())):
                    found.setdefault(t, set()).add(suffixes.ids[i])
                own = [batch.column(c).slice(first, end - first) for c in columns]
                told = pa.RecordBatch.from_arrays(
                    [
                        *own,
                        pa.array(counts, pa.int64()),
                        pa.array([[{"start": a, "end": b} for a, b in spans.get(t, ())] for t in range(end - first)], kind),
                        pa.array([sorted(found.get(t, ()), key=str) for t in range(end - first)], pa.list_(item_type)),
                    ],
                    [*columns, "n_words", "spans", "items"],
                )
                yield told.take(pa.array(sorted(spans), pa.int64())) if only_hits else told

    return scan


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, spans (array of start, end in words), items`` per row of ``docs``.

    Spans are maximal runs of words inside occurring windows, ends exclusive.
    Texts or items that are null or have no words match nothing; items count
    once by id, and those without an id as one. Without items no row has spans.
    Each row of ``docs`` gives a row, also where ids repeat or are null; other
    columns are ignored.

    A benchmark of more than ``BLOCK_BYTES`` of text is searched block by block;
    the matches of each are written and then put together by text, so the
    driver and the tasks hold one block at a time.
    """
    spark = docs.sparkSession
    item = benchmark.schema["item_id"].dataType
    own = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    key, n_words = T.StructField("key", T.StringType()), T.StructField("n_words", T.LongType())
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    found = [n_words, T.StructField("spans", T.ArrayType(span)), T.StructField("items", T.ArrayType(item))]
    items = benchmark.where("text IS NOT NULL").select("item_id", "text")
    blocks = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // BLOCK_BYTES)

    def block(b: int):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        return spark.sparkContext.broadcast(Suffixes([r[0] for r in rows], [r[1] for r in rows]))

    if blocks == 1:
        scan = _scanner(block(0), ["doc_id"], to_arrow_type(item), False)
        return docs.select("doc_id", "text").mapInArrow(scan, T.StructType([own, *found]))

    keyed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("key"), "text")
    every = None
    for b in range(blocks):
        sent = block(b)
        part = keyed.select("key", "text").mapInArrow(_scanner(sent, ["key"], to_arrow_type(item), True), T.StructType([key, *found]))
        part = stored(part.groupBy("key").agg(F.first("spans").alias("spans"), F.first("items").alias("items")))
        sent.destroy()
        every = part if every is None else every.union(part)
    told = keyed.mapInArrow(_count_words, T.StructType([own, key, n_words])).join(_merged(every), "key", "left")
    return told.select("doc_id", "n_words", F.coalesce("spans", F.array()).alias("spans"), F.coalesce("items", F.array()).alias("items"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = tc.utf8(batch.column("text"))
        for first, end, part, part_offs in tc.slices(data, offs):
            _, _, firsts = tc.words(tc.LOWER[part], part_offs, tc.NO_ALNUM)
            own = [batch.column(c).slice(first, end - first) for c in ("doc_id", "key")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(firsts), pa.int64())], ["doc_id", "key", "n_words"])


def _merged(every: DataFrame) -> DataFrame:
    """One row per text from its rows of several blocks."""
    merged = every.groupBy("key").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    joined = F.expr(
        "aggregate(spans, cast(array() AS array<struct<start:bigint,end:bigint>>), (acc, s) -> "
        "CASE WHEN size(acc) > 0 AND s.start <= acc[size(acc) - 1].end "
        "THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', acc[size(acc) - 1].start, 'end', greatest(s.end, acc[size(acc) - 1].end)))) "
        "ELSE concat(acc, array(s)) END)"
    )
    return merged.withColumn("spans", joined)


def score(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest`` per document.

    Contaminated: some word is hit, and at least 5% of the words are.
    """
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return matches(docs, benchmark).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["end"] - s["start"])), F.lit(0).cast("long")).alias("longest"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; each row is judged by its own text."""
    rows = docs.select(F.struct("*").alias("doc_id"), "text")
    return score(rows, benchmark).where(~F.col("contaminated")).select(*(F.col("doc_id")[c].alias(c) for c in docs.columns))

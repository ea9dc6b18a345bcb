"""Exchange of repeated windows: brings equal windows of symbols (words or bytes) of all texts together.

A window is named by its rarest gram (a minimiser in the order of a count
sketch, then of hashes), so equal windows have equal names, and the windows of
a text fall into runs with one name. Three steps, each lossless:

1. names are exchanged; runs whose name stands nowhere else are done;
2. of the others the text of the run is exchanged, grouped by name, and a
   suffix structure finds the windows that repeat;
3. the covered ranges go back to the documents.

Names and runs that repeat inside one batch are settled there, and one witness
goes on, so a name or passage held by a third of all documents reaches a task
once per batch. The rarest gram keeps windows that only touch a common passage
away from its name. Everything moves as packed arrays, one row per batch and
bucket. Documents are told apart by a hash of id and text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardline.llm import textcols as tc
from yardline.llm.sketch import bucket as sketch_bucket
from yardline.llm.sketch import count_sketch
from yardline.llm.storage import partitions

#: Runs that are gathered before they are sent.
BATCH_RUNS = 1 << 20
#: Text of a bucket of documents, about; there are so many buckets as that takes, and two a shuffle partition at least.
BUCKET_BYTES = 64 << 20
#: Symbols that count in the order of names: grams this many times commoner than the mean come later.
COMMON = 4
LAST = 2**63 - 1


@dataclass(frozen=True)
class Symbols:
    """What windows are made of.

    ``split`` gives start and end byte of each symbol and the first symbol of
    each text, ``grams`` the hash of the ``gram`` symbols from each on.
    """

    window: int
    gram: int
    split: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    grams: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tc.words(data, offs, tc.SPACE)


def _bytes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    places = np.arange(len(data) + 1)
    return places[:-1], places[1:], offs


def word_symbols(window: int, gram: int) -> Symbols:
    return Symbols(window, gram, _words, lambda data, starts, ends: tc.gram_hashes(tc.word_hashes(data, starts, ends), gram))


def byte_symbols(window: int, gram: int) -> Symbols:
    return Symbols(window, gram, _bytes, lambda data, starts, ends: tc.byte_gram_hashes(data, gram))


def _runs(data: np.ndarray, offs: np.ndarray, symbols: Symbols, ranks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Name, text, first window start (in symbols of the text) and windows after it, of each run; and whether it may repeat within itself."""
    starts, ends, firsts = symbols.split(data, offs)
    grams = symbols.grams(data, starts, ends)
    grams = (ranks[sketch_bucket(grams)].astype(np.uint64) << np.uint64(58)) | (grams >> np.uint64(6))
    name, text, first, last, twice = tc.minimiser_runs(grams, firsts, symbols.window, symbols.gram)
    return name, text, first - firsts[text], last - first, twice


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(buckets[part[0]]), part


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


_NAMES = pa.schema([("bucket", pa.int32()), ("names", pa.binary()), ("rows", pa.binary()), ("firsts", pa.binary()), ("more", pa.binary()), ("seen", pa.binary())])
_NAMES_SQL = "bucket int, names binary, rows binary, firsts binary, more binary, seen binary"
_RUNS = pa.schema([("home", pa.int32()), ("names", pa.binary()), ("rows", pa.binary()), ("firsts", pa.binary()), ("more", pa.binary())])
_RUNS_SQL = "home int, names binary, rows binary, firsts binary, more binary"
_TEXTS = pa.schema([("bucket", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("firsts", pa.binary()), ("texts", pa.list_(pa.binary())), ("starts", pa.binary()), ("ends", pa.binary())])
_TEXTS_SQL = "bucket int, rows binary, ids binary, firsts binary, texts array<binary>, starts binary, ends binary"
_RANGES = pa.schema([("home", pa.int32()), ("rows", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary())])
_RANGES_SQL = "home int, rows binary, starts binary, ends binary"


def _joined(column, kind=np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def keyed(docs: DataFrame, buckets: int) -> DataFrame:
    """``home, row, id, doc_id, text``: ``row`` names the document, ``home`` its bucket; a null id comes after all others."""
    row = F.xxhash64(F.col("doc_id"), F.col("text"))
    return docs.select(
        F.pmod(row, F.lit(buckets)).cast("int").alias("home"), row.alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), "doc_id", "text"
    )


def names_met(rows: DataFrame, symbols: Symbols, buckets: int) -> DataFrame:
    """Step 1: the runs, by home, whose names stand at more than one place."""
    spark = rows.sparkSession

    def items(data, offs):
        starts, ends, _ = symbols.split(data, offs)
        return symbols.grams(data, starts, ends)

    counts = count_sketch(rows.select("text"), items).astype(np.float64)
    mean = max(1.0, counts.sum() / len(counts))
    ranks = np.minimum(63, np.ceil(np.log2(np.maximum(1, counts / (COMMON * mean))))).astype(np.uint8)
    sent = spark.sparkContext.broadcast(ranks)

    def send(got: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        name, row, first, more, twice = (np.concatenate(c) for c in zip(*got))
        order = np.argsort(name, kind="stable")
        name, row, first, more, twice = name[order], row[order], first[order], more[order], twice[order]
        new = np.append(True, name[1:] != name[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(name)))
        met = (size > 1) | np.maximum.reduceat(twice, start)
        alone = np.repeat(~met, size)
        seen = name[new][met]
        out = []
        asked = {b: at for b, at in _by_bucket((name[alone] % np.uint64(buckets)).astype(np.int64))}
        shown = {b: at for b, at in _by_bucket((seen % np.uint64(buckets)).astype(np.int64))}
        n, r, f, m = name[alone], row[alone], first[alone], more[alone]
        none = np.zeros(0, np.int64)
        for b in asked.keys() | shown.keys():
            at, up = asked.get(b, none), shown.get(b, none)
            out.append((b, n[at].tobytes(), r[at].tobytes(), f[at].astype(np.int32).tobytes(), m[at].astype(np.int32).tobytes(), seen[up].tobytes()))
        n, r, f, m = name[~alone], row[~alone], first[~alone], more[~alone]
        # Settled here: straight to their homes, by buckets of their own.
        for home, at in _by_bucket(r % buckets):
            out.append((buckets + home, n[at].tobytes(), r[at].tobytes(), f[at].astype(np.int32).tobytes(), m[at].astype(np.int32).tobytes(), b""))
        return _batch(out, _NAMES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for batch in batches:
            row = batch.column(0).to_numpy()
            data, offs = tc.utf8(batch.column(1))
            for first, _, part, part_offs in tc.slices(data, offs):
                name, text, start, more, twice = _runs(part, part_offs, symbols, sent.value)
                if len(name):
                    got.append((name, row[first:][text], start, more, twice))
                    held += len(name)
                if held >= BATCH_RUNS:
                    yield send(got)
                    got, held = [], 0
        if got:
            yield send(got)

    def meet(table: pa.Table) -> pa.Table:
        name, row, first, more = _joined(table["names"], np.uint64), _joined(table["rows"]), _joined(table["firsts"], np.int32), _joined(table["more"], np.int32)
        if len(table) and table["bucket"][0].as_py() < buckets:
            seen = _joined(table["seen"], np.uint64)
            every = np.sort(np.concatenate([name, seen]))
            twice = np.unique(every[1:][every[1:] == every[:-1]])
            at = np.minimum(np.searchsorted(twice, name), max(0, len(twice) - 1))
            met = twice[at] == name if len(twice) else np.zeros(len(name), bool)
            name, row, first, more = name[met], row[met], first[met], more[met]
        return pa.Table.from_batches(
            [_batch([(h, name[at].tobytes(), row[at].tobytes(), first[at].tobytes(), more[at].tobytes()) for h, at in _by_bucket(row % buckets)], _RUNS)]
        )

    return rows.select("row", "text").mapInArrow(scan, _NAMES_SQL).groupBy("bucket").applyInArrow(meet, _RUNS_SQL)


def _texts_of(table: pa.Table) -> dict[int, tuple[int, bytes]]:
    """Row -> (id, text bytes); repeated rows are one."""
    data, offs = tc.utf8(table["text"])
    raw = data.tobytes()
    return {r: (i, raw[a:b]) for r, i, a, b in zip(table["row"].to_pylist(), table["id"].to_pylist(), offs[:-1].tolist(), offs[1:].tolist())}


def _cut(text: bytes, firsts: np.ndarray, more: np.ndarray, symbols: Symbols) -> list[bytes]:
    """The text of each run, from its first window's start to its last one's end; words are joined by one blank."""
    if symbols.split is _bytes:
        return [text[a:b] for a, b in zip(firsts.tolist(), (firsts + more + symbols.window).tolist())]
    words = text.split()
    return [b" ".join(words[a:b]) for a, b in zip(firsts.tolist(), (firsts + more + symbols.window).tolist())]


def covered(docs: DataFrame, symbols: Symbols, settle: Callable, find: Callable) -> tuple[DataFrame, DataFrame]:
    """Steps 1 to 3: the keyed documents, and the ranges of symbols, packed by home, that repeated windows cover.

    ``settle(names, texts, rows, ids, firsts)`` sees the runs of one batch and
    returns (indices of runs that must be asked for, indices of witnesses,
    indices of runs that are covered as a whole). ``find(texts, ids)`` sees all
    asked runs and witnesses of some names and returns (indices of runs, start
    and end of covered symbols in them).
    """
    spark = docs.sparkSession
    held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * partitions(spark), held // BUCKET_BYTES) | 1
    rows = keyed(docs, buckets)
    runs = names_met(rows, symbols, buckets)

    def open_runs(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.Table.from_batches([_batch([], _TEXTS)])
        name, row, first, more = _joined(right["names"], np.uint64), _joined(right["rows"]), _joined(right["firsts"], np.int32), _joined(right["more"], np.int32)
        order = np.lexsort([first, row])
        name, row, first, more = name[order], row[order], first[order], more[order]
        cuts = np.flatnonzero(np.diff(row)) + 1 if len(row) else []
        held, texts, ids = _texts_of(left), [], []
        for at in np.split(np.arange(len(row)), cuts) if len(row) else ():
            own, text = held[int(row[at[0]])]
            texts += _cut(text, first[at], more[at], symbols)
            ids += [own] * len(at)
        ids = np.array(ids, np.int64)
        ask, witness, whole = settle(name, texts, row, ids, first)
        out = []
        sent = np.concatenate([ask, witness]).astype(np.int64)
        answer = np.concatenate([first[ask], np.full(len(witness), -1)])
        empty = np.zeros(0, np.int64).tobytes()
        for b, at in _by_bucket((name[sent] % np.uint64(buckets)).astype(np.int64)):
            which = sent[at]
            out.append((b, row[which].tobytes(), ids[which].tobytes(), answer[at].astype(np.int64).tobytes(), [texts[i] for i in which], empty, empty))
        if len(whole):
            start, end = first[whole].astype(np.int64), (first[whole] + more[whole] + symbols.window).astype(np.int64)
            out.append((buckets + int(key[0].as_py()), row[whole].tobytes(), empty, empty, [], start.tobytes(), end.tobytes()))
        return pa.Table.from_batches([_batch(out, _TEXTS)])

    def find_repeats(table: pa.Table) -> pa.Table:
        row, first, start, end = (_joined(table[c]) for c in ("rows", "firsts", "starts", "ends"))
        if table["bucket"][0].as_py() < buckets:
            texts = [x for c in table["texts"].to_pylist() for x in c]
            which, start, end = find(texts, _joined(table["ids"]))
            wanted = first[which] >= 0
            which, start, end = which[wanted], start[wanted], end[wanted]
            row, start, end = row[which], first[which] + start, first[which] + end
        return pa.Table.from_batches([_batch([(h, row[at].tobytes(), start[at].tobytes(), end[at].tobytes()) for h, at in _by_bucket(row % buckets)], _RANGES)])

    texts = rows.groupBy("home").cogroup(runs.groupBy("home")).applyInArrow(open_runs, _TEXTS_SQL)
    return rows, texts.groupBy("bucket").applyInArrow(find_repeats, _RANGES_SQL)


def assemble(rows: DataFrame, ranges: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """``finish(doc_id column, texts, ranges)`` on the documents of each home; ranges are sorted (start, end) lists by document."""

    def close(left: pa.Table, right: pa.Table) -> pa.Table:
        row, start, end = (_joined(right[c]) for c in ("rows", "starts", "ends"))
        order = np.lexsort([end, start, row])
        own: dict[int, list[tuple[int, int]]] = {}
        for r, a, b in zip(row[order].tolist(), start[order].tolist(), end[order].tolist()):
            spans = own.setdefault(r, [])
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
            else:
                spans.append((a, b))
        data, offs = tc.utf8(left["text"])
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        return finish(left["doc_id"], texts, [own.get(r, []) for r in left["row"].to_pylist()])

    return rows.groupBy("home").cogroup(ranges.groupBy("home")).applyInArrow(close, schema)

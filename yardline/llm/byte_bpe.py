"""Byte-level BPE encoding and decoding of whole texts, long ones in overlapping chunks.

A text of more than ``CHUNK`` code points is cut into chunks whose windows
overlap by ``OVERLAP``. Chunks are pre-tokenised in parallel, each from its own
start, where the first boundaries may be wrong. The first boundary in an
overlap that both neighbours have is where they resynchronise: from there on
the later chunk has the boundaries of the whole text. So the text falls into
pieces, each from one such boundary to the next and inside one window, which
are encoded in parallel and joined. Where two neighbours never agree (one
pre-token covers the overlap) the rest of that text is one piece.

Pairs of a pre-token merge by least rank, leftmost first. Decoding joins the
bytes of the ids.

Null texts count as empty and have no ids; repeated rows each give a row, and
equal long texts are encoded once; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yardline.llm.storage import stored

CHUNK, OVERLAP = 1 << 14, 1 << 10
#: Code points after a match that can still change it: the longest literal of the pattern and one look ahead.
MARGIN = 8
#: Pre-tokens a worker remembers, twice over: those since the last turn, and those asked for in the turn before.
REMEMBERED, LONGEST_REMEMBERED = 1 << 16, 64
LIMITS = (0x100, 0x10000, 0x110000)
#: Bytes of a pre-token up to which its pairs are kept in a list.
SHORT = 64


_ESCAPE = re.compile(r"\\p\{\w+\}|\\s|\\S")


def _ranges(escape: str, limit: int) -> str:
    """The code points below ``limit`` of a class escape as ranges, by the encoder library: engines follow different Unicode versions."""
    every = "".join(map(chr, (c for c in range(limit) if not 0xD800 <= c < 0xE000)))
    single = {bytes([i]): i for i in range(256)}
    encoder = tiktoken.Encoding("class", pat_str=escape, mergeable_ranks=single, special_tokens={})
    points = list(map(ord, bytes(encoder.encode_ordinary(every)).decode()))
    first = [c for k, c in enumerate(points) if not k or points[k - 1] != c - 1]
    last = [c for k, c in enumerate(points) if k + 1 == len(points) or points[k + 1] != c + 1]
    return "".join(f"{re.escape(chr(x))}-{re.escape(chr(y))}" for x, y in zip(first, last))


def _width(text: str) -> int:
    """The first of ``LIMITS`` above all characters. Classes of few ranges are faster to look up."""
    try:
        text.encode("latin-1")
        return 0
    except UnicodeEncodeError:
        return 1 if len(text.encode("utf-16-le")) == 2 * len(text) else 2


def spelled_out(pattern: str, limit: int) -> str:
    """``pattern`` for texts of code points below ``limit``, with its class escapes written as ranges."""
    known: dict[str, str] = {}
    out, at, inside = [], 0, False
    while at < len(pattern):
        if escape := _ESCAPE.match(pattern, at):
            name = escape.group()
            if inside and name == "\\S":
                raise ValueError("\\S inside a class is not supported")
            plain = "\\s" if name == "\\S" else name
            if plain not in known:
                known[plain] = _ranges(plain, limit)
            whole = f"[{known[plain]}]" if known[plain] else "(?!)"
            out.append(known[plain] if inside else whole if name == plain else f"(?:(?!{whole})(?s:.))")
            at = escape.end()
            continue
        step = 2 if pattern[at] == "\\" else 1
        inside = {"[": True, "]": False}.get(pattern[at], inside)
        out.append(pattern[at : at + step])
        at += step
    return "".join(out)


@dataclass
class Tokenizer:
    """Ranks of byte strings and the pattern that cuts a text into pre-tokens; it must match every character and have no groups."""

    ranks: dict[bytes, int]
    #: The pattern for texts of narrow, wider and all characters (``LIMITS``).
    patterns: tuple[str, ...]
    _encoder: Encoder | None = field(default=None, repr=False, compare=False)

    @classmethod
    def load(cls, path: str, pattern: str) -> Tokenizer:
        """From a file of lines ``base64 rank``."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return cls(ranks, tuple(spelled_out(pattern, limit) for limit in LIMITS))

    def ready(self) -> Encoder:
        """One encoder per worker process, which so remembers pre-tokens from task to task."""
        if self._encoder is None:
            self._encoder = Encoder(self)
        return self._encoder

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "patterns": self.patterns, "_encoder": None}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of least rank merges first, of equal ones the leftmost."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    return _merge_short(piece, ranks) if len(piece) <= SHORT else _merge_long(piece, ranks)


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """With the rank of each adjacent pair in a list, searched anew for each merge."""
    edges, none = list(range(len(piece) + 1)), 1 << 62
    pairs = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) != none:
        i = pairs.index(least)
        del edges[i + 1], pairs[i]
        if i:
            pairs[i - 1] = ranks.get(piece[edges[i - 1] : edges[i + 1]], none)
        if i < len(pairs):
            pairs[i] = ranks.get(piece[edges[i] : edges[i + 2]], none)
    return [ranks[piece[a:b]] for a, b in pairwise(edges)]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """With a heap of pairs, so that time does not grow with the square of the length."""
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two has merged since
        end[i], alive[j], after[i] = stop, False, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (rank := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (rank, i, end[after[i]]))
        if before[i] >= 0 and (rank := ranks.get(piece[before[i] : stop])) is not None:
            heapq.heappush(heap, (rank, before[i], stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder(dict):
    """The ids of a pre-token, as bytes of 32-bit numbers, made when they are first asked for."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.before: dict[str, bytes] = {}
        self.ranks, self.finders = tokenizer.ranks, [re.compile(p).findall for p in tokenizer.patterns]

    def __missing__(self, token: str) -> bytes:
        ids = self.before.get(token) or array("i", merge(token.encode(), self.ranks)).tobytes()
        if len(token) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[token] = ids
        return ids

    def pretokens(self, text: str) -> list[str]:
        tokens = self.finders[_width(text)](text)
        if sum(map(len, tokens)) != len(text):
            raise ValueError("the pattern leaves out characters of a text")
        return tokens

    def boundaries(self, text: str) -> list[int]:
        """Ends of the pre-tokens."""
        out, at = [], 0
        for token in self.pretokens(text):
            at += len(token)
            out.append(at)
        return out

    def packed(self, text: str, start: int = 0, stop: int | None = None) -> bytes:
        """Ids of the pre-tokens from boundary ``start`` to boundary ``stop``; what follows is looked at only."""
        tokens = self.pretokens(text[start:])
        if stop is not None:
            at = start
            for k, token in enumerate(tokens):
                if at >= stop:
                    tokens = tokens[:k]
                    break
                at += len(token)
            if at != stop:
                raise ValueError("a piece does not end at a boundary")
        return b"".join(map(self.__getitem__, tokens))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()


def _lists(packed: list[bytes]) -> pa.ListArray:
    """One list of ids per text."""
    offsets = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def overlaps(window: str, encoder: Encoder, chunk: int, overlap: int, is_last: bool) -> tuple[list[int], list[int]]:
    """Boundaries of a chunk's window in the overlap with the chunk before, and with the next one, each from the overlap's start."""
    sure = len(window) if is_last else len(window) - MARGIN
    found = [0, *(b for b in encoder.boundaries(window) if b <= sure)]
    return [b for b in found if b <= overlap], [b - chunk for b in found if b >= chunk]


def _long_ids(texts: DataFrame, sent, chunk: int, overlap: int) -> DataFrame:
    """``key, ids`` of the distinct texts of ``texts`` (``key, text``), all longer than ``chunk``."""
    size = F.length("text")
    cut = texts.select("key", size.alias("size"), "text", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / chunk).cast("int"))).alias("i"))
    window = F.substring("text", F.col("i") * chunk + 1, F.lit(chunk + overlap))
    last = (F.col("i") * chunk + chunk + overlap >= F.col("size")).alias("is_last")
    windows = cut.select("key", "i", last, window.alias("window")).groupBy("key", "i").agg(F.first("is_last").alias("is_last"), F.first("window").alias("window"))

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = sent.value.ready()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [overlaps(w, encoder, chunk, overlap, e) for e, w in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                ends = [pa.array([g[k] for g in got], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), *ends], ["key", "i", "window", "head", "tail"])

    chunks = stored(windows.mapInArrow(pretokenise, "key string, i int, window string, head array<int>, tail array<int>"))
    in_order = Window.partitionBy("key").orderBy("i")
    common = F.array_min(F.array_intersect(F.lag("tail").over(in_order), "head"))
    met = chunks.select("key", "i", F.when(F.col("i") == 0, 0).otherwise(common).alias("start"))
    broken = F.max(F.col("start").isNull()).over(in_order)
    met = met.withColumn("start", F.when(~broken, F.col("start")))
    piece = F.last(F.when(F.col("start").isNotNull(), F.col("i")), ignorenulls=True).over(in_order)
    stop = F.when(F.lead("start").over(in_order).isNotNull(), F.lead("start").over(in_order) + chunk)
    pieces = met.select("key", "i", piece.alias("piece"), "start", stop.alias("stop"))
    parts = chunks.select("key", "i", "window").join(pieces, ["key", "i"]).groupBy("key", "piece").agg(F.sort_array(F.collect_list(F.struct("i", "start", "stop", "window"))).alias("parts"))

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = sent.value.ready()
        for batch in batches:
            for at in range(batch.num_rows):
                part = batch.slice(at, 1)
                own = part.column(2)[0].as_py()
                text = "".join(x["window"][:chunk] for x in own[:-1]) + own[-1]["window"]
                ids = encoder.packed(text, own[0]["start"], own[-1]["stop"])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists([ids])], ["key", "piece", "ids"])

    encoded = parts.mapInArrow(encode_pieces, "key string, piece int, ids array<int>")
    in_row = F.sort_array(F.collect_list(F.struct("piece", "ids")))
    return encoded.groupBy("key").agg(F.flatten(F.transform(in_row, lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, tokenizer: Tokenizer, *, chunk: int = CHUNK, overlap: int = OVERLAP, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, ids`` per row of ``docs`` (``doc_id, text``)."""
    if not MARGIN < overlap <= chunk:
        raise ValueError("an overlap must be longer than the margin and no longer than a chunk")
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = sent.value.ready()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encoder.packed(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids)], ["doc_id", "ids"])

    schema = f"doc_id {docs.schema[id_column].dataType.simpleString()}, ids array<int>"
    short = rows.where(F.length("text") <= chunk).mapInArrow(whole, schema)
    long = rows.where(F.length("text") > chunk).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("key"), "text")
    ids = _long_ids(long.select("key", "text"), sent, chunk, overlap)
    return short.unionByName(long.select("doc_id", "key").join(ids, "key").select("doc_id", "ids"))


class ByteTable:
    """The bytes of all ids, one after another."""

    def __init__(self, ranks: dict[bytes, int]):
        self.sizes = np.full(max(ranks.values(), default=-1) + 1, -1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        held = np.maximum(self.sizes, 0)
        self.starts = np.cumsum(held) - held
        self.bytes = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)

    def decoded(self, lists: pa.ListArray) -> pa.Array:
        """The joined bytes of each list; null of null."""
        ids = np.asarray(lists.flatten(), np.int64)
        known = (ids >= 0) & (ids < len(self.sizes))
        known[known] = self.sizes[ids[known]] >= 0
        if not known.all():
            raise ValueError(f"no token has the id {ids[~known][0]}")
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        place = np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])
        offsets = ends[np.cumsum([0, *pc.fill_null(lists.value_lengths(), 0).to_pylist()])]
        buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.bytes[place])]
        texts = pa.Array.from_buffers(pa.large_binary(), len(lists), buffers).cast(pa.binary())
        return pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.binary()))


def decode(encoded: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """All columns of ``encoded`` and ``decoded``, the bytes of its ``ids``; null where they are null. An id without bytes is an error."""
    sent = encoded.sparkSession.sparkContext.broadcast(tokenizer)
    columns, at = encoded.columns, encoded.columns.index("ids")
    carried = [i for i, c in enumerate(columns) if c != "decoded"]
    names = [*(columns[i] for i in carried), "decoded"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ByteTable(sent.value.ranks)
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in carried), table.decoded(part.column(at))], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "decoded")
    return encoded.mapInArrow(scan, f"{kinds}, decoded binary")

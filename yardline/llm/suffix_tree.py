"""Substring deduplication over words with prefix-partitioned suffix trees.

The suffixes of all repeated runs of one task are split by prefixes: by their
first word, and where that leaves more than ``GROUP`` suffixes by one word
more, and so on; small neighbouring prefixes share a group. Each group gets a
suffix tree of its own, so memory is bounded by the group. An internal node at
the depth of a window is a repeat; the least document below it keeps it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from yardline.llm import repeats

WINDOW = 13
GRAM = 4
GROUP = 50_000


def prefix_groups(words: np.ndarray, starts: np.ndarray, depth: int, limit: int = GROUP, at: int = 0) -> Iterator[np.ndarray]:
    """Indices of suffixes in groups of common prefixes, of up to ``limit`` unless all ``depth`` words agree."""
    todo = [(np.arange(len(starts)), at)]
    while todo:
        own, at = todo.pop()
        if len(own) <= limit or at >= depth:
            if len(own):
                yield own
            continue
        key = words[starts[own] + at]
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(own))
        held = 0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a > limit:
                if held < a:
                    todo.append((own[held:a], depth))
                todo.append((own[a:b], at + 1))
                held = b
            elif b - held > limit:
                todo.append((own[held:a], depth))
                held = a
        if held < len(own):
            todo.append((own[held:], depth))


def deep_nodes(words: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix tree's leaves in order, and where the nodes ``depth`` words deep begin.

    The tree is built from its root down: at each word the leaves below a node
    part into its children, until they part no more or ``depth`` is reached.
    """
    order = np.arange(len(starts))
    node = np.zeros(len(starts), np.int64)
    for at in range(depth):
        inner = np.append(False, node[1:] == node[:-1]) | np.append(node[1:] == node[:-1], False)
        if not inner.any():
            break
        place = np.flatnonzero(inner)
        own = order[place]
        key = words[starts[own] + at]
        sorted_ = np.lexsort([key, node[place]])
        order[place] = own[sorted_]
        key, held = key[sorted_], node[place]
        parts = np.zeros(len(starts), bool)
        parts[place[1:][(key[1:] != key[:-1]) & (held[1:] == held[:-1])]] = True
        node = np.cumsum(np.append(True, node[1:] != node[:-1]) | parts)
    begin = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
    return order, begin


def _settle(names, texts, rows, ids, firsts):
    """Of equal runs in the batch those of the least document go on; the others repeat it as a whole."""
    where: dict[bytes, list[int]] = {}
    for i, t in enumerate(texts):
        where.setdefault(t, []).append(i)
    ask, whole = [], []
    for own in where.values():
        least = min(ids[i] for i in own) if len(own) > 1 else ids[own[0]]
        for i in own:
            (ask if ids[i] == least else whole).append(i)
    return np.array(ask, np.int64), np.zeros(0, np.int64), np.array(whole, np.int64)


def _find(window: int, limit: int):
    def find(texts: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        where: dict[bytes, list[int]] = {}
        for i, t in enumerate(texts):
            where.setdefault(t, []).append(i)
        groups = list(where.values())
        number: dict[bytes, int] = {}
        split = [t.split(b" ") for t in where]
        words = np.array([number.setdefault(w, len(number)) for own in split for w in own], np.int64)
        sizes = np.array([len(x) for x in split], np.int64)
        least = np.array([min(ids[i] for i in own) for own in groups], np.int64)
        windows = sizes - window + 1
        text = np.repeat(np.arange(len(groups)), windows)
        inside = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
        starts = (np.cumsum(sizes) - sizes)[text] + inside
        first_doc = least[text]
        for own in prefix_groups(words, starts, window, limit):
            order, begin = deep_nodes(words, starts[own], window)
            leaves = own[order]
            below = np.minimum.reduceat(first_doc[leaves], begin)
            first_doc[leaves] = np.repeat(below, np.diff(np.append(begin, len(leaves))))
        out = ([], [], [])
        ends = np.cumsum(windows)
        for t, members in enumerate(groups):
            earliest = first_doc[ends[t] - windows[t] : ends[t]]
            for i in members:
                gone = np.flatnonzero(earliest < ids[i])
                if not len(gone):
                    continue
                fresh = np.append(True, np.diff(gone) != 1)
                for a, b in zip(gone[fresh].tolist(), gone[np.append(fresh[1:], True)].tolist()):
                    out[0].append(i)
                    out[1].append(a)
                    out[2].append(b + window)
        return tuple(np.array(x, np.int64) for x in out)

    return find


def deduplicate(docs: DataFrame, window: int = WINDOW, limit: int = GROUP) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans, kept`` per row of ``docs`` (``doc_id, text``).

    Every word goes that is covered by a window of ``window`` words whose words
    also follow each other in a document with a smaller ``doc_id`` (an integer; null comes
    last; texts without an id keep each other's words). Null texts have no words; a row that repeats id and text gives its
    result again. A text is worked on whole however long it is; an empty table gives
    no rows. Spans are in words; other columns are ignored.
    """
    rows, ranges = repeats.covered(docs, repeats.word_symbols(window, min(GRAM, window)), _settle, _find(window, limit))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(ids, texts: list[bytes], spans: list[list[tuple[int, int]]]) -> pa.Table:
        n_words, removed, kept = [], [], []
        for text, own in zip(texts, spans):
            words = text.split()
            n_words.append(len(words))
            at, parts = 0, []
            for a, b in own:
                parts += words[at:a]
                at = b
            parts += words[at:]
            removed.append(len(words) - len(parts))
            kept.append(b" ".join(parts))
        return pa.table(
            {
                "doc_id": ids,
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                "spans": pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], kind),
                "kept": pa.array([k.decode() for k in kept], pa.string()),
            }
        )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept string"
    return repeats.assemble(rows, ranges, finish, schema)

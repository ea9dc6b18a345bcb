"""Substring deduplication over bytes with a deep-shallow suffix sort.

Suffixes are sorted by multikey quicksort, eight bytes a key and three parts a
step, down to a shallow depth. Groups still together have long common prefixes; a blind trie orders
each: only where a suffix leaves the group's first one and by which byte is
kept. All groups of a task are sorted at once in numpy. Suffixes that stay
together for ``WINDOW`` bytes are repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from yardline.llm import repeats

WINDOW = 200
GRAM = 24
SHALLOW = 24
#: Suffixes of a group that is not parted any more, but sorted.
SMALL = 1024


def deep_shallow(text: np.ndarray, starts: np.ndarray, depth: int = WINDOW, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``depth`` bytes, and whether each one equals the one before it so far.

    Every suffix has ``depth`` bytes at least; ``depth`` and ``shallow`` are multiples of eight.
    """
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    eight = np.zeros(len(text) + 1, np.uint64)
    for i in range(8):
        eight = (eight << np.uint64(8)) | padded[i : i + len(text) + 1]
    order, group = _multikey_quicksort(eight, starts, min(shallow, depth))
    reach = np.full(len(starts), min(shallow, depth))
    done = np.zeros(len(starts), bool)
    while (open_ := _together(group) & ~done).any():
        place = np.flatnonzero(open_)
        own, held = order[place], group[place]
        first = np.append(True, held[1:] != held[:-1])
        path = own[first][np.cumsum(first) - 1]
        common, byte_own, byte_path = _leave(eight, starts[own], starts[path], reach[place], depth)
        side = np.where(common >= depth, 0, np.where(byte_own < byte_path, -1, 1))
        turn = np.where(side < 0, common, np.where(side > 0, depth - common, 0))
        sorted_ = np.lexsort([byte_own, turn, side, held])
        order[place] = own[sorted_]
        held, side, turn, branch, common = held[sorted_], side[sorted_], turn[sorted_], byte_own[sorted_], common[sorted_]
        apart = (held[1:] == held[:-1]) & ((side[1:] != side[:-1]) | (turn[1:] != turn[:-1]) | ((branch[1:] != branch[:-1]) & (side[1:] != 0)))
        split = np.zeros(len(starts), bool)
        split[place[1:][apart]] = True
        group = np.cumsum(np.append(True, group[1:] != group[:-1]) | split)
        done[place] = side == 0
        reach[place] = common
    same = np.append(False, group[1:] == group[:-1]) if len(group) else np.zeros(0, bool)
    return order, same


def _multikey_quicksort(eight: np.ndarray, starts: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``shallow`` bytes, and the group of each along it: runs of one number agree so far.

    A group parts in three by its pivot, the middle one of three keys: below,
    equal, above. The equal ones go on to their next key, the others keep
    theirs. All groups part at once; those of up to ``SMALL`` are sorted by their keys at the end.
    """
    order, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    at = np.zeros(len(starts), np.int64)  # bytes that a group agrees in
    keys = eight[starts]  # the next ones, along the order
    while True:
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(group)))
        wide = np.repeat(size > SMALL, size) & (at < shallow)
        if not wide.any():
            break
        place = np.flatnonzero(wide)
        own, held, key = order[place], group[place], keys[place]
        head = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
        count = np.diff(np.append(head, len(held)))
        a, b, c = key[head], key[head + count // 2], key[head + count - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), count)
        side = (key > pivot).astype(np.int8) - (key < pivot).astype(np.int8)
        parted = np.lexsort([side, held])
        order[place], side, keys[place] = own[parted], side[parted], key[parted]
        on = place[side == 0]
        at[on] += 8
        keys[on] = eight[np.minimum(starts[order[on]] + at[on], len(eight) - 1)]
        split = np.zeros(len(group), bool)
        split[place[1:][(side[1:] != side[:-1]) & (held[1:] == held[:-1])]] = True
        group = np.cumsum(np.append(True, group[1:] != group[:-1]) | split)
    while (open_ := _together(group) & (at < shallow)).any():
        place = np.flatnonzero(open_)
        own, held = order[place], group[place]
        key = eight[starts[own] + at[place]]
        sorted_ = np.lexsort([key, held])
        order[place], key = own[sorted_], key[sorted_]
        at[place] += 8
        split = np.zeros(len(group), bool)
        split[place[1:][(key[1:] != key[:-1]) & (held[1:] == held[:-1])]] = True
        group = np.cumsum(np.append(True, group[1:] != group[:-1]) | split)
    return order, group


def _together(group: np.ndarray) -> np.ndarray:
    """Members of groups of two and more."""
    if not len(group):
        return np.zeros(0, bool)
    equal = group[1:] == group[:-1]
    return np.append(equal, False) | np.append(False, equal)


def _leave(eight: np.ndarray, a: np.ndarray, b: np.ndarray, reach: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How long a and b agree (``depth`` at most), and the byte of each where they part."""
    common = np.full(len(a), depth)
    byte_a, byte_b = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    at = reach - reach % 8
    while len(active):
        x, y = eight[a[active] + at[active]], eight[b[active] + at[active]]
        parted = x != y
        if parted.any():
            who, x, y = active[parted], x[parted], y[parted]
            differ = x ^ y
            lead = np.zeros(len(who), np.int64)
            for i in range(7):
                lead += (lead == i) & (differ >> np.uint64(56 - 8 * i) == 0)
            shift = (np.uint64(56) - np.uint64(8) * lead.astype(np.uint64))
            common[who] = at[who] + lead
            byte_a[who], byte_b[who] = (x >> shift) & np.uint64(255), (y >> shift) & np.uint64(255)
        active = active[~parted]
        at[active] += 8
        active = active[at[active] < depth]
    return common, byte_a, byte_b


def _settle(names, texts, rows, ids, firsts):
    """Runs that stand twice in the batch repeat as a whole; one of them goes on as a witness."""
    where: dict[bytes, list[int]] = {}
    for i, t in enumerate(texts):
        where.setdefault(t, []).append(i)
    ask = [x[0] for x in where.values() if len(x) == 1]
    witness = [x[0] for x in where.values() if len(x) > 1]
    whole = [i for x in where.values() if len(x) > 1 for i in x]
    return np.array(ask, np.int64), np.array(witness, np.int64), np.array(whole, np.int64)


def _find(window: int):
    def find(texts: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        where: dict[bytes, list[int]] = {}
        for i, t in enumerate(texts):
            where.setdefault(t, []).append(i)
        single = list(where)
        data = np.frombuffer(b"".join(single), np.uint8)
        sizes = np.array([len(t) for t in single], np.int64)
        windows = sizes - window + 1
        text = np.repeat(np.arange(len(single)), windows)
        inside = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
        starts = (np.cumsum(sizes) - sizes)[text] + inside
        order, same = deep_shallow(data, starts, window)
        again = np.zeros(len(starts), bool)
        again[order[same]] = True
        again[order[:-1][same[1:]]] = True
        many = np.array([len(x) > 1 for x in where.values()], bool)
        again |= many[text]
        hit = np.flatnonzero(again)
        fresh = np.append(True, (np.diff(hit) != 1) | (np.diff(text[hit]) != 0)) if len(hit) else np.zeros(0, bool)
        first = hit[fresh]
        last = hit[np.append(fresh[1:], True)] if len(hit) else hit
        out = ([], [], [])
        groups = list(where.values())
        for t, a, b in zip(text[first].tolist(), inside[first].tolist(), (inside[last] + window).tolist()):
            for i in groups[t]:
                out[0].append(i)
                out[1].append(a)
                out[2].append(b)
        return tuple(np.array(x, np.int64) for x in out)

    return find


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept`` per row of ``docs`` (``doc_id, text``).

    Every byte covered by a string of ``window`` bytes that also starts elsewhere, in any
    text, goes. Null texts are empty; a row that repeats id and text is a text of
    its own, so both lose what is long enough. ``kept`` is binary, since a cut may split a character.
    A text is worked on whole however long it is; an empty table gives no rows.
    Other columns are ignored.
    """
    rows, ranges = repeats.covered(docs, repeats.byte_symbols(window, min(GRAM, window)), _settle, _find(window))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(ids, texts: list[bytes], spans: list[list[tuple[int, int]]]) -> pa.Table:
        kept = []
        for text, own in zip(texts, spans):
            at, parts = 0, []
            for a, b in own:
                parts.append(text[at:a])
                at = b
            kept.append(b"".join(parts) + text[at:])
        return pa.table(
            {
                "doc_id": ids,
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "n_removed": pa.array([len(t) - len(k) for t, k in zip(texts, kept)], pa.int64()),
                "n_spans": pa.array([len(x) for x in spans], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                "spans": pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], kind),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"
    return repeats.assemble(rows, ranges, finish, schema)

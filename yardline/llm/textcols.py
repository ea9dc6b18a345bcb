"""Words, hashes and minimisers of whole Arrow text columns, in numpy.

A batch of texts is one byte array plus offsets; all functions work on every
text of the batch at once. Batches are cut into slices of a few MB
(:func:`slices`), so memory does not depend on the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: For work whose arrays take many times the text.
SMALL_SLICE = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes that are no part of a word of letters and digits; A-Z count as letters once they are lower-cased.
NO_ALNUM = np.ones(256, bool)
NO_ALNUM[0x80:] = False
NO_ALNUM[ord("0") : ord("9") + 1] = False
NO_ALNUM[ord("a") : ord("z") + 1] = False

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = {}


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(data: np.ndarray, offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of texts of up to ``limit`` bytes, or of one longer text."""
    first, n = 0, len(offs) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        yield first, end, data[offs[first] : offs[end]], offs[first : end + 1] - offs[first]
        first = end


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each text (one more entry at the end)."""
    inside = ~sep[data]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    cut = offs[(offs > 0) & (offs < len(data))]
    before[cut] = False
    after[cut - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, inverse: bool) -> np.ndarray:
    """Powers of an odd base, or of its inverse modulo 2**64."""
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        base = pow(_BASE, -1, 2**64) if inverse else _BASE
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if len(have) <= 4 * SLICE_BYTES:
            _POWERS[inverse] = have
    return have[:n]


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(len(values), False), out=out[1:], dtype=np.uint64)
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = _sums(_BYTE[data])
    return mix((sums[ends] - sums[starts]) * _powers(len(data) + 1, True)[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` values from each position on (``len(values) - k + 1`` of them)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = _sums(values)
    return mix((sums[k:] - sums[:-k]) * _powers(len(values) + 1, True)[:n])


def byte_gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    return gram_hashes(_BYTE[data], k)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` values from each position on."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def minimiser_runs(grams: np.ndarray, firsts: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one least gram.

    ``grams`` are hashes of ``k`` symbols from each position on, ``firsts`` the
    first symbol of each text and one more entry. Each window of ``window``
    symbols of one text is in exactly one run, and equal windows have equal
    keys. Returns the key, the text, the first and last window start of each
    run, and whether its least gram stands there more than once (only then can
    windows of one run be equal).
    """
    width = window - k + 1
    least = sliding_min(grams, width)
    n = len(least)
    none = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, np.uint64), none, none, none, np.zeros(0, bool)
    change = np.zeros(n + 1, bool)
    change[0] = change[n] = True
    change[1:n] = least[1:] != least[:-1]
    whole = np.zeros(n + 1, np.int8)  # starts of windows that lie in one text
    last = firsts[1:] - window
    full = (last >= firsts[:-1]) & (firsts[:-1] < n)
    np.add.at(whole, firsts[:-1][full], 1)
    np.add.at(whole, last[full] + 1, -1)
    change[firsts[:-1][full]] = True
    change[last[full] + 1] = True
    whole = np.cumsum(whole)[:n] > 0
    start = np.flatnonzero(change[:n])
    end = np.append(start[1:], n) - 1
    keep = whole[start]
    start, end = start[keep], end[keep]
    twice = end - start >= width
    spread = np.lib.stride_tricks.sliding_window_view(grams, width)
    for at in range(0, len(start), 4096):
        a, b, name = start[at : at + 4096], end[at : at + 4096], least[start[at : at + 4096], None]
        head, tail = spread[a] == name, spread[b] == name
        one = (head.sum(axis=1) == 1) & (tail.sum(axis=1) == 1) & (a + head.argmax(axis=1) == b + tail.argmax(axis=1))
        twice[at : at + 4096] |= ~one
    return least[start], np.searchsorted(firsts, start, "right") - 1, start, end, twice

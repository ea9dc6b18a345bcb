"""Counts of hashed items over a whole table in an array of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardline.llm import textcols as tc

BITS = 21
_BLOCK = 1 << 14


def bucket(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - BITS)


def _planes(counters: np.ndarray) -> bytes:
    """Counters with their first bytes together, then their second ones: most high bytes are zero and pack well."""
    return counters.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _counters(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def key_bitmap(keys: DataFrame) -> np.ndarray:
    """Which of 2**BITS buckets hold a key of the one column of 64-bit hashes: a filter of fixed size that lets all keys pass."""
    buckets = keys.select(F.shiftrightunsigned(keys.columns[0], 64 - BITS).alias("bucket")).distinct()
    words = buckets.selectExpr("cast(bucket DIV 32 AS int) AS word", "shiftleft(1L, cast(bucket % 32 AS int)) AS bit")
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = words.toArrow()
    bits = np.zeros(1 << (BITS - 5), np.uint32)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool)


def count_sketch(texts: DataFrame, items: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """How many ``items(bytes, offsets)`` of the one text column fall in each of 2**BITS buckets, at most 2**32 - 1.

    Every task sums its own texts and sends blocks of counters; a block's sums
    meet in one row per task. The result (8 MB) goes to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << BITS, np.uint32)
        for batch in batches:
            data, offs = tc.utf8(batch.column(0))
            for _, _, part, part_offs in tc.slices(data, offs, tc.SMALL_SLICE):
                np.add.at(sums, bucket(items(part, part_offs)), np.uint32(1))
        blocks = sums.reshape(-1, _BLOCK)
        full = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([_planes(blocks[i]) for i in full], pa.binary())], ["block", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_BLOCK, np.uint64)
        for x in pdf["counts"]:
            total += _counters(x)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [_planes(np.minimum(total, 2**32 - 1).astype(np.uint32))]})

    sketch = np.zeros(1 << BITS, np.uint32).reshape(-1, _BLOCK)
    schema = "block int, counts binary"
    for row in texts.mapInArrow(count, schema).groupBy("block").applyInPandas(add, schema).collect():
        sketch[row[0]] = _counters(row[1])
    return sketch.ravel()

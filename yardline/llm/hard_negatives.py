"""Hard negatives by Four-Russians scoring.

Vectors are integers. For an anchor and each group of eight dimensions a table
holds the sums of all 256 subsets of its eight numbers. A candidate's numbers
are split into bit planes, and the eight bits of a group in one plane are the
byte that looks the table up; the sums of a plane, shifted by its place, add up
to the exact inner product.

Rows meet in blocks: anchors and candidates of one length are dealt to blocks of
bounded bytes, and each pair of blocks is one task's work. A block keeps the
first rows of each anchor only, so no list of all scores is made. Positives
come first, and then, with their scores known, the negatives of each.

Rows with a null label, a null vector or a null or non-finite number take no
part; rows equal in id, label and vector are one. Rows of one id that differ
are rows of their own. A null id is no anchor and comes last among ties. Only
vectors of one length have a score; empty ones score 0. An empty table gives no
rows, other columns are ignored. Scores that could pass 64 bits are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yardline.llm.storage import partitions, stored

SCALE = 256
ANCHOR_EVERY, SHIFTED_EVERY, LABELS = 100, 7, 10
POSITIVES = NEGATIVES = 5
#: A negative scores at least 80 and at most 100 hundredths of the positive.
LEAST_SHARE, MOST_SHARE = 80, 100
TABLE_BYTES, BLOCK_BYTES, STRIP = 1 << 26, 1 << 25, 2048
_LAST = np.iinfo(np.int64).max


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Tables (groups of eight dimensions x 256 x anchors) of the sums of all subsets of a group's numbers."""
    count, dims = anchors.shape
    groups = -(-dims // 8)
    padded = np.zeros((count, 8 * groups), anchors.dtype)
    padded[:, :dims] = anchors
    tables = np.zeros((groups, 256, count), anchors.dtype)
    for bit in range(8):
        tables[:, 1 << bit : 2 << bit] = tables[:, : 1 << bit] + padded[:, bit::8].T[:, None]
    return tables


def bit_planes(vectors: np.ndarray) -> tuple[int, np.ndarray]:
    """The least number, and what exceeds it as packed bytes (planes x groups x vectors)."""
    if not vectors.size:
        return 0, np.zeros((0, 0, len(vectors)), np.uint8)
    least = int(vectors.min())
    above = vectors - least
    planes = int(above.max()).bit_length()
    packed = [np.packbits((above >> p & 1).astype(np.uint8), axis=1, bitorder="little").T for p in range(planes)]
    return least, np.stack(packed) if packed else np.zeros((0, 0, len(vectors)), np.uint8)


def scores(tables: np.ndarray, totals: np.ndarray, least: int, planes: np.ndarray) -> np.ndarray:
    """Inner products (vectors x anchors); ``totals`` are the sums of each anchor's numbers."""
    out = np.empty((planes.shape[2], len(totals)), totals.dtype)
    out[:] = least * totals
    looked, plane = np.empty_like(out), np.empty_like(out)
    for p, groups in enumerate(planes):
        plane[:] = 0
        for table, byte in zip(tables, groups):
            plane += np.take(table, byte, axis=0, out=looked, mode="clip")
        out += plane << p
    return out


def _vectors(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = [np.asarray(c.flatten(), np.int64) for c in column.chunks]
    return np.concatenate(flat).reshape(-1, dims) if flat and dims else np.zeros((len(column), dims), np.int64)


def _strips(candidates: pa.Table, anchors: pa.Table, dims: int):
    """Ids, labels and row numbers of strips of candidates, by id, and their scores (candidates x anchors)."""
    ids = candidates["vec_id"].fill_null(_LAST).to_numpy()
    order = np.lexsort([ids, candidates["vec_id"].is_null().to_numpy()])
    ids, null = ids[order], candidates["vec_id"].is_null().to_numpy()[order]
    labels, rows = candidates["label"].to_numpy()[order], candidates["row"].to_numpy()[order]
    numbers, mine = _vectors(candidates["q"], dims)[order], _vectors(anchors["q"], dims)
    bound = dims * max(1, int(np.abs(mine).max(initial=0))) * 2 * max(1, int(np.abs(numbers).max(initial=0)))
    if bound * MOST_SHARE >= _LAST:
        raise ValueError("scores of these vectors could pass 64 bits")
    mine = mine.astype(np.int32 if bound < 1 << 30 else np.int64)
    tables, totals = subset_sums(mine), mine.sum(axis=1, dtype=mine.dtype)
    for at in range(0, len(ids), STRIP):
        s = slice(at, at + STRIP)
        yield ids[s], null[s], labels[s], rows[s], scores(tables, totals, *bit_planes(numbers[s]))


def _first(found: list[tuple[int, bool, int]], k: int) -> list[tuple[int, bool, int]]:
    return sorted(found)[:k]


def _table(found: dict[tuple, list[tuple[int, bool, int]]], names: list[str]) -> pa.Table:
    flat = [(*key, None if null else i, -s) for key, own in found.items() for s, null, i in own]
    columns = list(zip(*flat)) if flat else [[] for _ in names]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _positives(key: tuple, candidates: pa.Table, anchors: pa.Table) -> pa.Table:
    """The first rows of the label of each anchor in this block of candidates."""
    names = anchors["row"].to_pylist()
    found: dict[tuple, list] = {(r,): [] for r in names}
    if candidates.num_rows and anchors.num_rows:
        labels = anchors["label"].to_numpy()
        for ids, null, label, rows, score in _strips(candidates, anchors, key[0].as_py()):
            for a, name in enumerate(names):
                own = np.flatnonzero((label == labels[a]) & (rows != name))
                best = own[np.argsort(-score[own, a].astype(np.int64), kind="stable")[:POSITIVES]]
                got = zip((-score[best, a].astype(np.int64)).tolist(), null[best].tolist(), ids[best].tolist())
                found[(name,)] = _first(found[(name,)] + list(got), POSITIVES)
    return _table(found, ["row", "id", "score"])


def _negatives(key: tuple, candidates: pa.Table, anchors: pa.Table) -> pa.Table:
    """The first rows of other labels within the bounds of each positive of each anchor in this block of candidates."""
    names = anchors["row"].to_pylist()
    wanted = [[x["score"] for x in own] for own in anchors["positives"].to_pylist()]
    found: dict[tuple, list] = {(r, k): [] for r, own in zip(names, wanted) for k in range(len(own))}
    if candidates.num_rows and anchors.num_rows:
        labels = anchors["label"].to_numpy()
        for ids, null, label, rows, score in _strips(candidates, anchors, key[0].as_py()):
            for a, name in enumerate(names):
                s = score[:, a].astype(np.int64)
                own = np.flatnonzero((label != labels[a]) & (s <= max(wanted[a])) & (MOST_SHARE * s >= LEAST_SHARE * min(wanted[a])))
                own = own[np.argsort(-s[own], kind="stable")]
                for k, positive in enumerate(wanted[a]):
                    fits = own[(s[own] <= positive) & (MOST_SHARE * s[own] >= LEAST_SHARE * positive)][:NEGATIVES]
                    got = zip((-s[fits]).tolist(), null[fits].tolist(), ids[fits].tolist())
                    found[(name, k)] = _first(found[(name, k)] + list(got), NEGATIVES)
    return _table(found, ["row", "positive", "id", "score"])


def _rows(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, q, dims, row`` of the rows that take part, stored."""
    whole = lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    sound = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    own, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    shifted = F.when(own % SHIFTED_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    rows = sound.select(own.alias("vec_id"), shifted.alias("label"), F.transform("embedding", whole).alias("q")).distinct()
    return stored(rows.select("*", F.size("q").alias("dims"), F.monotonically_increasing_id().alias("row")))


def _anchor() -> Column:
    return F.col("vec_id") % ANCHOR_EVERY == 0


def mine(vectors: DataFrame) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vectors`` (``vec_id, embedding, label``)."""
    rows = _rows(vectors)
    wide = F.greatest(F.col("dims"), F.lit(1))
    held, own = F.col("held"), F.col("anchors")
    least_blocks = F.least(F.lit(2 * partitions(vectors.sparkSession)), F.ceil(held / 256))
    sizes = rows.groupBy("dims").agg(F.count("*").alias("held"), F.count_if(_anchor()).alias("anchors")).where("anchors > 0")
    sizes = sizes.select(
        "dims",
        F.ceil(own / F.greatest(F.lit(1), F.floor(TABLE_BYTES / (256 * wide)))).cast("int").alias("anchor_blocks"),
        F.greatest(F.ceil(held * wide * 8 / BLOCK_BYTES), least_blocks).cast("int").alias("blocks"),
    )
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    candidates = rows.join(sizes, "dims").select("dims", every("anchor_blocks").alias("i"), dealt("blocks").alias("j"), "row", "vec_id", "label", "q")
    anchors = rows.where(_anchor()).join(sizes, "dims")

    def searched(asked: DataFrame, find, schema: str, *extra: str) -> DataFrame:
        carried = (F.col(c).alias(c) for c in ("dims", "row", "label", "q", *extra))  # new names: both sides come from one table
        sent = asked.select(*carried, dealt("anchor_blocks").alias("i"), every("blocks").alias("j"))
        pairs = candidates.groupBy("dims", "i", "j").cogroup(sent.groupBy("dims", "i", "j"))
        return pairs.applyInArrow(find, schema)

    order = [F.desc("score"), F.asc_nulls_last("id")]
    found = searched(anchors, _positives, "row long, id long, score long")
    place = F.row_number().over(Window.partitionBy("row").orderBy(*order))
    first = found.withColumn("place", place).where(F.col("place") <= POSITIVES)
    listed = stored(first.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("positives")))

    found = searched(anchors.join(listed, "row"), _negatives, "row long, positive long, id long, score long", "positives")
    rank = F.row_number().over(Window.partitionBy("row", "positive").orderBy(*order))
    negatives = found.withColumn("rank", rank).where(F.col("rank") <= NEGATIVES)
    of = F.element_at("positives", (F.col("positive") + 1).cast("int"))
    return negatives.join(anchors.select("row", "vec_id").join(listed, "row"), "row").select(
        F.col("vec_id").alias("anchor_id"),
        of["id"].alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        of["score"].alias("positive_score"),
        F.col("score").alias("negative_score"),
    )

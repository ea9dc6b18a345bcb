"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation of the principal axes, learned on a bounded sample, makes balanced
binary codes. Codes are cut into ``TABLES`` chunks, each with a table of its
own; a vector is looked up under its chunk and all chunks one bit away. So all
pairs with up to ``2 * TABLES - 1`` differing bits meet, and most with a few
more. Pairs near enough by code are reranked by the cosine of the vectors.

Vectors of one length only can link. Each length with more than ``EXACT``
distinct vectors has a model of its own; those of a rarer length are compared
in one block. Equal vectors are one row with a count. In a table each row first meets one
leader per key; then only rows in different components meet. The links inside
a component are counted from products of blocks of its vectors, so no list of
all its pairs is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardline.llm.components import components
from yardline.llm.storage import partitions, stored

COSINE = 0.9
BITS = 64
TABLES = 4
#: Pairs with more differing bits are not reranked; at the least cosine about 9 of 64 are expected.
REACH = 20
#: Rows, and numbers in all, that the rotation is learned from.
SAMPLE_ROWS, SAMPLE_NUMBERS = 20_000, 1 << 22
ROUNDS = 30
BLOCK = 512
#: Distinct vectors of one length up to which they are compared without codes.
EXACT = 1024


def _matrix(column: pa.Array) -> np.ndarray:
    values = np.asarray(column.flatten(), np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _units(vectors: DataFrame) -> DataFrame:
    """``vec_id, raw, unit`` of the vectors that can link: finite, not null and not zero."""
    raw = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    sound = vectors.where("embedding IS NOT NULL AND size(embedding) > 0").select("vec_id", raw.alias("raw"))
    bad = F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda acc, x: acc + x * x))
    most = F.aggregate("raw", F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x)))
    sound = sound.where(~bad).withColumn("most", most).where("most > 0")
    scaled = sound.withColumn("unit", F.transform("raw", lambda x: x / F.col("most"))).drop("most")
    norm = F.sqrt(F.aggregate("unit", F.lit(0.0), lambda acc, x: acc + x * x))
    return scaled.withColumn("norm", norm).withColumn("unit", F.transform("unit", lambda x: x / F.col("norm"))).drop("norm")


def fit(sample: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotated axes: principal axes first, then rotations towards the corners of the cube, by turns."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    values, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, np.argsort(values)[::-1][: min(bits, sample.shape[1])]]
    projected = centred @ axes
    rotation, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((axes.shape[1],) * 2))
    for _ in range(ROUNDS):
        corners = np.where(projected @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(projected.T @ corners)
        rotation = left @ right
    return mean, axes @ rotation


def encode(unit: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    mean, axes = model
    bits = ((unit - mean) @ axes >= 0).astype(np.uint64)
    return (bits << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def _verified(pairs: DataFrame, rows: DataFrame, cosine: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose vectors reach the cosine."""

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                near = np.einsum("ij,ij->i", _matrix(part.column(2)), _matrix(part.column(3))) >= cosine
                yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(near)) for i in (0, 1)], ["a", "b"])

    left = rows.select(F.col("id").alias("a"), F.col("unit").alias("unit_a"))
    right = rows.select(F.col("id").alias("b"), F.col("unit").alias("unit_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "unit_a", "unit_b")
    return stored(both.mapInArrow(rerank, "a long, b long"))


def _counts(rows: DataFrame, cosine: float) -> DataFrame:
    """``id, n_links`` of rows (``id, part, copies, unit``) in components of two and more, from block products."""
    sizes = rows.groupBy("part").agg(F.count("*").alias("held")).where("held > 1")
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    own = rows.join(sizes, "part").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    small = F.col("blocks") == 1
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = own.select("*", other).select(
        "id",
        "part",
        "block",
        "copies",
        "unit",
        F.when(small, F.pmod(F.xxhash64("part"), F.lit(8 * partitions(rows.sparkSession)))).otherwise(F.col("part").cast("long")).alias("group"),
        F.when(small, -1).otherwise(F.least("block", "other")).alias("i"),
        F.when(small, -1).otherwise(F.greatest("block", "other")).alias("j"),
    )

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.groupby("part", sort=False):
            i, j = own["i"].iloc[0], own["j"].iloc[0]
            left = own if i == j else own[own["block"] == i]
            right = own if i == j else own[own["block"] == j]
            if not len(left) or not len(right):
                continue
            near = np.stack(left["unit"].to_list()) @ np.stack(right["unit"].to_list()).T >= cosine
            if i == j:
                np.fill_diagonal(near, False)
            out.append(pd.DataFrame({"id": left["id"].to_numpy(), "n": near @ right["copies"].to_numpy()}))
            if i != j:
                out.append(pd.DataFrame({"id": right["id"].to_numpy(), "n": left["copies"].to_numpy() @ near}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "n": []})

    counted = dealt.groupBy("group", "i", "j").applyInPandas(count, "id long, n long")
    return counted.groupBy("id").agg(F.sum("n").alias("n_links"))


def _block_links(classes: DataFrame, cosine: float) -> DataFrame:
    """``id, n, part`` of all rows of ``classes`` (``id, dims, copies, unit``), one block per length: links counted, linked rows in one part."""

    def block(table: pa.Table) -> pa.Table:
        unit = np.concatenate([_matrix(c) for c in table["unit"].chunks])
        ids, copies = table["id"].to_numpy(), table["copies"].to_numpy()
        near = unit @ unit.T >= cosine
        np.fill_diagonal(near, False)
        part = np.arange(len(ids))
        while True:  # the least place among a row's links and its own, until nothing moves
            least = np.minimum(part, np.where(near, part, len(ids)).min(axis=1))
            least = least[least]
            if (least == part).all():
                break
            part = least
        columns = [pa.array(ids), pa.array(near @ copies, pa.int64()), pa.array(ids[part])]
        return pa.Table.from_arrays(columns, ["id", "n", "part"])

    return classes.select("id", "dims", "copies", "unit").groupBy("dims").applyInArrow(block, "id long, n long, part long")


def _coded_links(classes: DataFrame, dims: int, held: int, cosine: float) -> DataFrame:
    """``id, n, part`` of the rows of ``classes`` (``id, copies, unit``) of one length: links to other classes and the part they join, by codes and rerank."""
    spark = classes.sparkSession
    share = min(SAMPLE_ROWS, SAMPLE_NUMBERS // dims) / held
    place = F.pmod(F.xxhash64(F.lit("rotation"), "unit"), F.lit(1 << 30)) / float(1 << 30)
    sample = classes.where(place <= share).select("unit").toArrow()["unit"].combine_chunks()
    if isinstance(sample, pa.ChunkedArray):
        sample = pa.concat_arrays(sample.chunks) if sample.num_chunks else pa.array([], pa.list_(pa.float64()))
    model = fit(_matrix(sample)) if len(sample) else (np.zeros(dims), np.eye(dims)[:, :BITS])
    sent = spark.sparkContext.broadcast(model)
    bits = min(BITS, dims)
    width = -(-bits // TABLES)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = encode(_matrix(batch.column(2)), sent.value) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], ["id", "copies", "unit", "code"])

    rows = stored(classes.select("id", "copies", "unit").mapInArrow(codes, "id long, copies long, unit array<double>, code long"))

    chunk = lambda t: F.shiftrightunsigned("code", t * width).bitwiseAND((1 << width) - 1)
    tables = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), chunk(t).alias("key")) for t in range(-(-bits // width)))))
    held = rows.select("id", "code", tables.alias("c")).select("id", "code", "c.t", "c.key")
    flips = F.explode(F.array(F.lit(0).cast("long"), *(F.lit(1 << b).cast("long") for b in range(width))))
    asked = held.select("id", "code", "t", "key", flips.alias("flip")).select("id", "code", "t", F.col("key").bitwiseXOR(F.col("flip")).alias("key"))
    differ = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= REACH
    ordered = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))

    leaders = held.groupBy("t", "key").agg(F.min("id").alias("leader"), F.min_by("code", "id").alias("leader_code"))
    star = asked.join(leaders, ["t", "key"]).where((F.col("id") != F.col("leader")) & differ("code", "leader_code"))
    pairs = stored(star.select(*ordered("id", "leader")).distinct())
    links = _verified(pairs, rows, cosine)
    joined = components(links)

    part = F.coalesce("component_id", "own").alias("part")
    parts = rows.select(F.col("id").alias("own"), "code").join(joined, F.col("own") == F.col("id"), "left").select(F.col("own").alias("id"), "code", part)
    held = stored(parts.select("id", "code", "part", tables.alias("c")).select("id", "code", "part", "c.t", "c.key"))
    main = held.groupBy("t", "key", "part").agg(F.count("*").alias("n")).groupBy("t", "key").agg(F.max_by("part", "n").alias("main"))
    asked = held.select("id", "code", "part", "t", "key", flips.alias("flip")).withColumn("key", F.col("key").bitwiseXOR(F.col("flip"))).drop("flip")
    asked, held = asked.join(main, ["t", "key"]), held.join(main, ["t", "key"])
    y = lambda df: df.select("t", "key", F.col("id").alias("id2"), F.col("code").alias("code2"), F.col("part").alias("part2"))
    minor = asked.where("part <> main").join(y(held), ["t", "key"])
    major = asked.where("part = main").join(y(held.where("part <> main")), ["t", "key"])
    apart = [df.where((F.col("part") != F.col("part2")) & differ("code", "code2")).select(*ordered("id", "id2")) for df in (minor, major)]
    more = stored(apart[0].union(apart[1]).distinct().join(pairs, ["a", "b"], "left_anti"))
    joined = components(links.union(_verified(more, rows, cosine)))

    grouped = rows.select("id", "copies", "unit").join(joined.withColumnRenamed("id", "own"), F.col("id") == F.col("own")).select("id", F.col("component_id").alias("part"), "copies", "unit")
    counts = _counts(grouped, cosine)
    return grouped.select("id", "part").join(counts, "id", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n"), "part")


def link(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors`` (``vec_id, embedding``).

    Vectors that are null, empty, zero, or hold null or non-finite numbers link
    with nothing, nor do vectors of different lengths. Rows equal in ``vec_id``
    (an integer) and vector are one vector, rows of one id with different
    vectors are vectors of their own; each row is returned. An empty table
    gives no rows; other columns are ignored.
    """
    units = _units(vectors)
    distinct = units.select("vec_id", "raw", "unit").dropDuplicates(["vec_id", "raw"])
    classes = distinct.groupBy("raw").agg(F.min("vec_id").cast("long").alias("least"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("id"), F.size("raw").alias("dims"), "least", "copies", "raw", "unit"))
    sizes = classes.groupBy("dims").agg(F.count("*").alias("held"))
    common = sizes.where(F.col("held") > EXACT).orderBy("dims").collect()
    found = _block_links(classes.where(~F.col("dims").isin([r["dims"] for r in common])), cosine)
    for r in common:
        found = found.union(_coded_links(classes.where(F.col("dims") == r["dims"]), r["dims"], r["held"], cosine))
    numbered = stored(classes.select("id", "least", "copies", "raw").join(found.withColumnRenamed("id", "own"), F.col("id") == F.col("own"), "left").select("id", "least", "copies", "raw", F.coalesce("part", "id").alias("part"), F.coalesce("n", F.lit(0)).alias("n")))
    named = numbered.groupBy("part").agg(F.min("least").alias("component"))
    result = numbered.join(named, "part").select("raw", (F.col("n") + F.col("copies") - 1).alias("n"), "component")
    same = F.transform(F.col("embedding"), lambda x: x.cast("double")).alias("raw")
    told = vectors.select("vec_id", same).join(result, "raw", "left").withColumn("component", F.coalesce("component", "vec_id"))
    return told.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.col("component").cast("long").alias("component_id"),
        F.col("component").eqNullSafe(F.col("vec_id")).alias("kept"),
    )

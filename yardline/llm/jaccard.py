"""N-gram Jaccard join as a blocked sparse product of the document x n-gram matrix.

Rows of the incidence matrix are distinct shingle sets (documents with equal
sets are one row); their product with themselves has the overlaps. Bounds from
the sizes leave little of it to compute. Two sets at the threshold share one of
each one's ``n - ceil(t n) + 1`` rarest columns, so only those columns say which
pairs are looked at. The overlap of a pair is then summed over blocks of columns, and
the pair is dropped as soon as what is left cannot reach the bound.

No column emits all its pairs. First each row of a column meets one row, its
leader. Links found so join most copies; after that only rows of a column in
different components still meet: in short columns by a join, in full ones as
products of blocks of rows. Rare first means by a count sketch of fixed
size over all documents, which any number of documents can share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardline.llm import textcols as tc
from yardline.llm.components import components
from yardline.llm.sketch import bucket, count_sketch, key_bitmap
from yardline.llm.storage import stored

WORDS = 3
#: Threshold in hundredths: link when 100 * intersection >= PERCENT * union.
PERCENT = 90
COLUMN_BLOCKS = 4
#: Columns of more rows are multiplied in blocks of so many rows.
FULL, BLOCK = 64, 512


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; a text of fewer words has one, without words none."""
    data = tc.LOWER[data]
    starts, ends, firsts = tc.words(data, offs, tc.SPACE)
    hashes = tc.word_hashes(data, starts, ends)
    grams = tc.gram_hashes(hashes, words)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if b - a >= words:
            own = np.sort(grams[a : b - words + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            out.append(tc.mix(tc.gram_hashes(hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc, n, h1, h2, prefix, rare`` per document: set size, a 128-bit name of the set, its rarest columns and the count of the rarest."""
    held = lambda data, offs: np.concatenate([np.zeros(0, np.uint64), *shingle_sets(data, offs, words)])
    sent = docs.sparkSession.sparkContext.broadcast(count_sketch(docs.select("text"), held))
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = sent.value
        for batch in batches:
            data, offs = tc.utf8(batch.column(1))
            for first, end, part, part_offs in tc.slices(data, offs, tc.SMALL_SLICE):
                n, h1, h2, prefixes, rare = [], [], [], [], []
                for own in shingle_sets(part, part_offs, words):
                    n.append(len(own))
                    place = np.arange(len(own), dtype=np.uint64)
                    h1.append(int(tc.mix(own + place).sum().view(np.int64)) if len(own) else 0)
                    h2.append(int(tc.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)) if len(own) else 0)
                    keep = len(own) + (-percent * len(own) // 100) + 1 if len(own) else 0
                    counts = sketch[bucket(own)].astype(np.uint64)
                    order = np.lexsort([own, counts])[:keep]
                    prefixes.append(own[order].view(np.int64))
                    rare.append(int(counts[order[0]]) if keep else 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.array(n, pa.int64()),
                        pa.array(h1, pa.int64()),
                        pa.array(h2, pa.int64()),
                        pa.array(prefixes, pa.list_(pa.int64())),
                        pa.array(rare, pa.int64()),
                    ],
                    ["doc", "n", "h1", "h2", "prefix", "rare"],
                )

    return stored(docs.select("doc_id", "text").mapInArrow(scan, f"doc {doc_type}, n long, h1 long, h2 long, prefix array<long>, rare long"))


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``doc, grams`` of the documents named by ``ids`` (``doc``)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(sent.value[bucket(batch.column(2).to_numpy().view(np.uint64))]))
            data, offs = tc.utf8(batch.column(1))
            for first, end, part, part_offs in tc.slices(data, offs, tc.SMALL_SLICE):
                sets = [s.view(np.int64) for s in shingle_sets(part, part_offs, words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(sets, pa.list_(pa.int64()))], ["doc", "grams"])

    # A bitmap of fixed size keeps texts that nobody asks for out of the shuffle; the join drops its false hits.
    name = F.xxhash64("doc_id").alias("name")
    sent = docs.sparkSession.sparkContext.broadcast(key_bitmap(ids.select(F.xxhash64("doc").alias("name"))))
    schema = f"doc {docs.schema['doc_id'].dataType.simpleString()}, grams array<long>"
    made = docs.where("doc_id IS NOT NULL").select("doc_id", "text", name).mapInArrow(scan, schema)
    return stored(made.join(ids, "doc", "left_semi").dropDuplicates(["doc"]))


def overlaps(left: pa.ListArray, right: pa.ListArray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row by row the overlap of two sets, summed over blocks of columns; and whether the pair reached the bound.

    After each block a pair whose overlap and what is left of the smaller side cannot reach the bound is dropped.
    """
    sides = []
    for column in (left, right):
        offs = np.asarray(column.offsets)
        values = np.asarray(column.values)[offs[0] : offs[-1]].view(np.uint64)
        sizes = np.diff(offs).astype(np.int64)
        sides.append((values, np.repeat(np.arange(len(sizes)), sizes), sizes))
    (a, row_a, n_a), (b, row_b, n_b) = sides
    alive = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    overlap, left_a, left_b = np.zeros(len(n_a), np.int64), n_a.copy(), n_b.copy()
    shift = np.uint64(64 - COLUMN_BLOCKS.bit_length() + 1)
    for block in range(COLUMN_BLOCKS):
        in_a, in_b = (a >> shift == block) & alive[row_a], (b >> shift == block) & alive[row_b]
        own_a, own_b = row_a[in_a], row_b[in_b]
        key_a, key_b = a[in_a] ^ tc.mix(own_a.astype(np.uint64)), b[in_b] ^ tc.mix(own_b.astype(np.uint64))
        overlap += np.bincount(own_a[np.isin(key_a, key_b)], minlength=len(n_a))
        left_a -= np.bincount(own_a, minlength=len(n_a))
        left_b -= np.bincount(own_b, minlength=len(n_a))
        alive &= (100 + percent) * (overlap + np.minimum(left_a, left_b)) >= percent * (n_a + n_b)
    return overlap, alive


def _links(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (``a, b``) that reach the threshold."""
    ids = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    sets = _sets(docs, ids, words)
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                _, alive = overlaps(part.column(2), part.column(3), percent)
                keep = pa.array(alive)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])

    left = sets.select(F.col("doc").alias("a"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("doc").alias("b"), F.col("grams").alias("grams_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "grams_a", "grams_b")
    return stored(both.mapInArrow(product, f"a {doc_type}, b {doc_type}"))


def _sizes_fit(n, m, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _promising(met: DataFrame, x: str, y: str, n, m, percent: int) -> DataFrame:
    """Pairs (``a``, ``b``) of rows of one column each that share enough of their rarest columns.

    The rarest columns of the one whose list ends first are all decided, so the
    overlap is at most those shared and the rest of that set.
    """
    counted = met.where(_sizes_fit(n, m, percent)).groupBy(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    counted = counted.agg(F.count("*").alias("shared"), F.max(F.least(n, m)).alias("less"), F.max(F.greatest(n, m)).alias("more"))
    rest = F.ceil(percent * F.col("more") / 100) - 1
    return counted.where((100 + percent) * (F.col("shared") + rest) >= percent * (F.col("less") + F.col("more"))).select("a", "b")


def _products(rows: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Promising pairs (``a``, ``b``) in different parts of one column, from products of blocks of its rows.

    Rows outside the column's main part meet all its rows, ``BLOCK`` by
    ``BLOCK``. The product of the two blocks' rare columns, summed over slices
    of columns, has the shared ones of all pairs; only promising pairs go on.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    across = F.ceil(F.col("held") / BLOCK).cast("int")
    down = F.ceil((F.col("held") - F.col("most")) / BLOCK).cast("int")
    place = lambda blocks: F.pmod(F.xxhash64("doc"), blocks).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))
    minor = rows.where("part <> main").withColumn("i", place(down)).withColumn("j", each(across)).withColumn("minor", F.lit(True))
    every = rows.withColumn("j", place(across)).withColumn("i", each(down)).withColumn("minor", F.lit(False))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["minor"]], pdf[~pdf["minor"]]
        out = pd.DataFrame({"a": [], "b": []})
        if x.empty or y.empty:
            return out
        sides = [(np.concatenate(s["prefix"].to_list()), np.repeat(np.arange(len(s)), s["prefix"].map(len))) for s in (x, y)]
        common = np.intersect1d(sides[0][0], sides[1][0])
        shared = np.zeros((len(x), len(y)), np.float32)
        for at in range(0, len(common), 4096):
            columns = common[at : at + 4096]
            blocks = []
            for (grams, row), n in zip(sides, shared.shape):
                spot = np.minimum(np.searchsorted(columns, grams), len(columns) - 1)
                held = columns[spot] == grams
                block = np.zeros((n, len(columns)), np.float32)
                block[row[held], spot[held]] = 1
                blocks.append(block)
            shared += blocks[0] @ blocks[1].T
        n, m = x["n"].to_numpy()[:, None], y["n"].to_numpy()[None, :]
        less, more = np.minimum(n, m), np.maximum(n, m)
        keep = (100 * less >= percent * more) & ((100 + percent) * (shared - (-percent * more // 100) - 1) >= percent * (n + m))
        keep &= x["part"].to_numpy()[:, None] != y["part"].to_numpy()[None, :]
        i, j = np.nonzero(keep)
        a, b = x["doc"].to_numpy()[i], y["doc"].to_numpy()[j]
        return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)}).drop_duplicates()

    columns = ["gram", "i", "j", "minor", "doc", "n", "part", "prefix"]
    both = minor.select(columns).unionByName(every.select(columns))
    return both.groupBy("gram", "i", "j").applyInPandas(product, f"a {id_type}, b {id_type}")


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs`` (``doc_id, text``).

    The component's id is the least ``doc_id`` that links reach. Texts that are
    null or without words link with nothing. ``doc_id`` names a document;
    repeated rows give repeated rows, and rows of one id with different texts
    are one document, with the links of any of its texts. A text is one set however
    long it is; an empty table gives no rows. Other columns are ignored.
    """
    rows = _rows(docs, words, percent)
    full = rows.where("n > 0")
    classes = stored(full.groupBy("h1", "h2").agg(F.min("doc").alias("class")))
    one_each = full.join(classes, (F.col("doc") == F.col("class")) & (full["h1"] == classes["h1"]) & (full["h2"] == classes["h2"]), "left_semi")
    # A set of k elements can differ from its like at the threshold only if a set one smaller reaches it.
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 30
    entries = one_each.where(F.col("n") >= least).dropDuplicates(["doc"]).select("doc", "n", "rare", F.posexplode("prefix").alias("place", "gram"))
    leader = (F.max_by("doc", "rare").alias("leader"), F.max_by("n", "rare").alias("leader_n"), F.count("*").alias("held"))
    leaders = entries.groupBy("gram").agg(*leader).where("held > 1").drop("held")
    met = stored(entries.drop("rare").join(leaders, "gram"))
    # The leader of a pair's other columns may differ, so this leaves some pairs to the second round.
    pairs = stored(_promising(met.where("doc <> leader"), "doc", "leader", F.col("n"), F.col("leader_n"), percent))
    links = _links(docs, pairs, words, percent)
    joined = components(links)

    # Pairs of a column that are still apart.
    labelled = met.join(joined, met["doc"] == joined["id"], "left").select("gram", "doc", "n", "place", F.coalesce("component_id", "doc").alias("part"))
    sizes = labelled.groupBy("gram", "part").agg(F.count("*").alias("held"))
    main = (F.max_by("part", "held").alias("main"), F.count("*").alias("parts"), F.sum("held").alias("held"), F.max("held").alias("most"))
    mixed = sizes.groupBy("gram").agg(*main).where("parts > 1").drop("parts")
    every = stored(labelled.join(mixed, "gram"))
    # Pairs that meet in a full column are counted there; for the others the few rows of their columns join.
    full_columns = _products(every.where(F.col("held") > FULL).join(one_each.select("doc", "prefix"), "doc"), docs, percent)
    apart = every.where(F.col("held") <= FULL)
    x, y = apart.where("part <> main").alias("x"), apart.alias("y")
    meet = (
        (F.col("x.gram") == F.col("y.gram"))
        & (F.col("x.part") != F.col("y.part"))
        & ((F.col("y.part") == F.col("y.main")) | (F.col("x.doc") < F.col("y.doc")))
        & _sizes_fit(F.col("x.n"), F.col("y.n"), percent)
        # At any shared column: what both can share before it, it, and what both can share after it.
        & ((100 + percent) * (F.least("x.place", "y.place") + F.least(F.expr("x.n - x.place"), F.expr("y.n - y.place"))) >= percent * F.expr("x.n + y.n"))
    )
    rest = _promising(x.join(y, meet), "x.doc", "y.doc", F.col("x.n"), F.col("y.n"), percent).union(full_columns).distinct()
    more = _links(docs, stored(rest.join(pairs, ["a", "b"], "left_anti")), words, percent)
    joined = components(links.union(more))

    named = rows.join(classes, ["h1", "h2"], "left").withColumn("class", F.when(F.col("n") > 0, F.col("class")).otherwise(F.col("doc")))
    return named.join(joined, named["class"] == joined["id"], "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "class").alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the least id, with all its columns; of repeated rows one stays.

    Rows without an id take no part and stay.
    """
    named = docs.where("doc_id IS NOT NULL")
    gone = join(named).where("doc_id <> component_id").select("doc_id").distinct()
    kept = named.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    once = kept.join(again, "doc_id", "left_anti").select(docs.columns)
    first = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return once.unionByName(first).unionByName(docs.where("doc_id IS NULL"))

"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in Spark; scoring sends the matrix of log
probabilities (languages x buckets, a few MB) to all tasks and adds its rows
up over the n-grams of each whole text in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardline.llm import textcols as tc

ORDERS = (1, 2, 3)
BUCKET_BITS = 14
SMOOTHING = 0.5
#: About so many training texts of each language are used, chosen by a hash of the id.
SAMPLE = 4000
#: Languages that are scored at once.
AT_ONCE = 64
UNKNOWN = "und"

_SLICE = 1 << 20


def _grams(texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Characters per text, and for each order the bucket of the n-gram from each character on and whether it lies in one text.

    Texts are lower-cased; runs of other ASCII characters than letters count as blanks.
    """
    texts = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.where((chars < 0x80) & ~((chars >= ord("a")) & (chars <= ord("z"))), np.uint32(0x20), chars)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))
    out, code = [], np.zeros(len(chars), np.uint32)
    for k in range(1, max(ORDERS) + 1):
        n = len(chars) - k + 1
        if n <= 0:
            break
        code = (code[:n] ^ chars[k - 1 :]) * np.uint32(0x9E3779B1) + np.uint32(k)
        if k in ORDERS:
            mixed = code ^ (code >> np.uint32(15))
            out.append(((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS), left[:n] >= k))
    return sizes, out


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text[64:]))


def train(docs: DataFrame, languages: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities of buckets (rows) by language.

    Rows without text or language teach nothing; without any, there are no languages.
    """
    known = docs.where(F.col("text").isNotNull() & F.col(languages).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(languages).count().collect()}
    names = sorted(counts)
    if not names:
        return [], np.zeros((1 << BUCKET_BITS, 0), np.float32)
    place = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    shares = docs.sparkSession.createDataFrame([(n, min(1.0, SAMPLE / counts[n])) for n in names], "_lang string, _share double")
    sample = known.join(F.broadcast(shares), F.col(languages) == F.col("_lang")).where(place < F.col("_share")).select(F.col("_lang").alias("lang"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                lang = batch.column(0)[i].as_py()
                own = sums.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                for bucket, _ in _grams([batch.column(1)[i].as_py()])[1]:
                    own += np.bincount(bucket, minlength=len(own))
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["lang", "bucket", "n"])

    table = np.zeros((1 << BUCKET_BITS, len(names)))
    where = {n: i for i, n in enumerate(names)}
    summed = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table[summed["bucket"].to_numpy(), [where[x] for x in summed["lang"].to_pylist()]] = summed["n"].to_numpy()
    table += SMOOTHING
    return names, np.log(table / table.sum(axis=0)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``doc_id, lang_pred, score`` per row of ``docs``; the score is the probability of the language.

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned. Ties go to the first language by name. Whole texts count, however
    long; repeated rows each give a row, an empty table none; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = sent.value
        for batch in batches:
            _, offs = tc.utf8(batch.column(1))
            for first, end, _, _ in tc.slices(offs, offs, _SLICE):
                texts = [t or "" for t in batch.column(1).slice(first, end - first).to_pylist()]
                known = np.array([_has_letter(t) for t in texts]) & bool(names)
                total = np.zeros((len(texts), max(1, len(names))))
                sizes, grams = _grams(texts)
                full = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[full]
                for some in range(0, len(names), AT_ONCE):
                    of = slice(some, some + AT_ONCE)
                    for bucket, whole in grams:
                        rows = logs[bucket, of]
                        rows[~whole] = 0
                        own = starts < len(rows)
                        total[full[own], of] += np.add.reduceat(rows, starts[own], axis=0, dtype=np.float64)
                best = total.argmax(axis=1)
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                score = np.where(known, 1 / odds.sum(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.array([names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())], pa.string()),
                        pa.array(score, pa.float64()),
                    ],
                    ["doc_id", "lang_pred", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(scan, schema)

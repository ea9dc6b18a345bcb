"""A training corpus from documents: toxic ones out, near copies out, benchmark text out, personal data masked, sources mixed.

Each stage takes (spark, documents, table folder) and is written before the
next one reads it. Nulls in any column, empty and very long texts, empty tables and further columns pass
through; of repeated rows see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardline.llm import decontamination, jaccard, mixing, pii, toxicity
from yardline.llm.storage import remove, stored_at, work_tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; the model learns from the labelled ones among them. Repeated rows all stay or go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group linked by shared n-grams; of repeated rows one."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark text to speak of. Repeated rows all stay or go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with identifiers replaced by the name of their kind and ``n_chars`` counted anew where a text changed."""
    found = pii.detect(docs.select("text", F.struct("*").alias("_doc")))
    size = F.length("masked_text").cast(docs.schema["n_chars"].dataType)
    new = {"text": F.col("masked_text"), "n_chars": F.when(F.size("spans") > 0, size).otherwise(F.col("_doc.n_chars"))}
    return found.select(*(new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix, with ``size, source_size, target, taken`` (columns of these names are replaced).

    Equal rows are one, with what the mix takes of all of them.
    """
    new = ("size", "source_size", "target", "taken")
    named = docs.select(F.xxhash64(*docs.columns).alias("_row"), F.struct("*").alias("_doc"))
    told = named.select("_row", F.col("_doc.text").alias("text"), F.col("_doc.source").alias("source"))
    mixed = mixing.mix(told, id_column="_row").groupBy(F.col("doc_id").alias("_row"))
    mixed = mixed.agg(*(F.first(c).alias(c) for c in new[:3]), F.sum("taken").alias("taken"), F.count("*").alias("_n"))
    both = named.join(mixed.where("taken > 0"), "_row")
    once = both.where("_n = 1").unionByName(both.where("_n > 1").dropDuplicates(["_row"]))
    return once.select(*(F.col("_doc")[c].alias(c) for c in docs.columns if c not in new), *new)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
]

#: The first stage is a trained model; its rows cannot be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``. A stage's work tables, and what it read, go once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        with work_tables(spark):
            docs, path = stored_at(stage(spark, docs, sf_dir))
        remove(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)

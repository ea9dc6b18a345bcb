"""The corpus pipeline from end to end, on a small corpus with planted cases."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from yardline.llm import decontamination, jaccard, mixing, pii, storage, toxicity

BAD = ["scumbag", "worthless", "vermin"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(["river", "stone", "field", "cloud", "house", "green"]) + str(rng.randrange(300)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    top = str(tmp_path_factory.mktemp("corpus"))
    texts = {i: prose(rng, rng.randrange(40, 120)) for i in range(200)}
    toxic = list(range(200, 260))
    for i in toxic:
        own = prose(rng, 60).split()
        for at in sorted(rng.sample(range(60), 4), reverse=True):
            own.insert(at, rng.choice(BAD))
        texts[i] = " ".join(own)
    base = prose(rng, 150).split()
    for k, i in enumerate(range(300, 306)):  # near copies of one text
        copy = list(base)
        copy[k] = "changed"
        texts[i] = " ".join(copy)
    texts |= {310: texts[5], 311: texts[5]}
    passages = {f"b{k}": prose(rng, 40) for k in range(5)}
    texts |= {320 + k: f"{prose(rng, 20)} {p} {prose(rng, 20)}" for k, p in enumerate(passages.values())}
    texts |= {330: prose(rng, 30) + " mail ann@example.org or 192.168.0.7 now", 331: None, 332: "", 333: prose(rng, 2_000)}
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in texts.items()] + [(None, prose(rng, 50), None, "s1", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{top}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 200, 2)] + [(i, 0, 1) for i in toxic if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(list(passages.items()), "item_id string, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def work_tables_left(spark) -> set[str]:
    top = os.path.dirname(storage.shared_folder(spark)).removeprefix("file://")
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_run_takes_out_all_that_is_planted(spark, folder):
    before = work_tables_left(spark)
    result = corpus_pipeline.run(spark, folder)
    left = work_tables_left(spark) - before
    assert len(left) <= 3  # what the last stage reads, and its own
    rows = {r.doc_id: r for r in result.collect()}
    assert result.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken"]
    assert not rows.keys() & set(range(200, 260))
    assert not rows.keys() & {301, 302, 303, 304, 305, 310, 311, *range(320, 325)}
    if 330 in rows:
        assert "ann@example.org" not in rows[330].text and "192.168.0.7" not in rows[330].text
        assert rows[330].n_chars == len(rows[330].text)
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    clean = {r.doc_id for r in documents.where("doc_id < 200 OR doc_id IN (300, 330, 333) OR doc_id IS NULL").collect()}
    assert len(clean & rows.keys()) >= 0.7 * len(clean)  # the mix leaves some of the largest sources
    total = sum(r.taken for r in rows.values())
    assert all(0 < r.taken <= 3 * r["size"] for r in rows.values())
    assert abs(total - sum({r.source: r.target for r in rows.values()}.values())) <= max(r["size"] for r in rows.values()) + 500


def test_run_is_its_stages_one_after_another(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    docs = toxicity.keep_clean(docs, toxicity.train(docs, labels))
    docs = decontamination.decontaminate(jaccard.keep_one(docs), benchmark)
    masked = {r.doc_id: r.masked_text for r in pii.detect(docs.select("doc_id", "text")).select("doc_id", "masked_text").collect()}
    result = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in result} <= masked.keys()
    assert all(r.text == masked[r.doc_id] for r in result if r.doc_id is not None)
    again = spark.createDataFrame([(i, t, None, None, None) for i, t in masked.items()], SCHEMA)
    sources = docs.select(F.col("doc_id").alias("own"), F.col("source").alias("kept"))
    again = again.join(sources, F.col("doc_id").eqNullSafe(F.col("own"))).withColumn("source", F.col("kept")).drop("own", "kept")
    sizes = {r.doc_id: (r["size"], r.source_size, r.target) for r in mixing.mix(again).collect()}
    assert all((r["size"], r.source_size, r.target) == sizes[r.doc_id] for r in result)


def test_an_empty_corpus_gives_no_rows(spark, folder, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{table}.parquet").where("false").write.parquet(str(tmp_path / f"{table}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_keep_columns_and_clashing_names(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("size", F.lit(1)).withColumn("_doc", F.lit("x")).withColumn("score", F.lit(2.5))
    for name, stage in corpus_pipeline.STAGES:
        docs, path = storage.stored_at(stage(spark, docs, folder))
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "_doc", "score"]
    assert docs.count() > 100

"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_LOCAL: list[str] = []
_SCOPES: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset (tests on one machine), under a temporary folder."""
    top = spark.conf.get(_KEY, None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_KEY} must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="yardline-"))
        top = _LOCAL[0]
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write once and read again: cuts the lineage, and a lost executor costs no recomputation.

    Inside :func:`work_tables` the table is removed when that ends.
    """
    found, path = stored_at(df)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return found


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """A stored table that no scope removes, and its path."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        place = hadoop.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def work_tables(spark: SparkSession) -> Iterator[None]:
    """Remove all tables that are stored inside once it ends. Results must be written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        remove(spark, *_SCOPES.pop())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

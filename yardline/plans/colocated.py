"""Input tables bucketed by unit, so that joins and aggregates on the unit need no shuffle.

The files are written once, dealt to buckets by the unit. Bucket numbers stand in the
file names, so any session can declare the folder again as tables.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardline.sources.inputs import Inputs

#: The unit column of each table that has one.
UNIT_KEYS = {"trailers": "Unit", "leases": "Unit", "invoice_lines": "UnitNumber", "asset_statuses": "AssetName"}


def _table(prefix: str, name: str) -> str:
    return f"{prefix}_{name}"


def save(inputs: Inputs, folder: str, prefix: str, buckets: int) -> None:
    """Write the tables that have a unit under ``folder``, and declare them as ``<prefix>_<table>``.

    Rows meet their bucket in one shuffle, so each bucket is one file.
    """
    for name, key in UNIT_KEYS.items():
        frame: DataFrame = getattr(inputs, name)
        writer = frame.repartition(buckets, F.col(key)).write.format("parquet").bucketBy(buckets, key).mode("overwrite")
        writer.option("path", f"{folder.rstrip('/')}/{name}").saveAsTable(_table(prefix, name))


def declare(spark: SparkSession, inputs: Inputs, folder: str, prefix: str, buckets: int) -> None:
    """Declare tables that another session wrote; ``inputs`` gives the columns."""
    for name, key in UNIT_KEYS.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in getattr(inputs, name).schema)
        spark.sql(f"DROP TABLE IF EXISTS {_table(prefix, name)}")
        spark.sql(
            f"CREATE TABLE {_table(prefix, name)} ({columns}) USING parquet "
            f"CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{folder.rstrip('/')}/{name}'"
        )


def load(spark: SparkSession, inputs: Inputs, prefix: str) -> Inputs:
    """``inputs`` with its unit tables read from their buckets."""
    return dataclasses.replace(inputs, **{name: spark.table(_table(prefix, name)) for name in UNIT_KEYS})

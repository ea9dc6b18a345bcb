"""The six input tables, from parquet folders or from databases."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType, StructType

from yardline.sources.schemas import INPUTS
from yardline.sources.tables import Databases, read_parquet

# Compared for equality somewhere; databases often pad them or ignore trailing spaces.
KEY_TEXTS = {
    "Unit",
    "UnitNumber",
    "InvoiceNo",
    "AssetName",
    "Status",
    "LeaseStatus",
    "Fleetcity",
    "State",
    "type_bucket",
    "usage_category",
    "length_bucket",
}


@dataclass(frozen=True)
class Inputs:
    trailers: DataFrame
    leases: DataFrame
    invoices: DataFrame
    invoice_lines: DataFrame
    asset_statuses: DataFrame
    card_rates: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return dict(vars(self))


@dataclass(frozen=True)
class TableName:
    """Where a table is: database, table and, if large, its range partitioning."""

    database: str
    table: str
    partitioning: Mapping[str, Any] = field(default_factory=dict)


def _converted(name: str, found: DataType, declared: DataType) -> Column:
    """Cast that fails, rather than rounds, where money is finer than declared."""
    column = F.col(name)
    cast = column.cast(declared)
    finer = isinstance(found, (DoubleType, FloatType)) or isinstance(found, DecimalType) and found.scale > getattr(declared, "scale", 0)
    if not isinstance(declared, DecimalType) or not finer:
        return cast
    message = F.concat(F.lit(f"{name} is finer than {declared.simpleString()}: "), column.cast("string"))
    return F.when(cast.cast(found) != column, F.raise_error(message).cast(declared)).otherwise(cast)


def conform(frame: DataFrame, schema: StructType) -> DataFrame:
    """The declared columns in their declared types, key texts without trailing spaces."""
    columns = []
    for declared in schema:
        column = _converted(declared.name, frame.schema[declared.name].dataType, declared.dataType)
        if declared.name in KEY_TEXTS:
            column = F.rtrim(column)
        columns.append(column.alias(declared.name))
    return frame.select(*columns)


def _inputs(read: Callable[[str], DataFrame]) -> Inputs:
    return Inputs(**{name: conform(read(name), schema) for name, schema in INPUTS.items()})


def from_parquet(spark: SparkSession, directory: str) -> Inputs:
    """Tables stored as ``<directory>/<input name>``."""
    return _inputs(lambda name: read_parquet(spark, f"{directory.rstrip('/')}/{name}"))


def from_databases(spark: SparkSession, databases: Databases, names: Mapping[str, TableName]) -> Inputs:
    """Tables read over JDBC; ``names`` says where each input is."""
    return _inputs(
        lambda name: databases.table(spark, names[name].database, names[name].table, **names[name].partitioning)
    )

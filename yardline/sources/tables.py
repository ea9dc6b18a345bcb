"""Readers: parquet tables, JDBC tables and SQL text with bound parameters."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A parquet table; a declared schema saves the inference job."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


@dataclass(frozen=True)
class JdbcSource:
    """One named database.  Credentials come from the caller, never from code."""

    url: str
    user: str
    password: str = field(repr=False)
    driver: str = "com.microsoft.sqlserver.jdbc.SQLServerDriver"
    fetch_size: int = 10_000
    query_timeout_seconds: int = 1_200

    def options(self) -> dict[str, str]:
        return {
            "url": self.url,
            "user": self.user,
            "password": self.password,
            "driver": self.driver,
            "fetchsize": str(self.fetch_size),
            "queryTimeout": str(self.query_timeout_seconds),
        }

    def table_options(
        self,
        table: str,
        partition_column: str | None = None,
        lower: Any = None,
        upper: Any = None,
        partitions: int | None = None,
    ) -> dict[str, str]:
        """Options of one table read.

        With a partition column Spark issues ``partitions`` range queries, so a
        large table is not pulled through a single connection.  The bounds only
        place the range edges: rows outside them are still read.
        """
        options = self.options() | {"dbtable": table}
        ranged = (partition_column, lower, upper, partitions)
        if any(part is not None for part in ranged):
            if any(part is None for part in ranged):
                raise ValueError("partition_column, lower, upper and partitions go together")
            options |= {
                "partitionColumn": partition_column,
                "lowerBound": str(lower),
                "upperBound": str(upper),
                "numPartitions": str(partitions),
            }
        return options

    def table(self, spark: SparkSession, table: str, **partitioning: Any) -> DataFrame:
        return spark.read.format("jdbc").options(**self.table_options(table, **partitioning)).load()

    def query(self, spark: SparkSession, text: str) -> DataFrame:
        """Push a whole statement to the database and read its result."""
        return spark.read.format("jdbc").options(**self.options(), query=text).load()


class Databases:
    """Named JDBC sources, for example ``analytics`` and ``gps``."""

    def __init__(self, sources: Mapping[str, JdbcSource]):
        self._sources = dict(sources)

    def __getitem__(self, name: str) -> JdbcSource:
        try:
            return self._sources[name]
        except KeyError:
            raise KeyError(f"unknown database {name!r}; known: {sorted(self._sources)}") from None

    def table(self, spark: SparkSession, database: str, table: str, **partitioning: Any) -> DataFrame:
        return self[database].table(spark, table, **partitioning)


def run_query(spark: SparkSession, text: str, params: Mapping[str, Any] | None = None, **tables: DataFrame) -> DataFrame:
    """Run SQL text with named parameters (``:name``).

    ``tables`` are DataFrames named in the text as ``{name}``; no temporary
    view is left behind.  Parameters are bound as literals, never spliced.
    """
    return spark.sql(text, args=dict(params or {}), **tables)

"""Source audit: do the inputs hold the columns the queries need?"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from yardline.sources.schemas import INPUTS


def audit_table(name: str, table: DataFrame, schema: StructType) -> DataFrame:
    """One row per declared column: present or not, rows, nulls.

    One aggregate reads the table once; the rows are unfolded from its result.
    """
    present = [field.name for field in schema if field.name in table.columns]
    counts = table.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(column).isNull()).alias(f"nulls_{column}") for column in present]
    )

    def entry(column: str, required: bool):
        found = column in present
        return F.struct(
            F.lit(column).alias("column_name"),
            F.lit(found).alias("present"),
            F.lit(required).alias("required"),
            (F.col(f"nulls_{column}") if found else F.lit(None).cast("bigint")).alias("null_count"),
        )

    entries = F.array(*[entry(field.name, not field.nullable) for field in schema])
    return counts.select(F.lit(name).alias("table_name"), F.col("rows").alias("row_count"), F.inline(entries))


def source_audit(tables: Mapping[str, DataFrame], schemas: Mapping[str, StructType] = INPUTS) -> DataFrame:
    parts = [audit_table(name, table, schemas[name]) for name, table in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def problems(audit: DataFrame) -> DataFrame:
    """Missing columns and nulls in required ones."""
    return audit.where(~F.col("present") | (F.col("required") & (F.col("null_count") > 0)))

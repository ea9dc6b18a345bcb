"""Month-partitioned copies of the derived views.

Queries that look at one month or at the last twelve then read only those
months' folders. Saving replaces the months that the view holds and leaves the
others; a rebuild replaces all. All months have the decimals of the first save
or of the last rebuild: a month that does not fit them fails when it is saved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructField, StructType

from yardline.sources.schemas import BUCKET_STATISTICS, IDLE_ASSETS

IDLE_MONTH, STATISTICS_MONTH = "MonthStr", "Month"


def _decimals(spark: SparkSession, path: str) -> dict[str, DecimalType]:
    """The decimal types that a stored view has; none without a file."""
    try:
        return {f.name: f.dataType for f in spark.read.parquet(path).schema if isinstance(f.dataType, DecimalType)}
    except AnalysisException:
        return {}


def _fitted(view: DataFrame, kinds: dict[str, DecimalType]) -> DataFrame:
    """``view`` with decimals of the stored types; a value that they cannot hold is an error."""
    columns = {}
    for field in view.schema:
        kind = kinds.get(field.name, field.dataType)
        if kind != field.dataType:
            column = F.col(field.name)
            cast = column.try_cast(kind)
            lost = column.isNotNull() & ~F.coalesce(cast == column, F.lit(False))
            message = F.concat(F.lit(f"{field.name} does not fit the stored {kind.simpleString()}; rebuild the view: "), column.cast("string"))
            columns[field.name] = F.when(lost, F.raise_error(message).cast(kind)).otherwise(cast)
    return view.withColumns(columns) if columns else view


def _save(view: DataFrame, path: str, month: str, rebuild: bool) -> None:
    """Write by month.  The rebalance splits large months over several tasks."""
    fitted = view if rebuild else _fitted(view, _decimals(view.sparkSession, path))
    _write(fitted, path, month, "static" if rebuild else "dynamic")


def _write(fitted: DataFrame, path: str, month: str, mode: str) -> None:
    writer = fitted.hint("rebalance", month).write.mode("overwrite").option("partitionOverwriteMode", mode)
    writer.partitionBy(month).parquet(path)


def _replace(view: DataFrame, path: str, month: str, months: Sequence[str]) -> None:
    """Write the named months in one run of ``view``; those without a row become empty, so that their old rows go."""
    fitted, found = _fitted(view, _decimals(view.sparkSession, path)), Observation()
    counts = [F.count_if(F.col(month) == name).alias(name) for name in months]
    _write(fitted.where(F.col(month).isin(*months)).observe(found, *counts), path, month, "dynamic")
    for name in months:
        if not found.get[name]:
            fitted.where("false").drop(month).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{month}={name}")


def _load(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The view, with decimals as wide as they were saved."""
    found = _decimals(spark, path)
    kinds = [
        StructField(f.name, found.get(f.name, f.dataType) if isinstance(f.dataType, DecimalType) else f.dataType, f.nullable)
        for f in schema
    ]
    return spark.read.schema(StructType(kinds)).parquet(path).select(*schema.names)


def _newest(view: DataFrame, month: str) -> DataFrame:
    return view.where(F.col(month) == view.agg(F.max(month)).scalar())


def save_idle_history(history: DataFrame, path: str, *, rebuild: bool = False) -> None:
    _save(history, path, IDLE_MONTH, rebuild)


def replace_idle_months(history: DataFrame, path: str, months: Sequence[str]) -> None:
    """Replace just these months by what ``history`` holds of them."""
    _replace(history, path, IDLE_MONTH, months)


def load_idle_history(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, IDLE_ASSETS)


def load_latest_idle_month(spark: SparkSession, path: str) -> DataFrame:
    """The newest month that has rows: one folder is read, the others only for their row counts."""
    return _newest(load_idle_history(spark, path), IDLE_MONTH)


def save_bucket_statistics(statistics: DataFrame, path: str, *, rebuild: bool = False) -> None:
    _save(statistics, path, STATISTICS_MONTH, rebuild)


def replace_statistics_months(statistics: DataFrame, path: str, months: Sequence[str]) -> None:
    _replace(statistics, path, STATISTICS_MONTH, months)


def load_bucket_statistics(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, BUCKET_STATISTICS)

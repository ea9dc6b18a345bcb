"""CSV export of report frames.

An export is a folder of part files and, beside it, a status row that is written
last: file name, rows, ``ok`` or ``no data``. While files are being written the
row says ``writing``, so readers never take half an export for a whole one.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File name stem of each report.
REPORT_FILES = {
    "utilization": "utilization-report",
    "revenue": "revenue-report",
    "idle": "idle-assets-report",
    "critical-idle": "critical-idle-report",
    "never-leased": "never-leased-report",
    "locations": "trailer-locations",
    "inventory": "fleet-inventory",
}
DATE_ONLY, FULL_ISO = "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
_TIMES = (T.TimestampType, T.TimestampNTZType)
_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
_STATUS = "file string, rows long, status string"
MONTH_FOLDER = "month"


@dataclass(frozen=True)
class ExportResult:
    path: str
    rows: int

    @property
    def status(self) -> str:
        return "ok" if self.rows else "no data"


def report_path(directory: str, report: str, as_of: dt.datetime) -> str:
    return f"{directory.rstrip('/')}/{REPORT_FILES[report]}-{as_of:%Y-%m-%d}.csv"


def date_cells(frame: DataFrame) -> DataFrame:
    """Dates as ``yyyy-MM-dd`` and timestamps as full ISO text."""
    texts = {}
    for field in frame.schema:
        if isinstance(field.dataType, T.DateType):
            texts[field.name] = F.date_format(F.col(field.name), DATE_ONLY)
        elif isinstance(field.dataType, _TIMES):
            texts[field.name] = F.date_format(F.col(field.name), FULL_ISO)
    return frame.withColumns(texts) if texts else frame


def _written(cells: DataFrame, path: str, *, folder: str | None = None, compression: str | None = None) -> ExportResult:
    """Write and count rows in one run."""
    counted = Observation()
    writer = cells.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").options(**_OPTIONS)
    writer = writer.option("compression", compression) if compression else writer
    (writer.partitionBy(folder) if folder else writer).csv(path)
    return ExportResult(path, counted.get["rows"])


def write_csv(frame: DataFrame, path: str, *, single_file: bool = False, compression: str | None = None) -> ExportResult:
    """Write a directory of CSV part files with a header.

    Null and empty are both written as nothing; a value with a comma, quote or
    line break is quoted and its quotes doubled.  Rows are counted while they
    are written, so no second run is needed to tell an empty report.
    ``single_file`` is for small reports: it sends all rows through one task.
    ``compression`` (``gzip``) is for large ones: the part files hold the same
    text, and readers know them by their ending (``.csv.gz``).
    """
    cells = date_cells(frame)
    return _written(cells.coalesce(1) if single_file else cells, path, compression=compression)


def write_csv_by_month(frame: DataFrame, path: str, day: str, *, compression: str | None = None) -> ExportResult:
    """Write a frame from :func:`yardline.plans.ordering.newest_first` with months as folders (``month=yyyy-MM``).

    Newer months first, and in a month the part files by name, give the whole
    order: the tasks in turn hold older days, and part files are named by task.
    """
    by_month = frame.withColumn(MONTH_FOLDER, F.date_format(F.col(day), "yyyy-MM"))
    return _written(date_cells(by_month), path, folder=MONTH_FOLDER, compression=compression)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of an export in the types of ``schema``; empty cells are null, a cell of another type is an error.

    Columns are found by place: all files of an export have one header. Month folders add no column.
    """
    reader = spark.read.schema(schema).options(**_OPTIONS, mode="FAILFAST", dateFormat=DATE_ONLY, timestampNTZFormat=FULL_ISO)
    return reader.csv(path).select(*schema.names)


def _status_path(path: str) -> str:
    return f"{path}.status"


def _tell(spark: SparkSession, result: ExportResult, status: str) -> None:
    name = result.path.rsplit("/", 1)[-1]
    row = spark.range(1).select(F.lit(name).alias("file"), F.lit(result.rows).cast("long").alias("rows"), F.lit(status).alias("status"))
    row.write.mode("overwrite").json(_status_path(result.path))


def export_status(spark: SparkSession, *paths: str) -> DataFrame:
    """``file, rows, status`` of the exports at ``paths``."""
    return spark.read.schema(_STATUS).json([_status_path(path) for path in paths])


def export_report(
    frame: DataFrame,
    report: str,
    directory: str,
    *,
    as_of: dt.datetime,
    single_file: bool = False,
    compression: str | None = None,
) -> ExportResult:
    """Write a report under its dated name, and its status row once all is written."""
    path = report_path(directory, report, as_of)
    _tell(frame.sparkSession, ExportResult(path, 0), "writing")
    result = write_csv(frame, path, single_file=single_file, compression=compression)
    _tell(frame.sparkSession, result, result.status)
    return result


def read_report(spark: SparkSession, report: str, directory: str, schema: T.StructType, *, as_of: dt.datetime) -> DataFrame:
    """A finished export as typed rows; an export that is missing or not finished is an error."""
    path = report_path(directory, report, as_of)
    try:
        status = export_status(spark, path).first()
    except AnalysisException:
        status = None
    if status is None or status["status"] not in ("ok", "no data"):
        raise ValueError(f"{path} is {status['status'] if status else 'missing'}")
    return read_csv(spark, path, schema)

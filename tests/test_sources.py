"""Readers, the CSV sink and the source audit."""

from __future__ import annotations

import csv
import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import frames
from frames import AS_OF
from yardline.operators import audit, reports
from yardline.sources import csv_sink, inputs, testdata
from yardline.sources.schemas import INPUTS
from yardline.sources.tables import Databases, JdbcSource, run_query


def lines_of(path: str) -> list[str]:
    """All lines, the header of each part file kept once."""
    parts = [part.read_text().splitlines() for part in sorted(Path(path).glob("part-*.csv"))]
    return [parts[0][0], *[line for part in parts for line in part[1:]]]


def test_csv_cells(spark, tmp_path):
    moment = dt.datetime(2001, 11, 14, 9, 8, 7, 123456)
    frame = spark.createDataFrame(
        [("a,b", 'q"t', None, "", dt.date(2001, 1, 2), moment, 1.5)],
        "comma string, quote string, missing string, blank string, day date, ts timestamp_ntz, number double",
    )
    result = csv_sink.write_csv(frame, str(tmp_path / "cells"), single_file=True)
    assert (result.status, result.rows) == ("ok", 1)
    assert lines_of(result.path) == [
        "comma,quote,missing,blank,day,ts,number",
        '"a,b","q""t",,,2001-01-02,2001-11-14T09:08:07.123Z,1.5',
    ]


def test_export_reads_back(spark, tmp_path):
    units = testdata.trailers(spark, "/root/testdata/sf0.001")
    report = reports.report_inventory(units, as_of=AS_OF)
    result = csv_sink.export_report(report, "inventory", str(tmp_path), as_of=AS_OF)
    assert Path(result.path).name == "fleet-inventory-2001-11-15.csv"
    assert result.rows == report.count()
    parts = sorted(Path(result.path).glob("part-*.csv"))
    rows = [row for part in parts for row in csv.DictReader(part.open())]
    assert len(rows) == result.rows and list(rows[0]) == report.columns
    # Missing branches sort before blank ones; both are empty cells.
    keys = [(row["Branch"], row["Unit"]) for row in rows if row["Branch"]]
    assert keys == sorted(keys)


def test_empty_export_has_a_header_and_says_so(spark, tmp_path):
    none = frames.trailers(spark).where("false")
    report = reports.report_utilization(none, as_of=AS_OF)
    result = csv_sink.export_report(report, "utilization", str(tmp_path), as_of=AS_OF, single_file=True)
    assert (result.rows, result.status) == (0, "no data")
    written = "".join(part.read_text() for part in Path(result.path).glob("part-*.csv"))
    assert written.strip() in ("", ",".join(report.columns))


def test_every_report_has_a_file_name():
    names = {csv_sink.report_path("/x/", report, AS_OF) for report in csv_sink.REPORT_FILES}
    assert len(names) == 7 and "/x/idle-assets-report-2001-11-15.csv" in names


def test_run_query_binds_parameters(spark):
    units = frames.trailers(spark, {"Unit": "A", "Fleetcity": "O'Hare"}, {"Unit": "B"})
    text = "SELECT Unit FROM {units} WHERE Fleetcity = :branch"
    assert [r.Unit for r in run_query(spark, text, {"branch": "O'Hare"}, units=units).collect()] == ["A"]
    assert run_query(spark, "SELECT 1 AS one").collect() == [(1,)]


def test_jdbc_options():
    source = JdbcSource("jdbc:sqlserver://db;databaseName=x", "user", "secret")
    assert "secret" not in repr(source)
    assert source.table_options("dbo.t")["dbtable"] == "dbo.t"
    ranged = source.table_options("dbo.t", partition_column="id", lower=0, upper=100, partitions=8)
    assert (ranged["partitionColumn"], ranged["numPartitions"]) == ("id", "8")
    with pytest.raises(ValueError):
        source.table_options("dbo.t", partition_column="id")
    databases = Databases({"analytics": source})
    assert databases["analytics"] is source
    with pytest.raises(KeyError, match="gps"):
        databases["gps"]


def test_audit_finds_planted_problems(spark):
    units = frames.trailers(spark, {"Unit": "A"}, {"Unit": "B"}).drop("Cost")
    units = units.withColumn("Status", F.when(F.col("Unit") == "A", F.col("Status")))
    found = audit.problems(audit.source_audit({"trailers": units, "leases": frames.leases(spark, {})})).collect()
    assert {(r.column_name, r.present, r.null_count) for r in found} == {("Cost", False, None), ("Status", True, 1)}


def test_inputs_from_parquet_are_conformed(spark, tmp_path):
    tables = testdata.load(spark, "/root/testdata/sf0.001")
    for name, frame in tables.as_dict().items():
        if name == "leases":
            frame = frame.withColumn("DateOn", F.col("DateOn").cast("timestamp_ntz"))
            frame = frame.withColumn("Unit", F.concat("Unit", F.lit("  "))).withColumn("Extra", F.lit(1))
        frame.write.parquet(str(tmp_path / name))
    loaded = inputs.from_parquet(spark, str(tmp_path))
    for name, frame in loaded.as_dict().items():
        assert [(f.name, f.dataType) for f in frame.schema] == [(f.name, f.dataType) for f in INPUTS[name]]
    assert loaded.leases.exceptAll(tables.leases).isEmpty()


def test_inputs_from_databases_name_each_table(spark):
    asked = []

    class Fake:
        def table(self, spark, database, table, **partitioning):
            asked.append((database, table, partitioning))
            schema = INPUTS[table]
            return spark.createDataFrame([], schema)

    names = {name: inputs.TableName("analytics", name) for name in INPUTS}
    ranged = {"partition_column": "LeaseID", "lower": 0, "upper": 9, "partitions": 3}
    names["leases"] = inputs.TableName("analytics", "leases", ranged)
    names["asset_statuses"] = inputs.TableName("gps", "asset_statuses")
    inputs.from_databases(spark, Fake(), names)
    assert ("gps", "asset_statuses", {}) in asked and ("analytics", "leases", ranged) in asked
    assert len(asked) == len(INPUTS) == 6

"""Small hand-made inputs."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from yardline.sources import schemas

AS_OF = dt.datetime(2001, 11, 15, 12, 0, 0)


def day(text: str | None) -> dt.date | None:
    return None if text is None else dt.date.fromisoformat(text)


def money(value) -> Decimal | None:
    return None if value is None else Decimal(str(value)).quantize(Decimal("0.01"))


def _frame(spark: SparkSession, schema, defaults: dict, rows: list[dict]) -> DataFrame:
    records = [tuple({**defaults, **row}[name] for name in schema.names) for row in rows]
    return spark.createDataFrame(records, schema)


def trailers(spark: SparkSession, *rows: dict) -> DataFrame:
    defaults = {
        "Unit": "U1",
        "Status": "LEASED",
        "Fleetcity": "North",
        "Type": "VAN",
        "Year": "2000",
        "Length": "53'",
        "Make": "M",
        "VIN": "V",
        "Cost": money(100),
        "PurchaseDate": day("1999-01-10"),
        "SoldDate": None,
    }
    return _frame(spark, schemas.TRAILERS, defaults, list(rows))


def leases(spark: SparkSession, *rows: dict) -> DataFrame:
    defaults = {
        "LeaseID": 1,
        "Unit": "U1",
        "CustomerID": 7,
        "LeaseStatus": "ACTIVE",
        "DateOn": day("2001-01-01"),
        "DateOff": None,
        "Rate": money(500),
    }
    return _frame(spark, schemas.LEASES, defaults, list(rows))


def card_rates(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame([(*key, money(rate)) for *key, rate in rows], schemas.CARD_RATES)


def revenue(spark: SparkSession, *rows: dict) -> DataFrame:
    defaults = {
        "UnitNumber": "U1",
        "Branch": "North",
        "TypeBucket": "DRY_VAN",
        "UsageCategory": "OTR_0",
        "LengthBucket": "53",
        "YearRange": "1998-2001",
        "BillingStartDate": day("2001-09-01"),
        "BillingStopDate": day("2001-09-30"),
        "BilledMonthlyRate": money(900),
        "BilledDailyRate": money(30),
        "BilledMileageRate": money(0.05),
        "CardRateMonth": money(1000),
        "MonthlyRateVariance": None,
        "InvoiceNo": "I1",
        "LeaseNumber": 1,
    }
    filled = []
    for row in rows:
        full = {**defaults, **row}
        if full["CardRateMonth"] is not None and full["MonthlyRateVariance"] is None:
            full["MonthlyRateVariance"] = full["BilledMonthlyRate"] - full["CardRateMonth"]
        filled.append(full)
    return _frame(spark, schemas.REVENUE_DETAILS, defaults, filled)


def invoice_lines(spark: SparkSession, *rows: dict) -> DataFrame:
    defaults = {
        "InvoiceNo": "I1",
        "LeaseNumber": 1,
        "UnitNumber": "U1",
        "BillingStartDate": day("2001-10-01"),
        "BillingStopDate": day("2001-10-30"),
        "BilledMonthlyRate": money(900),
        "BilledDailyRate": money(30),
        "BilledMileageRate": money(0.05),
        "LineKind": "LEASE",
    }
    return _frame(spark, schemas.INVOICE_LINES, defaults, list(rows))


def idle(spark: SparkSession, *rows: dict) -> DataFrame:
    defaults = {
        "MonthStr": "2001-11",
        "Unit": "U1",
        "Branch": "North",
        "TypeBucket": "DRY_VAN",
        "UsageCategory": "OTR_0",
        "LengthBucket": "53",
        "YearRange": "1998-2001",
        "AssetCost": money(100),
        "LastActiveMonth": "2001-08",
        "CumulativeLeases": 2,
        "MonthsIdle": 3,
        "IdleDurationBucket": "0-6 Months",
        "CardRate": money(1000),
    }
    return _frame(spark, schemas.IDLE_ASSETS, defaults, list(rows))


def gps(spark: SparkSession, *rows: dict) -> DataFrame:
    defaults = {
        "AssetName": "U1",
        "LastUpdate": AS_OF,
        "Speed": 1.0,
        "Heading": 10,
        "Latitude": 40.0,
        "Longitude": -100.0,
        "Address": "A",
        "City": "C",
        "State": "S",
    }
    return _frame(spark, schemas.ASSET_STATUSES, defaults, list(rows))


def statistics(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schemas.BUCKET_STATISTICS)

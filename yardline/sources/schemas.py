"""Declared schemas of the input tables and of the derived views."""

from __future__ import annotations

from pyspark.sql import types as T

_MONEY = T.DecimalType(18, 2)
_RATE = _MONEY
# Cents per mile have parts of a cent.
_MILEAGE = T.DecimalType(18, 4)


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


TRAILERS = _schema(
    ("Unit", T.StringType(), False),
    ("Status", T.StringType(), False),
    ("Fleetcity", T.StringType(), True),
    ("Type", T.StringType(), True),
    ("Year", T.StringType(), True),
    ("Length", T.StringType(), True),
    ("Make", T.StringType(), True),
    ("VIN", T.StringType(), True),
    ("Cost", _MONEY, True),
    ("PurchaseDate", T.DateType(), False),
    ("SoldDate", T.DateType(), True),
)

LEASES = _schema(
    ("LeaseID", T.LongType(), False),
    ("Unit", T.StringType(), False),
    ("CustomerID", T.LongType(), True),
    ("LeaseStatus", T.StringType(), False),
    ("DateOn", T.DateType(), False),
    ("DateOff", T.DateType(), True),
    ("Rate", _RATE, True),
)

INVOICE_LINES = _schema(
    ("InvoiceNo", T.StringType(), False),
    ("LeaseNumber", T.LongType(), True),
    ("UnitNumber", T.StringType(), False),
    ("BillingStartDate", T.DateType(), True),
    ("BillingStopDate", T.DateType(), False),
    ("BilledMonthlyRate", _RATE, False),
    ("BilledDailyRate", _RATE, True),
    ("BilledMileageRate", _MILEAGE, True),
    ("LineKind", T.StringType(), True),
)

INVOICES = _schema(
    ("InvoiceNo", T.StringType(), False),
    ("CustomerID", T.LongType(), True),
    ("InvoiceDate", T.DateType(), True),
    ("InvoiceTotal", _MONEY, True),
)

ASSET_STATUSES = _schema(
    ("AssetName", T.StringType(), False),
    ("LastUpdate", T.TimestampNTZType(), True),
    ("Speed", T.DoubleType(), True),
    ("Heading", T.IntegerType(), True),
    ("Latitude", T.DoubleType(), True),
    ("Longitude", T.DoubleType(), True),
    ("Address", T.StringType(), True),
    ("City", T.StringType(), True),
    ("State", T.StringType(), True),
)

CARD_RATES = _schema(
    ("type_bucket", T.StringType(), False),
    ("usage_category", T.StringType(), False),
    ("length_bucket", T.StringType(), False),
    ("CardRateMonth", _RATE, True),
)

REVENUE_DETAILS = _schema(
    ("UnitNumber", T.StringType(), False),
    ("Branch", T.StringType(), True),
    ("TypeBucket", T.StringType(), True),
    ("UsageCategory", T.StringType(), True),
    ("LengthBucket", T.StringType(), True),
    ("YearRange", T.StringType(), True),
    ("BillingStartDate", T.DateType(), True),
    ("BillingStopDate", T.DateType(), False),
    ("BilledMonthlyRate", _RATE, False),
    ("BilledDailyRate", _RATE, True),
    ("BilledMileageRate", _MILEAGE, True),
    ("CardRateMonth", _RATE, True),
    ("MonthlyRateVariance", T.DecimalType(19, 2), True),
    ("InvoiceNo", T.StringType(), False),
    ("LeaseNumber", T.LongType(), True),
)

IDLE_ASSETS = _schema(
    ("MonthStr", T.StringType(), False),
    ("Unit", T.StringType(), False),
    ("Branch", T.StringType(), True),
    ("TypeBucket", T.StringType(), True),
    ("UsageCategory", T.StringType(), True),
    ("LengthBucket", T.StringType(), True),
    ("YearRange", T.StringType(), True),
    ("AssetCost", _MONEY, True),
    ("LastActiveMonth", T.StringType(), True),
    ("CumulativeLeases", T.LongType(), False),
    ("MonthsIdle", T.IntegerType(), False),
    ("IdleDurationBucket", T.StringType(), False),
    ("CardRate", _RATE, True),
)

BUCKET_STATISTICS = _schema(
    ("Month", T.StringType(), False),
    ("AggLevel", T.StringType(), False),
    ("Branch", T.StringType(), True),
    ("NumTrailers", T.LongType(), False),
    ("NumRentedTrailers", T.LongType(), False),
)

INPUTS = {
    "trailers": TRAILERS,
    "leases": LEASES,
    "invoices": INVOICES,
    "invoice_lines": INVOICE_LINES,
    "asset_statuses": ASSET_STATUSES,
    "card_rates": CARD_RATES,
}

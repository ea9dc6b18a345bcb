"""Fleet inputs derived from the order / part / line / event test tables.

The derivations follow FIXTURES.md section 2; money is built from integer
cents so that other engines get the same values.
"""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardline.plans.sizing import estimated_bytes, fits_broadcast
from yardline.sources.inputs import Inputs
from yardline.sources.tables import read_parquet

AS_OF = dt.datetime(2001, 11, 15, 12, 0, 0)
#: The night from which the incremental views go on to ``AS_OF``.
FIRST_NIGHT = dt.datetime(2001, 8, 20, 23, 0, 0)

#: Bytes of events from which a second scan costs less than a sort.
MANY_EVENTS = 64 << 20

# Fixed values of the synthetic price list: (code, amount).
_TYPE_BASE = (("DRY_VAN", 900), ("DRY_VAN_LIFTGATE", 1000), ("REEFER", 1300), ("REEFER_LIFTGATE", 1400), ("SPECIALTY", 700))
_USAGE_ADJUSTMENT = (("OTR_0", 200), ("OTR_1", 150), ("OTR_2", 100), ("CART_1", 50), ("CART_2", 0), ("STORAGE", -100))
_LENGTH_ADJUSTMENT = (("20", -100), ("28-32", -50), ("40", 0), ("48", 50), ("53", 100))

_PART = "p_partkey BIGINT, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"
_ORDERS = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ"
_LINEITEM = (
    "l_orderkey BIGINT, l_partkey BIGINT, l_extendedprice DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_shipdate TIMESTAMP_NTZ"
)
_EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE"


def _unit(key: str) -> str:
    return f"'U' || lpad(cast({key} AS string), 7, '0')"


def _money(amount: str, floor: int, span: int) -> str:
    """A price between ``floor`` and ``floor + span`` cents, as decimal."""
    cents = f"{floor} + cast(rint({amount} * 100) AS bigint) % {span}"
    return f"cast(cast({cents} AS decimal(18,0)) * 0.01 AS decimal(18,2))"


def trailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_parquet(spark, f"{sf_dir}/part.parquet", _PART)
    return part.selectExpr(
        f"{_unit('p_partkey')} AS Unit",
        "CASE WHEN p_partkey % 10 <= 5 THEN 'LEASED' WHEN p_partkey % 10 <= 8 THEN 'AVAILABLE' ELSE 'BOS' END AS Status",
        "CASE p_brand WHEN 'Brand#23' THEN 'TBD' WHEN 'Brand#24' THEN NULL WHEN 'Brand#25' THEN '' "
        "ELSE 'Branch ' || substr(p_brand, 7) END AS Fleetcity",
        "CASE WHEN p_type = 'ECONOMY' THEN CASE WHEN p_partkey % 3 = 0 THEN ' DRY VAN ' ELSE 'VAN' END "
        "WHEN p_type = 'SMALL' THEN CASE WHEN p_partkey % 3 = 0 THEN 'VAN LIFTGATE' ELSE 'LIFTGATE' END "
        "WHEN p_type = 'MEDIUM' THEN 'REEFER' WHEN p_type = 'PROMO' THEN 'REEFER LIFTGATE' "
        "WHEN p_type = 'STANDARD' THEN 'FLATBED' "
        "ELSE CASE p_partkey % 4 WHEN 0 THEN 'CHASSIS' WHEN 1 THEN 'PUP' WHEN 2 THEN ' ' ELSE NULL END END AS Type",
        "CASE WHEN p_partkey % 97 = 0 THEN 'N/A' ELSE cast(2002 - p_size % 20 AS string) END AS Year",
        "CASE WHEN p_partkey % 101 = 0 THEN NULL WHEN p_partkey % 103 = 0 THEN '' "
        "ELSE CASE p_partkey % 7 WHEN 0 THEN '20' WHEN 1 THEN \"28'\" WHEN 2 THEN '40' WHEN 3 THEN \"48'\" "
        "WHEN 4 THEN '45' ELSE \"53'\" END END AS Length",
        "p_brand AS Make",
        "'VIN' || lpad(cast(p_partkey * 7919 AS string), 14, '0') AS VIN",
        "cast(round(p_retailprice * 20, 2) AS decimal(18,2)) AS Cost",
        "DATE '1994-01-01' + cast(p_partkey % 365 AS int) AS PurchaseDate",
        "CASE WHEN p_partkey % 10 = 9 THEN DATE '2000-01-01' + cast(p_partkey % 365 AS int) END AS SoldDate",
    )


def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lease per order. Units numbered 6 modulo 20 are never leased: theirs go to the unit before."""
    orders = read_parquet(spark, f"{sf_dir}/orders.parquet", _ORDERS)
    part = read_parquet(spark, f"{sf_dir}/part.parquet", _PART)
    units = part.agg(F.count(F.lit(1))).scalar()
    return (
        orders.withColumn("unit_no", F.col("o_orderkey") % units)
        .withColumn("unit_no", F.col("unit_no") - F.when(F.col("unit_no") % 20 == 6, 1).otherwise(0))
        .selectExpr(
            "o_orderkey AS LeaseID",
            f"{_unit('unit_no')} AS Unit",
            "o_custkey AS CustomerID",
            "CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' ELSE 'ACTIVE' END AS LeaseStatus",
            "cast(o_orderdate AS date) AS DateOn",
            "CASE WHEN o_orderstatus = 'P' AND o_custkey % 10 = 0 THEN NULL "
            "WHEN o_orderstatus = 'F' THEN cast(o_orderdate AS date) + 90 "
            "WHEN o_orderstatus = 'O' THEN cast(o_orderdate AS date) + cast(30 + o_custkey % 300 AS int) "
            "ELSE cast(o_orderdate AS date) + 180 END AS DateOff",
            f"{_money('o_totalprice', 30000, 150000)} AS Rate",
        )
    )


def leases_as_known(leases: DataFrame, as_of: dt.datetime) -> DataFrame:
    """A snapshot: the leases started by a day, those that run on without an end."""
    today = F.lit(as_of.date())
    return leases.where(F.col("DateOn") <= today).withColumn("DateOff", F.when(F.col("DateOff") <= today, F.col("DateOff")))


def lease_changes(leases: DataFrame, since: dt.datetime, as_of: dt.datetime) -> DataFrame:
    """The rows that are new or other in the snapshot of ``as_of`` than in that of ``since``."""
    before = F.lit(since.date())
    is_new, has_ended = F.col("DateOn") > before, F.coalesce(F.col("DateOff") > before, F.lit(False))
    return leases_as_known(leases, as_of).where(is_new | has_ended)


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = read_parquet(spark, f"{sf_dir}/lineitem.parquet", _LINEITEM)
    return lineitem.selectExpr(
        "'INV' || cast(l_orderkey AS string) AS InvoiceNo",
        "l_orderkey AS LeaseNumber",
        f"{_unit('l_partkey')} AS UnitNumber",
        "cast(l_shipdate AS date) - 29 AS BillingStartDate",
        "cast(l_shipdate AS date) AS BillingStopDate",
        f"{_money('l_extendedprice', 30000, 150000)} AS BilledMonthlyRate",
        f"{_money('l_extendedprice', 1000, 5000)} AS BilledDailyRate",
        "cast(l_tax AS decimal(18,4)) AS BilledMileageRate",
        "CASE l_returnflag WHEN 'A' THEN 'LEASE' WHEN 'N' THEN 'MILEAGE' ELSE 'REPAIR' END AS LineKind",
    )


def invoice_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invoice per order."""
    orders = read_parquet(spark, f"{sf_dir}/orders.parquet", _ORDERS)
    return orders.selectExpr(
        "'INV' || cast(o_orderkey AS string) AS InvoiceNo",
        "o_custkey AS CustomerID",
        "cast(o_orderdate AS date) AS InvoiceDate",
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice headers with the total they state.

    Planted: no header for orders numbered 7 modulo 50, a total off by one for
    those numbered 3 modulo 40, none for those numbered 5 modulo 60.
    """
    billed = invoice_lines(spark, sf_dir).groupBy("InvoiceNo").agg(F.sum("BilledMonthlyRate").alias("billed"))
    number = F.substring("InvoiceNo", F.lit(4), F.length("InvoiceNo")).cast("bigint")
    total = F.coalesce("billed", F.lit(0).cast("decimal(28,2)")) + F.when(number % 40 == 3, 1).otherwise(0)
    headers = invoice_headers(spark, sf_dir).where(number % 50 != 7).join(billed, "InvoiceNo", "left")
    return headers.select(
        "InvoiceNo", "CustomerID", "InvoiceDate", F.when(number % 60 != 5, total.cast("decimal(18,2)")).alias("InvoiceTotal")
    )


def asset_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event per asset; as many assets as units.

    ``max_by`` combines on the map side, but sorts all events to keep texts. Of
    many events the newest time and number of an asset are one decimal
    instead, which a hash aggregate keeps; these rows, at most one per unit,
    pick their events from a second scan if they are few enough to broadcast.
    """
    events = read_parquet(spark, f"{sf_dir}/events.parquet", _EVENTS)
    part = read_parquet(spark, f"{sf_dir}/part.parquet", _PART)
    numbered = events.withColumn("asset_no", F.col("event_id") % part.agg(F.count(F.lit(1))).scalar())
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").cast("decimal(18,0)")
    placed = numbered.withColumn("place", micros * F.lit(f"1{0:019d}").cast("decimal(20,0)") + F.col("event_id").cast("decimal(19,0)"))
    newest = placed.groupBy("asset_no").agg(F.max("place").alias("place"))
    if estimated_bytes(events) >= MANY_EVENTS and fits_broadcast(newest, part):
        picked = placed.join(F.broadcast(newest), ["asset_no", "place"])
    else:
        whole = F.max_by(F.struct("ts", "user_id", "event_type", "value"), F.struct("ts", "event_id"))
        picked = numbered.groupBy("asset_no").agg(whole.alias("e")).select("asset_no", "e.*")
    return (
        picked.selectExpr(
            f"{_unit('asset_no')} AS AssetName",
            "ts - INTERVAL '8112' DAY AS LastUpdate",
            "value % 70 AS Speed",
            "cast(user_id % 360 AS int) AS Heading",
            "CASE WHEN event_type = 'error' THEN NULL ELSE 25 + value % 24 END AS Latitude",
            "CASE WHEN event_type = 'error' THEN NULL ELSE -124 + value % 57 END AS Longitude",
            "cast(user_id AS string) || ' Main St, Unit ' || event_type AS Address",
            "'City ' || cast(user_id % 40 AS string) AS City",
            "CASE WHEN event_type = 'signup' THEN NULL ELSE 'S' || lpad(cast(user_id % 20 AS string), 2, '0') END AS State",
        )
    )


def card_rates(spark: SparkSession) -> DataFrame:
    """The 150-row price list, as an inline table whose size Catalyst knows."""
    rows = []
    for kind, base in _TYPE_BASE:
        for usage, by_age in _USAGE_ADJUSTMENT:
            for length, by_length in _LENGTH_ADJUSTMENT:
                unpriced = kind == "SPECIALTY" and usage == "STORAGE"
                rows.append(f"('{kind}', '{usage}', '{length}', {0 if unpriced else base + by_age + by_length})")
    return spark.sql(
        "SELECT type_bucket, usage_category, length_bucket, cast(rate AS decimal(18,2)) AS CardRateMonth "
        f"FROM VALUES {', '.join(rows)} AS r(type_bucket, usage_category, length_bucket, rate)"
    )


def misspelt(inputs: Inputs) -> Inputs:
    """The inputs with texts as they come from a database that ignores case and trailing spaces.

    Of the units, every third writes its branch in capitals and every third with
    blanks behind it; leases write every second unit in small letters, GPS rows
    all with a blank.
    """
    number = F.substring("Unit", F.lit(2), F.length("Unit")).cast("bigint")
    branch = F.when(number % 3 == 0, F.upper("Fleetcity")).when(number % 3 == 1, F.concat("Fleetcity", F.lit("  ")))
    unit = F.when(F.col("LeaseID") % 2 == 0, F.lower("Unit")).otherwise(F.col("Unit"))
    return dataclasses.replace(
        inputs,
        trailers=inputs.trailers.withColumn("Fleetcity", branch.otherwise(F.col("Fleetcity"))),
        leases=inputs.leases.withColumn("Unit", unit),
        asset_statuses=inputs.asset_statuses.withColumn("AssetName", F.concat("AssetName", F.lit(" "))),
    )


def load(spark: SparkSession, sf_dir: str) -> Inputs:
    return Inputs(
        trailers=trailers(spark, sf_dir),
        leases=leases(spark, sf_dir),
        invoices=invoices(spark, sf_dir),
        invoice_lines=invoice_lines(spark, sf_dir),
        asset_statuses=asset_statuses(spark, sf_dir),
        card_rates=card_rates(spark),
    )

"""Detail exports.

``ordered=False`` leaves out the final sort, which on a large export costs a
range shuffle of all rows. Invoice lines, the largest report, are put in order
by their days instead, without a range sort.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardline.functions import buckets
from yardline.operators import idle as idle_queries
from yardline.operators.locations import location_detail
from yardline.operators.revenue import in_period, variance_pct
from yardline.operators.selection import is_set, rentable, where_equal
from yardline.plans.ordering import newest_first
from yardline.plans.revenue_details import monthly_variance


def _sorted(frame: DataFrame, ordered: bool, *keys: Column | str) -> DataFrame:
    return frame.orderBy(*keys) if ordered else frame


def _short_bucket() -> Column:
    return buckets.type_bucket(F.col("Type"), rare_as_specialty=False)


# The codes that the columns of invoice lines take, in any order.
_LINE_CODES = {
    "TypeBucket": (*buckets.TYPE_CODES, "SPECIALTY"),
    "UsageCategory": buckets.USAGE_ORDER,
    "LengthBucket": (*(code for code, _ in buckets.LENGTH_LIMITS), buckets.LONGEST),
}
_CODES, _CODE_BITS = "_codes", 4


def _known(name: str) -> Column:
    return F.array(*map(F.lit, _LINE_CODES[name]))


def _with_short_codes(rows: DataFrame) -> DataFrame:
    """Known codes as places in one number ``_codes``; their columns keep only what is no known code."""
    places = {name: F.coalesce(F.array_position(_known(name), F.col(name)), F.lit(0)) for name in _LINE_CODES}
    packed = sum((F.shiftleft(place, _CODE_BITS * i) for i, place in enumerate(places.values())), F.lit(0)).cast("int")
    return rows.withColumns({_CODES: packed} | {name: F.when(place == 0, F.col(name)) for name, place in places.items()})


def _with_codes(rows: DataFrame) -> DataFrame:
    """Undo :func:`_with_short_codes`."""
    mask = (1 << _CODE_BITS) - 1
    place = lambda i: F.shiftright(_CODES, _CODE_BITS * i).bitwiseAND(mask)
    names = enumerate(_LINE_CODES)
    return rows.withColumns({name: F.coalesce(F.col(name), F.get(_known(name), place(i) - 1)) for i, name in names}).drop(_CODES)


def report_utilization(
    trailers: DataFrame,
    *,
    as_of: dt.datetime,
    branch: str | None = None,
    type_bucket: str | None = None,
    usage_category: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    rows = where_equal(rentable(trailers), Fleetcity=branch).select(
        "Unit",
        F.col("Fleetcity").alias("Branch"),
        "Status",
        "Type",
        "Year",
        "Length",
        _short_bucket().alias("TypeBucket"),
        buckets.usage_category(F.col("Year"), as_of).alias("UsageCategory"),
        "Cost",
        "PurchaseDate",
    )
    rows = where_equal(rows, TypeBucket=type_bucket, UsageCategory=usage_category)
    return _sorted(rows, ordered, "Branch", "Unit")


def report_inventory(
    trailers: DataFrame,
    *,
    as_of: dt.datetime,
    branch: str | None = None,
    type_bucket: str | None = None,
    status: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Unit master with buckets; without a status the rentable units."""
    chosen = where_equal(trailers, Status=status) if is_set(status) else rentable(trailers)
    rows = where_equal(chosen, Fleetcity=branch).select(
        "Unit",
        F.col("Fleetcity").alias("Branch"),
        "Status",
        "Type",
        _short_bucket().alias("TypeBucket"),
        "Year",
        "Length",
        buckets.length_bucket(F.col("Length")).alias("LengthBucket"),
        buckets.usage_category(F.col("Year"), as_of).alias("UsageCategory"),
        "Make",
        "VIN",
        "Cost",
        "PurchaseDate",
        "SoldDate",
    )
    return _sorted(where_equal(rows, TypeBucket=type_bucket), ordered, "Branch", "Unit")


def report_revenue(
    revenue: DataFrame,
    *,
    as_of: dt.datetime | None = None,
    branch: str | None = None,
    type_bucket: str | None = None,
    period: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Every invoice line; ``period`` (with ``as_of``) keeps the newest months.

    The variances follow from two rates of the line: they are taken after the
    lines are put in order, so that they are not exchanged.
    """
    rows = in_period(where_equal(revenue, Branch=branch, TypeBucket=type_bucket), period, as_of).drop("MonthlyRateVariance")
    if ordered:
        rows = _with_codes(newest_first(_with_short_codes(rows), "BillingStopDate", ["Branch", "UnitNumber", "InvoiceNo"]))
    return rows.select(
        "UnitNumber",
        "Branch",
        "TypeBucket",
        "UsageCategory",
        "LengthBucket",
        "YearRange",
        "BillingStartDate",
        "BillingStopDate",
        "BilledMonthlyRate",
        "BilledDailyRate",
        "BilledMileageRate",
        "CardRateMonth",
        monthly_variance().alias("MonthlyRateVariance"),
        variance_pct().alias("VariancePercent"),
        "InvoiceNo",
        "LeaseNumber",
    )


def _idle_rows(idle: DataFrame, **selection) -> DataFrame:
    return idle_queries.select_idle(idle, exclude_placeholder=False, **selection)


_IDLE_UNIT = ["Unit", "Branch", "TypeBucket", "UsageCategory", "LengthBucket", "YearRange", "AssetCost"]


def report_idle(
    idle: DataFrame,
    *,
    branch: str | None = None,
    type_bucket: str | None = None,
    idle_bucket: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    rows = _idle_rows(idle, branch=branch, type_bucket=type_bucket, idle_bucket=idle_bucket)
    rows = rows.select(
        *_IDLE_UNIT, "LastActiveMonth", "CumulativeLeases", "MonthsIdle", "IdleDurationBucket", "CardRate"
    )
    return _sorted(rows, ordered, F.desc("MonthsIdle"), "Branch", "Unit")


def report_critical_idle(idle: DataFrame, *, branch: str | None = None, ordered: bool = True) -> DataFrame:
    rows = _idle_rows(idle, branch=branch, idle_bucket=buckets.CRITICAL_IDLE).select(
        *_IDLE_UNIT,
        "LastActiveMonth",
        F.col("CumulativeLeases").alias("TotalLeases"),
        "MonthsIdle",
        F.col("CardRate").alias("MonthlyOpportunityCost"),
    )
    return _sorted(rows, ordered, F.desc("MonthsIdle"), F.desc("AssetCost"), "Unit")


def report_never_leased(
    idle: DataFrame, *, branch: str | None = None, type_bucket: str | None = None, ordered: bool = True
) -> DataFrame:
    rows = _idle_rows(idle, branch=branch, type_bucket=type_bucket).where("CumulativeLeases = 0")
    rows = rows.select(
        *_IDLE_UNIT,
        F.col("MonthsIdle").alias("MonthsSincePurchase"),
        F.col("CardRate").alias("MonthlyOpportunityCost"),
    )
    return _sorted(rows, ordered, F.desc("MonthsSincePurchase"), "Branch", "Unit")


def report_locations(
    trailers: DataFrame,
    leases: DataFrame,
    asset_statuses: DataFrame,
    *,
    as_of: dt.datetime,
    branch: str | None = None,
    state: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    rows = location_detail(trailers, leases, asset_statuses, as_of=as_of, branch=branch, state=state).select(
        "Unit",
        F.col("Fleetcity").alias("HomeBranch"),
        F.col("CustomerID").alias("Customer"),
        "Type",
        _short_bucket().alias("TypeBucket"),
        "Latitude",
        "Longitude",
        "Address",
        F.col("City").alias("CurrentCity"),
        F.col("State").alias("CurrentState"),
        "Speed",
        "Heading",
        "LastUpdate",
    )
    return _sorted(rows, ordered, "CurrentState", "CurrentCity", "Unit", "Customer")

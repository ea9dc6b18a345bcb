"""Invoice lines with unit buckets and card rate."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardline.plans.sizing import broadcast_if_small
from yardline.plans.units import rated_trailers


def monthly_variance() -> Column:
    return F.col("BilledMonthlyRate") - F.col("CardRateMonth")


def revenue_details(
    invoice_lines: DataFrame, trailers: DataFrame, card_rates: DataFrame, *, as_of: dt.datetime
) -> DataFrame:
    """One row per invoice line; lines of unknown units keep null buckets.

    The price list joins the units, not the lines, so the large side goes
    through a single join.  When the units are too many to broadcast, that
    join shuffles on the unit and adaptive execution splits a unit whose
    lines fill a partition.
    """
    units = rated_trailers(trailers, card_rates, as_of=as_of).select(
        F.col("Unit").alias("UnitNumber"),
        F.col("Fleetcity").alias("Branch"),
        F.col("type_bucket").alias("TypeBucket"),
        F.col("usage_category").alias("UsageCategory"),
        F.col("length_bucket").alias("LengthBucket"),
        F.col("year_range").alias("YearRange"),
        "CardRateMonth",
    )
    return invoice_lines.join(broadcast_if_small(units, trailers), "UnitNumber", "left").select(
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
        "InvoiceNo",
        "LeaseNumber",
    )

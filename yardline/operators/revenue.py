"""Billed rates against card rates.

Line-level queries take revenue details
(:func:`yardline.plans.revenue_details.revenue_details`).  Queries that only
add up money first total the invoice lines per unit, where a unit with a third
of all lines shrinks to one row per map task, and join the units afterwards.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yardline.functions import buckets, formats, moments, money, status
from yardline.operators.selection import ACTIVE_LEASE, count_where, is_set, not_placeholder, where_equal
from yardline.operators.utilization import utilization_by_branch
from yardline.plans.sizing import broadcast_if_small, fits_broadcast
from yardline.plans.units import RATE_KEY, rated_trailers

TOP_MISSING_BUCKETS = 10
LINE_KINDS = ("LEASE", "MILEAGE", "REPAIR")


def in_period(revenue: DataFrame, period: str | None, as_of: dt.datetime | None) -> DataFrame:
    """Lines of the newest months; without a period all."""
    if not is_set(period):
        return revenue
    if as_of is None:
        raise ValueError("a period needs as_of")
    first = moments.shift_months(as_of, -moments.period_months(period, as_of)).date()
    return revenue.where(F.col("BillingStopDate") >= F.lit(first))


def select_revenue(
    revenue: DataFrame,
    *,
    branch: str | None = None,
    type_bucket: str | None = None,
    usage_category: str | None = None,
    period: str | None = None,
    as_of: dt.datetime | None = None,
) -> DataFrame:
    rows = in_period(revenue.where(not_placeholder(F.col("Branch"))), period, as_of)
    return where_equal(rows, Branch=branch, TypeBucket=type_bucket, UsageCategory=usage_category)


def benchmarked(revenue: DataFrame, **selection) -> DataFrame:
    """Selected lines that have a card rate."""
    return select_revenue(revenue, **selection).where(F.col("CardRateMonth").isNotNull())


def variance_pct() -> Column:
    return buckets.variance_pct(F.col("BilledMonthlyRate"), F.col("CardRateMonth"))


def _rates(rows: DataFrame) -> list[Column]:
    """Measures of benchmarked lines. The mean variance is the gap of the two exact totals, so money is summed twice, not four times."""
    billed, card, lines = money.total(rows, "BilledMonthlyRate"), money.total(rows, "CardRateMonth"), F.count(F.lit(1))
    return [
        lines.alias("invoice_count"),
        billed.alias("total_billed"),
        money.mean(rows, "BilledMonthlyRate").alias("avg_billed_rate"),
        money.mean(rows, "CardRateMonth").alias("avg_card_rate"),
        money.mean_of(billed - card, lines).alias("avg_variance"),
    ]


def _mean_variance_pct() -> Column:
    return F.avg(variance_pct()).alias("avg_variance_pct")


def revenue_summary(revenue: DataFrame, **selection) -> DataFrame:
    rows = benchmarked(revenue, **selection)
    return rows.agg(
        *_rates(rows),
        _mean_variance_pct(),
        count_where(F.col("MonthlyRateVariance") >= 0).alias("at_or_above_card"),
        count_where(F.col("MonthlyRateVariance") < 0).alias("below_card"),
    )


def revenue_by_period(revenue: DataFrame, *, as_of: dt.datetime, **selection) -> DataFrame:
    """Benchmarked lines and money of every named period, from one pass over the lines."""
    rows, found = benchmarked(revenue, **selection), []
    for period in formats.PERIOD_LABELS:
        first = moments.shift_months(as_of, -moments.period_months(period, as_of)).date()
        within = F.col("BillingStopDate") >= F.lit(first)
        measures = (F.count_if(within).alias("invoice_count"), money.total(rows, "BilledMonthlyRate", within).alias("total_billed"))
        found.append(F.struct(F.lit(period).alias("period"), F.lit(first).alias("first_day"), *measures))
    label = formats.label(F.col("period"), formats.PERIOD_LABELS).alias("label")
    periods = rows.agg(F.array(*found).alias("found")).select(F.inline("found"))
    return periods.select("period", label, "first_day", "invoice_count", "total_billed")


def rate_share(revenue: DataFrame, **selection) -> DataFrame:
    """Shares of lines at or above and below their card rate."""
    total = F.col("invoice_count")
    return revenue_summary(revenue, **selection).select(
        "invoice_count",
        buckets.utilization(F.col("at_or_above_card"), total).alias("at_or_above_share"),
        buckets.utilization(F.col("below_card"), total).alias("below_share"),
        status.either(F.col("below_card") > F.col("at_or_above_card"), "critical", "warning").alias("below_status"),
    )


def revenue_by_branch(revenue: DataFrame, **selection) -> DataFrame:
    rows = benchmarked(revenue, **selection)
    return rows.groupBy(F.col("Branch").alias("branch")).agg(*_rates(rows), _mean_variance_pct()).orderBy("branch")


def branch_rate_status(revenue: DataFrame, **selection) -> DataFrame:
    """Mean variance per branch with its status; a missing mean counts as 0."""
    value = F.coalesce("avg_variance_pct", F.lit(0.0))
    return revenue_by_branch(revenue, **selection).select(
        "branch", value.alias("variance"), status.rate_status(value).alias("status")
    )


def revenue_by_type(revenue: DataFrame, **selection) -> DataFrame:
    rows = benchmarked(revenue, **selection)
    return rows.groupBy(F.col("TypeBucket").alias("type_bucket")).agg(*_rates(rows)).orderBy(F.desc("total_billed"), "type_bucket")


def revenue_by_usage(revenue: DataFrame, **selection) -> DataFrame:
    rows = benchmarked(revenue, **selection)
    return rows.groupBy(F.col("UsageCategory").alias("usage_category")).agg(*_rates(rows)).orderBy("usage_category")


def revenue_trend(revenue: DataFrame, **selection) -> DataFrame:
    rows = benchmarked(revenue, **selection)
    grouped = rows.groupBy(moments.month_begin(F.col("BillingStopDate")).alias("month"))
    return grouped.agg(*_rates(rows)).withColumn("month", moments.month_of(F.col("month"))).orderBy("month")


def revenue_latest_month(
    revenue: DataFrame, *, branch: str | None = None, exclude_placeholder: bool = True
) -> DataFrame:
    """Rate figures of the newest billing month.

    The newest month is that of all lines outside the placeholder branch, with
    or without card rate and whatever the branch filter.  All months are
    summed in one pass and the newest of those few rows is kept.
    """
    rows = revenue.where(not_placeholder(F.col("Branch"))) if exclude_placeholder else revenue
    chosen = F.col("CardRateMonth").isNotNull()
    if is_set(branch):
        chosen = chosen & (F.col("Branch") == F.lit(branch))
    gap = F.when(chosen, F.col("MonthlyRateVariance"))
    monthly = rows.groupBy(moments.month_begin(F.col("BillingStopDate")).alias("month")).agg(
        F.avg(F.when(chosen, variance_pct())).alias("avg_variance_pct"),
        F.sum(F.when(gap >= 0, 1).when(gap < 0, 0)).alias("at_or_above_card"),
        F.sum(F.when(gap < 0, 1).when(gap >= 0, 0)).alias("below_card"),
    )
    measures = ["avg_variance_pct", "at_or_above_card", "below_card"]
    return monthly.agg(moments.month_of(F.max("month")).alias("month"), *[F.max_by(m, "month").alias(m) for m in measures])


def variance_lines(revenue: DataFrame, **selection) -> DataFrame:
    """Each line's variance and its class."""
    return select_revenue(revenue, **selection).select(
        "InvoiceNo",
        "LeaseNumber",
        "UnitNumber",
        "BilledMonthlyRate",
        "CardRateMonth",
        variance_pct().alias("variance_pct"),
        buckets.variance_bucket(F.col("BilledMonthlyRate"), F.col("CardRateMonth")).alias("variance_bucket"),
    )


def variance_distribution(revenue: DataFrame, **selection) -> DataFrame:
    bucket = buckets.variance_bucket(F.col("BilledMonthlyRate"), F.col("CardRateMonth")).alias("variance_bucket")
    return (
        select_revenue(revenue, **selection)
        .groupBy(bucket)
        .agg(F.count(F.lit(1)).alias("invoice_count"), money.total(revenue, "BilledMonthlyRate").alias("total_billed"))
        .orderBy("variance_bucket")
    )


def variance_shares(revenue: DataFrame, **selection) -> DataFrame:
    """The distribution with each class's share of all lines.

    The window runs over the five classes, after the lines are counted.
    """
    total = F.sum("invoice_count").over(Window.partitionBy(F.lit(0)))
    share = buckets.utilization(F.col("invoice_count"), total)
    return variance_distribution(revenue, **selection).withColumn("share", share).orderBy("variance_bucket")


def billed_per_unit(invoice_lines: DataFrame) -> DataFrame:
    """Invoice lines totalled per unit."""
    return invoice_lines.groupBy(F.col("UnitNumber").alias("Unit")).agg(
        money.total(invoice_lines, "BilledMonthlyRate").alias("billed"), F.count(F.lit(1)).alias("lines")
    )


def units_without_card_rate(
    invoice_lines: DataFrame,
    trailers: DataFrame,
    card_rates: DataFrame,
    *,
    as_of: dt.datetime,
    branch: str | None = None,
) -> DataFrame:
    """Billed units outside the placeholder branch that no price covers."""
    units = rated_trailers(trailers, card_rates, as_of=as_of)
    unpriced = where_equal(units, Fleetcity=branch).where(
        F.col("CardRateMonth").isNull() & not_placeholder(F.col("Fleetcity"))
    )
    lines = invoice_lines
    if fits_broadcast(unpriced, trailers):
        # Few lines belong to these units: drop the others before the shuffle.
        wanted = F.broadcast(unpriced.select(F.col("Unit").alias("UnitNumber")))
        lines = lines.join(wanted, "UnitNumber", "left_semi")
    return (
        billed_per_unit(lines)
        .join(unpriced, "Unit")
        .select(
            F.col("Unit").alias("unit"),
            F.col("Fleetcity").alias("branch"),
            *RATE_KEY,
            "year_range",
            (F.col("billed").cast("double") / F.col("lines")).alias("avg_billed_rate"),
            F.col("lines").alias("invoice_count"),
            F.col("billed").alias("total_billed"),
        )
        .orderBy("branch", "type_bucket", "unit")
    )


def units_without_card_rate_summary(
    invoice_lines: DataFrame,
    trailers: DataFrame,
    card_rates: DataFrame,
    *,
    as_of: dt.datetime,
    branch: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Distinct unpriced units and their revenue per bucket (one row per unit below)."""
    units = units_without_card_rate(invoice_lines, trailers, card_rates, as_of=as_of, branch=branch)
    by_bucket = (
        units.groupBy(*RATE_KEY)
        .agg(F.count("unit").alias("unit_count"), F.sum("total_billed").alias("total_revenue_at_risk"))
        .orderBy(F.desc("unit_count"), *RATE_KEY)
    )
    return by_bucket if limit is None else by_bucket.limit(limit)


def revenue_at_risk_total(
    invoice_lines: DataFrame,
    trailers: DataFrame,
    card_rates: DataFrame,
    *,
    as_of: dt.datetime,
    branch: str | None = None,
) -> DataFrame:
    """Unpriced units and their revenue in total, zero when there are none."""
    buckets_at_risk = units_without_card_rate_summary(invoice_lines, trailers, card_rates, as_of=as_of, branch=branch)
    return buckets_at_risk.agg(
        F.coalesce(F.sum("unit_count"), F.lit(0)).alias("total_units"),
        F.coalesce(F.sum("total_revenue_at_risk"), F.lit(0)).alias("total_revenue_at_risk"),
    )


def recent_revenue_by_branch(
    invoice_lines: DataFrame, trailers: DataFrame, *, as_of: dt.datetime, months: int = 1
) -> DataFrame:
    """Billed total and lines per branch since ``months`` months before ``as_of``."""
    since = moments.on_or_after(F.col("BillingStopDate"), moments.shift_months(as_of, -months))
    recent = invoice_lines.where(since)
    branches = trailers.select("Unit", F.col("Fleetcity").alias("branch"))
    if fits_broadcast(branches):
        # Lines meet their branch before any shuffle and combine to a row per branch and task.
        units = F.broadcast(branches.withColumnRenamed("Unit", "UnitNumber"))
        billed = recent.join(units, "UnitNumber", "left").groupBy("branch")
        totals = billed.agg(money.total(recent, "BilledMonthlyRate").alias("total_revenue"), F.count(F.lit(1)).alias("invoice_count"))
    else:
        billed = billed_per_unit(recent).join(branches, "Unit", "left").groupBy("branch")
        totals = billed.agg(F.sum("billed").alias("total_revenue"), F.sum("lines").alias("invoice_count"))
    return totals.orderBy(F.desc("total_revenue"), "branch")


def revenue_growth(revenue: DataFrame, **selection) -> DataFrame:
    """Monthly billed total with its change against the month before.

    The window runs over the monthly totals, one row per calendar month.
    """
    monthly = revenue_trend(revenue, **selection).select("month", "total_billed")
    previous = F.lag("total_billed").over(Window.partitionBy(F.lit(0)).orderBy("month"))
    billed, before = F.col("total_billed").cast("double"), F.col("previous_billed").cast("double")
    growth = (billed - before) / F.nullif(before, F.lit(0.0))
    return (
        monthly.withColumn("previous_billed", previous)
        .withColumn("growth", growth)
        .withColumn("status", F.when(F.col("growth").isNotNull(), status.growth_status(F.col("growth"))))
        .orderBy("month")
    )


def revenue_components(invoice_lines: DataFrame, trailers: DataFrame) -> DataFrame:
    """Billed total per month and branch, split into lease, mileage and repair.

    A unit has few lines of one kind in a month, so totals per unit would not
    shrink the lines: they join their branch directly.
    """
    branches = trailers.select(F.col("Unit").alias("UnitNumber"), F.col("Fleetcity").alias("branch"))
    kind_total = lambda kind: money.total(invoice_lines, "BilledMonthlyRate", F.col("LineKind") == kind)
    split = (
        invoice_lines.join(broadcast_if_small(branches), "UnitNumber", "left")
        .groupBy(moments.month_begin(F.col("BillingStopDate")).alias("month"), "branch")
        .agg(*[kind_total(kind).alias(kind) for kind in LINE_KINDS])
    )
    parts = {f"{kind.lower()}_revenue": F.coalesce(kind, F.lit(0).cast("decimal(38,2)")) for kind in LINE_KINDS}
    columns = [value.alias(name) for name, value in parts.items()]
    total = sum(list(parts.values())[1:], list(parts.values())[0])
    month = moments.month_of(F.col("month")).alias("month")
    return split.select(month, "branch", *columns, total.alias("total_revenue")).orderBy("month", "branch")


def invoice_totals(invoice_headers: DataFrame, invoice_lines: DataFrame) -> DataFrame:
    """Every invoice header with the number and total of its lines; lines are totalled before the join."""
    lines = invoice_lines.groupBy("InvoiceNo").agg(
        F.count(F.lit(1)).alias("line_count"), money.total(invoice_lines, "BilledMonthlyRate").alias("total_billed")
    )
    return invoice_headers.join(lines, "InvoiceNo", "left").select(
        F.col("InvoiceNo").alias("invoice_no"),
        F.col("CustomerID").alias("customer_id"),
        F.col("InvoiceDate").alias("invoice_date"),
        F.coalesce("line_count", F.lit(0)).alias("line_count"),
        F.coalesce("total_billed", F.lit(0).cast("decimal(28,2)")).alias("total_billed"),
    )


def invoice_reconciliation(invoices: DataFrame, invoice_lines: DataFrame) -> DataFrame:
    """Headers against their lines, with the invoices that only one side knows.

    Lines are totalled before the join, so an invoice with very many lines is one row on either side.
    """
    lines = invoice_lines.groupBy("InvoiceNo").agg(
        F.count(F.lit(1)).alias("line_count"), money.total(invoice_lines, "BilledMonthlyRate").alias("line_total")
    )
    headers = invoices.select("InvoiceNo", "CustomerID", "InvoiceDate", F.col("InvoiceTotal").alias("stated_total"), F.lit(True).alias("has_header"))
    both = headers.join(lines, "InvoiceNo", "full")
    difference = F.col("line_total") - F.col("stated_total")
    status = (
        F.when(F.col("has_header").isNull(), "no header")
        .when(F.col("line_count").isNull(), "no lines")
        .when(F.col("stated_total").isNull(), "no total")
        .when(difference == 0, "agrees")
        .otherwise("differs")
    )
    return both.select(
        F.col("InvoiceNo").alias("invoice_no"),
        F.col("CustomerID").alias("customer_id"),
        F.col("InvoiceDate").alias("invoice_date"),
        "stated_total",
        F.coalesce("line_count", F.lit(0)).alias("line_count"),
        "line_total",
        difference.alias("difference"),
        status.alias("status"),
    )


def reconciliation_summary(reconciled: DataFrame) -> DataFrame:
    """Invoices and money per status of :func:`invoice_reconciliation`."""
    return reconciled.groupBy("status").agg(
        F.count(F.lit(1)).alias("invoice_count"),
        F.sum("line_count").alias("line_count"),
        F.sum("stated_total").alias("stated_total"),
        F.sum("line_total").alias("line_total"),
    )


def lines_without_header(invoices: DataFrame, invoice_lines: DataFrame) -> DataFrame:
    """The invoice lines whose invoice has no header."""
    orphans = invoice_lines.join(invoices.select("InvoiceNo"), "InvoiceNo", "left_anti")
    return orphans.select(
        F.col("InvoiceNo").alias("invoice_no"),
        F.col("LeaseNumber").alias("lease_number"),
        F.col("UnitNumber").alias("unit"),
        F.col("BillingStopDate").alias("billing_stop_date"),
        F.col("BilledMonthlyRate").alias("billed_monthly_rate"),
    )


def headers_without_lines(invoices: DataFrame, invoice_lines: DataFrame) -> DataFrame:
    """The invoices that have no line."""
    billed = invoice_lines.select("InvoiceNo").distinct()
    return invoices.join(billed, "InvoiceNo", "left_anti").select(
        F.col("InvoiceNo").alias("invoice_no"), F.col("CustomerID").alias("customer_id"), F.col("InvoiceDate").alias("invoice_date")
    )


def rate_realization(trailers: DataFrame, leases: DataFrame, card_rates: DataFrame, *, as_of: dt.datetime) -> DataFrame:
    """Lease rate over card rate of every lease in force."""
    running = leases.where(
        (F.col("LeaseStatus") == ACTIVE_LEASE) & moments.in_force(F.col("DateOn"), F.col("DateOff"), as_of)
    )
    units = rated_trailers(trailers, card_rates, as_of=as_of, year_range=False)
    rate, card = F.col("Rate"), F.col("CardRateMonth")
    return running.join(broadcast_if_small(units, trailers), "Unit").select(
        F.col("Unit").alias("unit"),
        "LeaseID",
        F.col("Fleetcity").alias("branch"),
        *RATE_KEY,
        rate.alias("current_rate"),
        card.alias("card_rate"),
        F.when(card > 0, rate.cast("double") / F.nullif(card, F.lit(0)).cast("double")).alias("rate_realization"),
        buckets.variance_pct(rate, card).alias("variance_pct"),
    )


def type_chart(revenue: DataFrame, **selection) -> DataFrame:
    return revenue_by_type(revenue, **selection).select(
        formats.display_name(F.col("type_bucket")).alias("name"),
        F.col("avg_billed_rate").alias("billed"),
        F.col("avg_card_rate").alias("card"),
        F.col("avg_variance").alias("variance"),
    )


def branch_comparison(
    trailers: DataFrame, idle_units: DataFrame, invoice_lines: DataFrame, *, as_of: dt.datetime
) -> DataFrame:
    """Utilization, month- and year-to-date revenue and idle units per branch.

    ``idle_units`` are the idle rows of the ``as_of`` month.
    """
    today = F.lit(as_of.date())
    stop = F.col("BillingStopDate")
    this_year = invoice_lines.where((stop >= F.lit(as_of.date().replace(month=1, day=1))) & (stop <= today))
    in_month = stop >= F.lit(as_of.date().replace(day=1))
    rate = "BilledMonthlyRate"
    amounts = (money.total(this_year, rate, in_month).alias("mtd"), money.total(this_year, rate).alias("ytd"))
    branches = trailers.where(F.col("Fleetcity").isNotNull()).select("Unit", F.col("Fleetcity").alias("branch"))
    lines = this_year.withColumnRenamed("UnitNumber", "Unit")
    if fits_broadcast(branches, trailers):
        revenue = lines.join(F.broadcast(branches), "Unit").groupBy("branch").agg(*amounts)
    else:
        per_unit = lines.groupBy("Unit").agg(*amounts)
        revenue = per_unit.join(branches, "Unit").groupBy("branch").agg(F.sum("mtd").alias("mtd"), F.sum("ytd").alias("ytd"))
    idle = idle_units.groupBy(F.col("Branch").alias("branch")).agg(F.count(F.lit(1)).alias("idle"))
    no_money = F.lit(0).cast("decimal(38,2)")
    return (
        utilization_by_branch(trailers)
        .join(revenue, "branch", "left")
        .join(idle, "branch", "left")
        .select(
            "branch",
            "utilization",
            F.coalesce("mtd", no_money).alias("revenue_mtd"),
            F.coalesce("ytd", no_money).alias("revenue_ytd"),
            F.coalesce("idle", F.lit(0)).alias("idle_count"),
        )
        .orderBy("branch")
    )

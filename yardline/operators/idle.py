"""Idle assets.

The functions take the idle-asset rows they report on: one month's rows
(:func:`yardline.plans.lease_history.idle_snapshot` or ``latest_month``) or,
for the trend, the whole history.  ``exclude_placeholder=False`` keeps the
placeholder branch and units without a branch.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardline.functions import buckets, formats, status
from yardline.operators.selection import count_where, is_set, not_placeholder, where_equal
from yardline.plans.lease_history import fleet_units, lease_totals
from yardline.plans.units import with_buckets

TOP_CRITICAL = 25
TOP_BRANCHES = 15
TOP_TYPES = 5


def select_idle(
    idle: DataFrame,
    *,
    branch: str | None = None,
    type_bucket: str | None = None,
    usage_category: str | None = None,
    idle_bucket: str | None = None,
    exclude_placeholder: bool = True,
) -> DataFrame:
    """The chosen idle rows; ``idle_bucket`` may omit the word Months."""
    rows = idle.where(not_placeholder(F.col("Branch"))) if exclude_placeholder else idle
    if is_set(idle_bucket):
        idle_bucket = buckets.idle_bucket_name(idle_bucket)
    return where_equal(
        rows,
        Branch=branch,
        TypeBucket=type_bucket,
        UsageCategory=usage_category,
        IdleDurationBucket=idle_bucket,
    )


def _is_critical() -> Column:
    return F.col("IdleDurationBucket") == buckets.CRITICAL_IDLE


def _never_leased() -> Column:
    return F.col("CumulativeLeases") == 0


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def _mean_card_rate() -> Column:
    return F.avg("CardRate").cast("double")


_MEASURES = {
    "unit_count": lambda: F.count(F.lit(1)),
    "total_cost": lambda: _or_zero(F.sum("AssetCost")),
    "avg_months_idle": lambda: _or_zero(F.avg("MonthsIdle")),
    "monthly_opportunity_cost": lambda: _or_zero(F.sum("CardRate")),
    "critical_count": lambda: count_where(_is_critical()),
    "never_leased_count": lambda: count_where(_never_leased()),
}


def _measures(*names: str) -> list[Column]:
    return [_MEASURES[name]().alias(name) for name in names]


def idle_summary(idle: DataFrame, **selection) -> DataFrame:
    return select_idle(idle, **selection).agg(
        F.count(F.lit(1)).alias("total_idle"),
        _or_zero(F.sum("AssetCost")).alias("total_idle_cost"),
        _or_zero(F.avg("MonthsIdle")).alias("avg_months_idle"),
        _mean_card_rate().alias("avg_card_rate"),
        _or_zero(F.sum("CardRate")).alias("total_opportunity_cost"),
        count_where(_never_leased()).alias("total_never_leased"),
        count_where(_is_critical()).alias("critical_count"),
    )


def idle_status(idle: DataFrame, **selection) -> DataFrame:
    return idle_summary(idle, **selection).select(
        "avg_months_idle", status.idle_status(F.col("avg_months_idle")).alias("status")
    )


def idle_by_duration(idle: DataFrame, *, edges: Sequence[int] = buckets.IDLE_EDGES, **selection) -> DataFrame:
    grouped = select_idle(idle, **selection).groupBy(F.col("IdleDurationBucket").alias("idle_bucket"))
    measures = _measures("unit_count", "total_cost", "avg_months_idle", "monthly_opportunity_cost")
    return grouped.agg(*measures).orderBy(buckets.idle_bucket_order(F.col("idle_bucket"), edges))


def idle_duration_options(idle: DataFrame, **selection) -> DataFrame:
    """The duration filter's choices: code, label and units of each that has any."""
    code = F.regexp_replace("idle_bucket", " Months$", "")
    return idle_by_duration(idle, **selection).select(
        code.alias("value"), formats.label(code, formats.IDLE_LABELS).alias("label"), "unit_count"
    )


def idle_by_branch(idle: DataFrame, **selection) -> DataFrame:
    measures = _measures(
        "unit_count", "total_cost", "avg_months_idle", "monthly_opportunity_cost", "critical_count", "never_leased_count"
    )
    return select_idle(idle, **selection).groupBy(F.col("Branch").alias("branch")).agg(*measures).orderBy("branch")


def idle_by_type(idle: DataFrame, **selection) -> DataFrame:
    measures = _measures("unit_count", "total_cost", "avg_months_idle", "monthly_opportunity_cost")
    grouped = select_idle(idle, **selection).groupBy(F.col("TypeBucket").alias("type_bucket")).agg(*measures)
    return grouped.orderBy(F.desc("unit_count"), "type_bucket")


def idle_by_usage(idle: DataFrame, **selection) -> DataFrame:
    measures = _measures("unit_count", "total_cost", "avg_months_idle", "monthly_opportunity_cost")
    grouped = select_idle(idle, **selection).groupBy(F.col("UsageCategory").alias("usage_category")).agg(*measures)
    return grouped.orderBy("usage_category")


def idle_trend(history: DataFrame, **selection) -> DataFrame:
    """Per month over the whole history; the placeholder branch counts by default."""
    selection.setdefault("exclude_placeholder", False)
    measures = _measures("unit_count", "avg_months_idle", "monthly_opportunity_cost", "critical_count")
    grouped = select_idle(history, **selection).groupBy(F.col("MonthStr").alias("month")).agg(*measures)
    return grouped.orderBy("month")


def _detail(idle: DataFrame, names: dict[str, str]) -> DataFrame:
    return idle.select(*[F.col(source).alias(name) for name, source in names.items()])


_UNIT_COLUMNS = {
    "unit": "Unit",
    "branch": "Branch",
    "type_bucket": "TypeBucket",
    "usage_category": "UsageCategory",
    "length_bucket": "LengthBucket",
}


def never_leased(idle: DataFrame, **selection) -> DataFrame:
    columns = _UNIT_COLUMNS | {"asset_cost": "AssetCost", "months_idle": "MonthsIdle", "card_rate": "CardRate"}
    rows = select_idle(idle, **selection).where(_never_leased())
    return _detail(rows, columns).orderBy(F.desc("months_idle"), "unit")


def never_leased_by_branch(idle: DataFrame, **selection) -> DataFrame:
    rows = select_idle(idle, **selection).where(_never_leased())
    grouped = rows.groupBy(F.col("Branch").alias("branch")).agg(*_measures("unit_count", "total_cost", "avg_months_idle"))
    return grouped.orderBy(F.desc("unit_count"), "branch")


def critical_idle(idle: DataFrame, **selection) -> DataFrame:
    columns = _UNIT_COLUMNS | {
        "year_range": "YearRange",
        "asset_cost": "AssetCost",
        "months_idle": "MonthsIdle",
        "last_active_month": "LastActiveMonth",
        "total_leases": "CumulativeLeases",
        "card_rate": "CardRate",
    }
    rows = select_idle(idle, **selection).where(_is_critical())
    return _detail(rows, columns).orderBy(F.desc("months_idle"), F.desc("asset_cost"), "unit")


def critical_idle_top(idle: DataFrame, *, limit: int = TOP_CRITICAL, **selection) -> DataFrame:
    """The longest idle units, with display texts for the table."""
    rows = critical_idle(idle, **selection).orderBy(F.desc("months_idle"), "unit").limit(limit)
    return rows.select(
        "unit",
        "branch",
        "type_bucket",
        "usage_category",
        "months_idle",
        formats.last_active(F.col("last_active_month")).alias("last_active"),
        "total_leases",
        "card_rate",
    )


def critical_idle_table(idle: DataFrame, *, limit: int = TOP_CRITICAL, **selection) -> DataFrame:
    """The longest idle units as the page shows them: labels for codes, a dash where no price is known."""
    return critical_idle_top(idle, limit=limit, **selection).select(
        "unit",
        "branch",
        formats.label(F.col("type_bucket"), formats.TYPE_LABELS).alias("type"),
        formats.label(F.col("usage_category"), formats.USAGE_LABELS).alias("usage"),
        "months_idle",
        "last_active",
        formats.card_rate_or_dash(F.col("card_rate")).alias("card_rate"),
    )


def idle_matrix(idle: DataFrame, *, edges: Sequence[int] = buckets.IDLE_EDGES, **selection) -> DataFrame:
    grouped = select_idle(idle, **selection).groupBy(
        F.col("Branch").alias("branch"), F.col("IdleDurationBucket").alias("idle_bucket")
    )
    order = buckets.idle_bucket_order(F.col("idle_bucket"), edges)
    return grouped.agg(*_measures("unit_count", "total_cost")).orderBy("branch", order)


def idle_breakdown(
    idle: DataFrame, *, limit: int | None = None, edges: Sequence[int] = buckets.IDLE_EDGES, **selection
) -> DataFrame:
    """Per type: the largest duration bucket and the never-leased share.

    Type x bucket counts are taken once; on equal counts the shorter bucket wins.
    """
    cells = (
        select_idle(idle, **selection)
        .groupBy("TypeBucket", "IdleDurationBucket")
        .agg(*_measures("unit_count", "never_leased_count"))
    )
    largest_first = F.struct("unit_count", -buckets.idle_bucket_order(F.col("IdleDurationBucket"), edges))
    by_type = (
        cells.groupBy(F.col("TypeBucket").alias("type_bucket"))
        .agg(
            F.max_by("IdleDurationBucket", largest_first).alias("max_duration_bucket"),
            buckets.utilization(F.sum("never_leased_count"), F.sum("unit_count")).alias("never_leased_pct"),
            F.sum("unit_count").alias("total_type_units"),
        )
        .orderBy(F.desc("total_type_units"), "type_bucket")
    )
    return by_type if limit is None else by_type.limit(limit)


def idle_top_branches(idle: DataFrame, *, limit: int = TOP_BRANCHES, **selection) -> DataFrame:
    return (
        idle_by_branch(idle, **selection)
        .select(
            F.col("branch").alias("name"),
            F.col("unit_count").alias("total"),
            F.col("critical_count").alias("critical"),
            F.col("never_leased_count").alias("never_leased"),
        )
        .orderBy(F.desc("total"), "name")
        .limit(limit)
    )


def never_leased_share(idle: DataFrame, **selection) -> DataFrame:
    """Branches with never-leased units and their share of the idle units."""
    return (
        idle_by_branch(idle, **selection)
        .where("never_leased_count > 0")
        .select(
            "branch",
            "never_leased_count",
            "unit_count",
            buckets.utilization(F.col("never_leased_count"), F.col("unit_count")).alias("never_leased_share"),
            "avg_months_idle",
        )
        .orderBy(F.desc("never_leased_count"), "branch")
    )


def idle_units_last_rate(trailers: DataFrame, leases: DataFrame, *, as_of: dt.datetime) -> DataFrame:
    """Idle fleet units with days idle and the rate of their newest lease."""
    units = with_buckets(fleet_units(trailers, as_of=as_of), "type_bucket", "usage_category", as_of=as_of)
    rows = units.join(lease_totals(leases, as_of=as_of), "Unit", "left")
    today = F.lit(as_of.date())
    since = F.coalesce("latest_end", "PurchaseDate")
    return rows.where(F.coalesce(F.col("latest_end") <= today, F.lit(True))).select(
        F.col("Unit").alias("unit"),
        F.col("Fleetcity").alias("branch"),
        F.date_diff(today, since).alias("days_idle"),
        F.col("newest_rate").alias("last_lease_rate"),
        "type_bucket",
        "usage_category",
    )

"""Key figures that combine several queries into one row."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardline.functions import buckets, moments, status
from yardline.operators import idle as idle_queries
from yardline.operators import locations, revenue as revenue_queries, utilization
from yardline.operators.selection import is_set, not_placeholder, one_row, units_of_branch

# Limits of the alerts and of the card statuses.
LOW_UTILIZATION = 0.7
LOW_RATE_VARIANCE = -0.1
CHURN_LIMIT = 0.05
NEVER_LEASED_LIMIT = 20
STALE_LIMIT = 10


def _month_figures(statistics: DataFrame, branch: str | None) -> DataFrame:
    """Per month: its figures and, from the month before, the previous ones.

    Each month's row is emitted under its own key and under the next month's,
    so the calendar predecessor is found by one small aggregate.
    """
    level = "BY_BRANCH" if is_set(branch) else "GLOBAL"
    chosen = F.col("AggLevel") == level
    if is_set(branch):
        chosen = chosen & (F.col("Branch") == F.lit(branch))
    monthly = (
        statistics.where(not_placeholder(F.col("Branch")))
        .groupBy("Month")
        .agg(
            F.sum(F.when(chosen, F.col("NumRentedTrailers"))).alias("leased"),
            F.sum(F.when(chosen, F.col("NumTrailers"))).alias("total"),
        )
    )
    nothing = F.lit(None).cast("bigint")
    own = F.struct(
        F.col("Month").alias("month"),
        F.lit(1).alias("present"),
        F.col("leased").alias("leased"),
        F.col("total").alias("total"),
        nothing.alias("leased_before"),
        nothing.alias("total_before"),
    )
    following = F.struct(
        moments.next_month(F.col("Month")).alias("month"),
        F.lit(None).cast("int").alias("present"),
        nothing.alias("leased"),
        nothing.alias("total"),
        F.col("leased").alias("leased_before"),
        F.col("total").alias("total_before"),
    )
    return monthly.select(F.inline(F.array(own, following)))


def fleet_kpis(
    statistics: DataFrame,
    trailers: DataFrame,
    leases: DataFrame,
    *,
    as_of: dt.datetime,
    branch: str | None = None,
    period: str = "LTM",
) -> DataFrame:
    """Current utilization, its monthly change, lease activity and churn.

    ``statistics`` needs the newest month and the one before, no others. Month
    figures, leases per ending month and the live fleet are stacked,
    summed per month and reduced to the newest month with statistics.
    """
    since = moments.shift_months(as_of, -moments.period_months(period, as_of))
    began, ended = F.col("DateOn"), F.col("DateOff")
    activity = (
        units_of_branch(leases, trailers, branch)
        .groupBy(moments.month_begin(F.col("DateOff")).alias("month"))
        .agg(
            F.count(F.lit(1)).alias("returned"),
            F.count_if(moments.on_or_after(began, since)).alias("new_leases"),
            F.count_if(moments.before(ended, as_of) & moments.on_or_after(ended, since)).alias("ended_leases"),
        )
        .withColumn("month", moments.month_of(F.col("month")))
    )
    live = utilization.global_utilization(trailers, branch=branch).select(
        F.col("leased_trailers").alias("live_leased"), F.col("total_trailers").alias("live_total")
    )
    figures = _month_figures(statistics, branch)
    stacked = figures.unionByName(activity, allowMissingColumns=True).unionByName(live, allowMissingColumns=True)
    names = [name for name in stacked.columns if name != "month"]
    per_month = stacked.groupBy("month").agg(*[F.max(name).alias(name) for name in names])
    newest = F.when(F.col("present") == 1, F.col("month"))
    picked = ["leased", "total", "leased_before", "total_before", "returned"]
    summed = ["new_leases", "ended_leases", "live_leased", "live_total"]
    row = per_month.agg(
        F.max(newest).alias("month"),
        *[F.max_by(name, newest).alias(name) for name in picked],
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in summed],
    )
    zero = F.lit(0.0)
    current = buckets.utilization(F.col("leased"), F.col("total"))
    previous = buckets.utilization(F.col("leased_before"), F.col("total_before"))
    live_ratio = F.coalesce(buckets.utilization(F.col("live_leased"), F.col("live_total")), zero)
    started = F.coalesce("leased_before", F.lit(0))
    churn = F.when(started > 0, F.coalesce("returned", F.lit(0)).cast("double") / started).otherwise(zero)
    kpis = row.select(
        "month",
        F.coalesce(F.nullif(current, zero), live_ratio).alias("current_utilization"),
        F.coalesce(previous, zero).alias("previous_utilization"),
        (F.coalesce(current, zero) - F.coalesce(previous, zero)).alias("mm_change"),
        "new_leases",
        "ended_leases",
        started.alias("leased_at_start"),
        F.coalesce("returned", F.lit(0)).alias("units_returned_latest"),
        churn.alias("asset_churn_pct"),
    )
    return kpis.withColumns(
        {
            "utilization_status": status.utilization_status(F.col("current_utilization")),
            "mm_status": status.either(F.col("mm_change") >= 0, "good", "critical"),
            "lease_activity_status": status.either(F.col("new_leases") >= F.col("ended_leases"), "good", "warning"),
            "churn_status": status.either(F.col("asset_churn_pct") < CHURN_LIMIT, "good", "warning"),
        }
    )


def alerts(trailers: DataFrame, revenue: DataFrame, *, branch: str | None = None) -> DataFrame:
    """Raised alerts, or one row that says the fleet is healthy.

    A missing value counts as 0, so an empty fleet raises the utilization alert.
    """
    figures = one_row(
        utilization.global_utilization(trailers, branch=branch).select("utilization"),
        revenue_queries.revenue_latest_month(revenue, branch=branch).select("avg_variance_pct"),
    )
    zero = F.lit(0.0)
    value, variance = F.coalesce("utilization", zero), F.coalesce("avg_variance_pct", zero)

    def alert(severity: str, name: str, figure: Column) -> Column:
        return F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("alert"), figure.alias("value"))

    raised = F.array_compact(
        F.array(
            F.when(value < LOW_UTILIZATION, alert("critical", "utilization_below_70_percent", value)),
            F.when(variance < LOW_RATE_VARIANCE, alert("warning", "rates_over_10_percent_below_card", variance)),
        )
    )
    healthy = F.array(alert("good", "fleet_performance_healthy", value))
    return figures.select(F.inline(F.when(F.size(raised) > 0, raised).otherwise(healthy)))


def overview_kpis(
    trailers: DataFrame,
    leases: DataFrame,
    asset_statuses: DataFrame,
    idle: DataFrame,
    revenue: DataFrame,
    *,
    as_of: dt.datetime,
    branch: str | None = None,
) -> DataFrame:
    """The headline cards of all pages with their statuses, in one row."""
    stale = locations.stale_gps(trailers, leases, asset_statuses, as_of=as_of, branch=branch)
    row = one_row(
        utilization.global_utilization(trailers, branch=branch).drop("other_status"),
        idle_queries.idle_summary(idle, branch=branch).select(
            "total_idle", "avg_months_idle", "total_never_leased", "critical_count"
        ),
        revenue_queries.revenue_latest_month(revenue, branch=branch).drop("month"),
        stale.agg(F.count(F.lit(1)).alias("stale_gps_count")),
    )
    zero = F.lit(0.0)
    value = F.coalesce("utilization", zero)
    variance = F.coalesce("avg_variance_pct", zero)
    below = F.col("below_card") > F.col("at_or_above_card")
    return row.select(
        "total_trailers",
        "leased_trailers",
        "available_trailers",
        "utilization",
        utilization.gauge_percent(value).alias("gauge_percent"),
        status.utilization_status(value).alias("utilization_status"),
        F.coalesce(F.nullif("total_idle", F.lit(0)), "available_trailers", F.lit(0)).alias("idle_assets"),
        status.idle_status(F.col("avg_months_idle")).alias("idle_status"),
        F.coalesce("critical_count", F.lit(0)).alias("critical_count"),
        status.either(F.col("critical_count") > 0, "critical", "good").alias("critical_status"),
        F.coalesce("total_never_leased", F.lit(0)).alias("never_leased_count"),
        status.either(F.col("total_never_leased") > NEVER_LEASED_LIMIT, "warning", "neutral").alias(
            "never_leased_status"
        ),
        variance.alias("avg_variance_pct"),
        status.rate_status(variance).alias("rate_status"),
        "at_or_above_card",
        "below_card",
        status.either(below, "critical", "warning").alias("below_card_status"),
        "stale_gps_count",
        status.either(F.col("stale_gps_count") > STALE_LIMIT, "warning", "good").alias("stale_gps_status"),
    )

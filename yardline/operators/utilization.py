"""Fleet utilization: leased units over rentable units."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardline.functions import buckets, formats, moments, status
from yardline.operators.selection import (
    AVAILABLE,
    LEASED,
    count_where,
    fleet,
    is_set,
    named_branch,
    not_placeholder,
    rentable,
    where_equal,
)
from yardline.plans.units import with_buckets


def _leased() -> Column:
    return count_where(F.col("Status") == LEASED)


def _available() -> Column:
    return count_where(F.col("Status") == AVAILABLE)


def _utilization_by(units: DataFrame, *keys: str) -> DataFrame:
    grouped = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_trailers"), _leased().alias("leased_trailers"))
    return grouped.withColumn("utilization", buckets.utilization(F.col("leased_trailers"), F.col("total_trailers")))


def global_utilization(trailers: DataFrame, *, branch: str | None = None) -> DataFrame:
    """One row for the rentable fleet; ``other_status`` can only be 0 here."""
    return fleet(trailers, branch).agg(
        F.count(F.lit(1)).alias("total_trailers"),
        _leased().alias("leased_trailers"),
        buckets.utilization(_leased(), F.count(F.lit(1))).alias("utilization"),
        _available().alias("available_trailers"),
        count_where(~F.col("Status").isin(AVAILABLE, LEASED)).alias("other_status"),
    )


def status_counts(trailers: DataFrame) -> DataFrame:
    """Units per status without the rentable filter."""
    return trailers.groupBy(F.col("Status").alias("status")).agg(F.count(F.lit(1)).alias("unit_count")).orderBy("status")


def _chosen(
    units: DataFrame, as_of: dt.datetime, type_bucket: str | None = None, usage_category: str | None = None
) -> DataFrame:
    """Units with their buckets, of the chosen type and age."""
    coded = with_buckets(units, "type_bucket", "usage_category", as_of=as_of)
    return where_equal(coded, type_bucket=type_bucket, usage_category=usage_category)


def utilization_by_branch(trailers: DataFrame, *, as_of: dt.datetime | None = None, **selection) -> DataFrame:
    """Per named branch; a ``type_bucket`` or ``usage_category`` needs ``as_of``."""
    units = rentable(trailers).where(named_branch(F.col("Fleetcity")))
    if any(map(is_set, selection.values())):
        if as_of is None:
            raise ValueError("a type or age needs as_of")
        units = _chosen(units, as_of, **selection)
    return _utilization_by(units.withColumnRenamed("Fleetcity", "branch"), "branch").orderBy("branch")


def utilization_by_type(
    trailers: DataFrame, *, as_of: dt.datetime, branch: str | None = None, **selection
) -> DataFrame:
    units = _chosen(fleet(trailers, branch), as_of, **selection)
    return _utilization_by(units, "type_bucket").orderBy(F.desc("total_trailers"), "type_bucket")


def utilization_by_usage(
    trailers: DataFrame, *, as_of: dt.datetime, branch: str | None = None, **selection
) -> DataFrame:
    units = _chosen(fleet(trailers, branch), as_of, **selection)
    return _utilization_by(units, "usage_category").orderBy("usage_category")


def utilization_matrix(
    trailers: DataFrame, *, as_of: dt.datetime, branch: str | None = None, **selection
) -> DataFrame:
    units = _chosen(fleet(trailers, branch), as_of, **selection)
    return _utilization_by(units, "type_bucket", "usage_category").orderBy("type_bucket", "usage_category")


def utilization_by_branch_type_age(trailers: DataFrame, *, as_of: dt.datetime) -> DataFrame:
    named = rentable(trailers).where(named_branch(F.col("Fleetcity")))
    units = with_buckets(named, "type_bucket", "usage_category", as_of=as_of)
    keys = ["branch", "type_bucket", "usage_category"]
    return _utilization_by(units.withColumnRenamed("Fleetcity", "branch"), *keys).orderBy(*keys)


def utilization_pivot(trailers: DataFrame, *, as_of: dt.datetime, branch: str | None = None) -> DataFrame:
    """Type rows by usage columns; a combination without units is null."""
    units = with_buckets(fleet(trailers, branch), "type_bucket", "usage_category", as_of=as_of)
    ratio = buckets.utilization(_leased(), F.count(F.lit(1)))
    return units.groupBy("type_bucket").pivot("usage_category", list(buckets.USAGE_ORDER)).agg(ratio).orderBy("type_bucket")


def usage_labelled(trailers: DataFrame, *, as_of: dt.datetime, branch: str | None = None) -> DataFrame:
    """Usage breakdown with display labels, youngest first."""
    by_usage = utilization_by_usage(trailers, as_of=as_of, branch=branch)
    order = F.array_position(F.array(*map(F.lit, buckets.USAGE_ORDER)), F.col("usage_category"))
    return by_usage.select(
        order.cast("int").alias("position"),
        "usage_category",
        formats.label(F.col("usage_category"), formats.USAGE_LABELS).alias("name"),
        "utilization",
        F.col("total_trailers").alias("total"),
        F.col("leased_trailers").alias("leased"),
    ).orderBy("position")


def length_labelled(trailers: DataFrame, *, as_of: dt.datetime, branch: str | None = None) -> DataFrame:
    """Utilization by length with display labels."""
    units = with_buckets(fleet(trailers, branch), "length_bucket", as_of=as_of)
    return (
        _utilization_by(units, "length_bucket")
        .select(
            "length_bucket",
            formats.label(F.col("length_bucket"), formats.LENGTH_LABELS).alias("name"),
            "utilization",
            F.col("total_trailers").alias("total"),
            F.col("leased_trailers").alias("leased"),
        )
        .orderBy("length_bucket")
    )


def type_chart(trailers: DataFrame, *, as_of: dt.datetime, branch: str | None = None) -> DataFrame:
    """Type breakdown under display names."""
    return utilization_by_type(trailers, as_of=as_of, branch=branch).select(
        formats.display_name(F.col("type_bucket")).alias("name"),
        "utilization",
        F.col("total_trailers").alias("total"),
        F.col("leased_trailers").alias("leased"),
    )


_LEVELS = {0b111: "global", 0b011: "branch", 0b101: "type", 0b110: "usage", 0b100: "matrix"}


def fleet_combined(trailers: DataFrame, *, as_of: dt.datetime, branch: str | None = None, **selection) -> DataFrame:
    """Global figures and four breakdowns from one scan, in long form.

    Units shrink to branch x type x usage counts first; the grouping sets
    expand only those.  Blank branches are left out of the branch breakdown
    but count in the others.
    """
    cells = (
        _chosen(fleet(trailers, branch), as_of, **selection)
        .groupBy(F.col("Fleetcity").alias("branch"), "type_bucket", "usage_category")
        .agg(F.count(F.lit(1)).alias("total"), _leased().alias("leased"), _available().alias("available"))
    )
    keys = ["branch", "type_bucket", "usage_category"]
    sets = [[], ["branch"], ["type_bucket"], ["usage_category"], ["type_bucket", "usage_category"]]
    level = F.element_at(F.create_map(*[F.lit(x) for pair in _LEVELS.items() for x in pair]), F.col("gid").cast("int"))
    return (
        cells.groupingSets(sets, *keys)
        .agg(
            F.grouping_id().alias("gid"),
            F.sum("total").alias("total_trailers"),
            F.sum("leased").alias("leased_trailers"),
            F.sum("available").alias("available_trailers"),
        )
        .select(
            level.alias("breakdown"),
            *keys,
            "total_trailers",
            "leased_trailers",
            "available_trailers",
            F.coalesce(buckets.utilization(F.col("leased_trailers"), F.col("total_trailers")), F.lit(0.0)).alias(
                "utilization"
            ),
        )
        .where((F.col("breakdown") != "branch") | (F.col("branch") != ""))
        .orderBy("breakdown", *keys)
    )


def fleet_combined_nested(trailers: DataFrame, *, as_of: dt.datetime, branch: str | None = None) -> DataFrame:
    """:func:`fleet_combined` as one row with an array per breakdown.

    The arrays hold one entry per branch, type, usage or cell, never units.
    """
    long = fleet_combined(trailers, as_of=as_of, branch=branch)

    def figure(name: str) -> Column:
        return F.max(F.when(F.col("breakdown") == "global", F.col(name)))

    def entries(breakdown: str, *keys: str) -> Column:
        entry = F.struct(*keys, "total_trailers", "leased_trailers")
        return F.array_sort(F.collect_list(F.when(F.col("breakdown") == breakdown, entry)))

    return long.agg(
        F.coalesce(figure("total_trailers"), F.lit(0)).alias("total_trailers"),
        figure("leased_trailers").alias("leased_trailers"),
        figure("available_trailers").alias("available_trailers"),
        entries("branch", "branch").alias("by_branch"),
        entries("type", "type_bucket").alias("by_type"),
        entries("usage", "usage_category").alias("by_usage"),
        entries("matrix", "type_bucket", "usage_category").alias("matrix"),
    )


def fleet_combined_json(trailers: DataFrame, *, as_of: dt.datetime, branch: str | None = None) -> DataFrame:
    """The nested form with its arrays as JSON text."""
    nested = fleet_combined_nested(trailers, as_of=as_of, branch=branch)
    texts = {name: F.to_json(name).alias(f"{name}_json") for name in ("by_branch", "by_type", "by_usage", "matrix")}
    return nested.select("total_trailers", "leased_trailers", "available_trailers", *texts.values())


BREAKDOWN_SCHEMAS = {
    "by_branch_json": "array<struct<branch:string,total_trailers:bigint,leased_trailers:bigint>>",
    "by_type_json": "array<struct<type_bucket:string,total_trailers:bigint,leased_trailers:bigint>>",
    "by_usage_json": "array<struct<usage_category:string,total_trailers:bigint,leased_trailers:bigint>>",
    "matrix_json": "array<struct<type_bucket:string,usage_category:string,total_trailers:bigint,leased_trailers:bigint>>",
}


def parse_breakdown(combined: DataFrame, column: str) -> DataFrame:
    """Rows of one JSON breakdown with their utilization; no text gives no rows."""
    parsed = F.from_json(F.coalesce(F.col(column), F.lit("[]")), BREAKDOWN_SCHEMAS[column])
    rows = combined.select(F.inline(parsed))
    ratio = buckets.utilization(F.col("leased_trailers"), F.col("total_trailers"))
    return rows.withColumn("utilization", F.coalesce(ratio, F.lit(0.0)))


def level_rows(statistics: DataFrame, branch: str | None) -> DataFrame:
    """Bucket-statistics rows of the whole fleet or of one branch."""
    level = "BY_BRANCH" if is_set(branch) else "GLOBAL"
    rows = statistics.where((F.col("AggLevel") == level) & not_placeholder(F.col("Branch")))
    return where_equal(rows, Branch=branch)


def _monthly(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.sum("NumRentedTrailers").alias("leased_trailers"),
        F.sum("NumTrailers").alias("total_trailers"),
        buckets.utilization(F.sum("NumRentedTrailers"), F.sum("NumTrailers")).alias("utilization"),
    )


def first_trend_month(as_of: dt.datetime) -> str:
    """The month twelve months before ``as_of``."""
    return moments.month_key(moments.shift_months(as_of, -12))


def utilization_trend(statistics: DataFrame, *, as_of: dt.datetime, branch: str | None = None) -> DataFrame:
    rows = level_rows(statistics, branch).where(F.col("Month") >= first_trend_month(as_of))
    return _monthly(rows, "Month").orderBy("Month")


def utilization_trend_by_branch(statistics: DataFrame, *, as_of: dt.datetime) -> DataFrame:
    branch = F.col("Branch")
    rows = statistics.where(
        (F.col("AggLevel") == "BY_BRANCH")
        & (F.col("Month") >= first_trend_month(as_of))
        & (branch != "ALL")
        & not_placeholder(branch)
    )
    return _monthly(rows.withColumnRenamed("Branch", "branch"), "Month", "branch").orderBy("Month", "branch")


def latest_two_months(statistics: DataFrame, *, branch: str | None = None) -> DataFrame:
    """Utilization of the two newest months that have data."""
    monthly = _monthly(level_rows(statistics, branch), "Month")
    return monthly.select("Month", "utilization").orderBy(F.desc("Month")).limit(2)


def mom_change(statistics: DataFrame, *, branch: str | None = None) -> DataFrame:
    """Newest minus second newest present month; null with fewer than two."""
    change = F.max_by("utilization", "Month") - F.min_by("utilization", "Month")
    return latest_two_months(statistics, branch=branch).agg(
        F.when(F.count(F.lit(1)) == 2, change).alias("mom_utilization_change")
    )


def gauge_percent(value: Column) -> Column:
    """Utilization in percent, kept between 0 and 100."""
    return F.least(F.greatest(value * 100, F.lit(0.0)), F.lit(100.0))


def utilization_display(trailers: DataFrame) -> DataFrame:
    """Headline texts of the fleet card."""
    value = F.coalesce("utilization", F.lit(0.0))
    return global_utilization(trailers).select(
        formats.format_percent(value).alias("value"),
        F.concat(
            formats.format_number(F.col("leased_trailers")),
            F.lit(" of "),
            formats.format_number(F.col("total_trailers")),
            F.lit(" on rent"),
        ).alias("subtitle"),
        status.utilization_status(value).alias("status"),
        gauge_percent(value).alias("gauge_percent"),
    )

"""Positions of leased units from the current-status GPS table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yardline.functions import buckets, formats, moments
from yardline.operators.selection import ACTIVE_LEASE, LEASED, is_set, where_equal
from yardline.plans.sizing import estimated_bytes, fits_broadcast
from yardline.plans.skew import split_join

MAP_LIMIT = 1000
STALE_LIMIT = 50
TOP_STATES = 15
#: Bytes of leases from which heavy units are counted and split.
MANY_LEASES = 64 << 20
STALE_AFTER = dt.timedelta(hours=24)


def leased_positions(
    trailers: DataFrame,
    leases: DataFrame,
    asset_statuses: DataFrame,
    *,
    in_force_at: dt.datetime | None = None,
    **selection,
) -> DataFrame:
    """Leased units with active leases and GPS columns, null without GPS row.

    Several leases of a unit give several rows.  With ``in_force_at`` the
    lease dates count too, not only the lease status.  Units and GPS rows, one
    each per unit, join first; the leases, where one unit may hold a large
    share of the rows, go through a single join: with broadcast units, or with
    heavy units in parts.
    ``selection`` may name a ``branch``, a ``type_bucket`` and a ``state``.
    """
    active = leases.where(F.col("LeaseStatus") == ACTIVE_LEASE)
    if in_force_at is not None:
        active = active.where(moments.in_force(F.col("DateOn"), F.col("DateOff"), in_force_at))
    return _with_positions(active.select("Unit", "CustomerID"), trailers, asset_statuses, **selection)


def _with_positions(
    active: DataFrame,
    trailers: DataFrame,
    asset_statuses: DataFrame,
    *,
    branch: str | None = None,
    type_bucket: str | None = None,
    state: str | None = None,
    rare_as_specialty: bool = True,
) -> DataFrame:
    gps = asset_statuses.withColumnRenamed("AssetName", "Unit")
    leased = where_equal(trailers.where(F.col("Status") == LEASED), Fleetcity=branch)
    if is_set(type_bucket):
        leased = leased.where(buckets.type_bucket(F.col("Type"), rare_as_specialty) == F.lit(type_bucket))
    units = where_equal(leased.join(gps, "Unit", "left"), State=state)
    if fits_broadcast(units, trailers, asset_statuses):
        return active.join(F.broadcast(units), "Unit")
    if estimated_bytes(active) >= MANY_LEASES:
        return split_join(active, units, "Unit")
    return active.join(units, "Unit")


def _counts_by_state(
    trailers: DataFrame, leases: DataFrame, asset_statuses: DataFrame, as_of: dt.datetime, **selection
) -> DataFrame:
    """Per state, and for no state, all rows, rows located under a lease in force, and stale rows, in one pass."""
    in_force = moments.in_force(F.col("DateOn"), F.col("DateOff"), as_of)
    active = leases.where(F.col("LeaseStatus") == ACTIVE_LEASE).select("Unit", in_force.alias("in_force"))
    located = F.col("in_force") & F.col("Latitude").isNotNull() & F.col("Longitude").isNotNull()
    return (
        _with_positions(active, trailers, asset_statuses, **selection)
        .groupBy(F.col("State").alias("state"))
        .agg(
            F.count(F.lit(1)).alias("unit_count"),
            F.count_if(located).alias("located"),
            F.count_if(_is_stale(as_of)).alias("stale"),
        )
    )


def _is_stale(as_of: dt.datetime) -> Column:
    seen = F.col("LastUpdate")
    return seen.isNull() | (seen < moments.moment(as_of - STALE_AFTER))


def _located(
    trailers: DataFrame, leases: DataFrame, asset_statuses: DataFrame, as_of: dt.datetime, **selection
) -> DataFrame:
    rows = leased_positions(trailers, leases, asset_statuses, in_force_at=as_of, **selection)
    return rows.where(F.col("Latitude").isNotNull() & F.col("Longitude").isNotNull())


def leased_locations(
    trailers: DataFrame,
    leases: DataFrame,
    asset_statuses: DataFrame,
    *,
    as_of: dt.datetime,
    rare_as_specialty: bool = True,
    limit: int | None = None,
    **selection,
) -> DataFrame:
    """Positions of units under a lease in force; ``limit`` takes the first units."""
    rows = _located(trailers, leases, asset_statuses, as_of, rare_as_specialty=rare_as_specialty, **selection).select(
        F.col("Unit").alias("unit"),
        F.col("Fleetcity").alias("branch"),
        F.col("CustomerID").alias("customer_id"),
        F.col("Latitude").alias("latitude"),
        F.col("Longitude").alias("longitude"),
        F.col("LastUpdate").alias("last_update"),
        F.col("Speed").alias("speed"),
        F.col("Heading").alias("heading"),
        F.col("Address").alias("address"),
        F.col("City").alias("gps_city"),
        F.col("State").alias("gps_state"),
        buckets.type_bucket(F.col("Type"), rare_as_specialty).alias("type_bucket"),
    )
    return rows if limit is None else rows.orderBy("unit", "customer_id").limit(limit)


def location_bounds(
    trailers: DataFrame, leases: DataFrame, asset_statuses: DataFrame, *, as_of: dt.datetime, **selection
) -> DataFrame:
    return _located(trailers, leases, asset_statuses, as_of, **selection).agg(
        F.min("Latitude").alias("south"),
        F.max("Latitude").alias("north"),
        F.min("Longitude").alias("west"),
        F.max("Longitude").alias("east"),
        F.count(F.lit(1)).alias("located_rows"),
    )


def locations_by_state(
    trailers: DataFrame, leases: DataFrame, asset_statuses: DataFrame, *, limit: int | None = None, **selection
) -> DataFrame:
    rows = leased_positions(trailers, leases, asset_statuses, **selection).where(F.col("State").isNotNull())
    states = rows.groupBy(F.col("State").alias("state")).agg(F.count(F.lit(1)).alias("unit_count"))
    states = states.orderBy(F.desc("unit_count"), "state")
    return states if limit is None else states.limit(limit)


def state_share(
    trailers: DataFrame,
    leases: DataFrame,
    asset_statuses: DataFrame,
    *,
    as_of: dt.datetime,
    limit: int | None = TOP_STATES,
    **selection,
) -> DataFrame:
    """Units per state against the located rows, in percent up to 100."""
    counts = _counts_by_state(trailers, leases, asset_statuses, as_of, **selection)
    located = F.sum("located").over(Window.partitionBy(F.lit(0)))
    percent = buckets.utilization(F.col("unit_count"), located) * 100
    states = (
        counts.withColumn("share_percent", F.least(percent, F.lit(100.0)))
        .where(F.col("state").isNotNull())
        .select("state", "unit_count", "share_percent")
        .orderBy(F.desc("unit_count"), "state")
    )
    return states if limit is None else states.limit(limit)


def stale_gps(
    trailers: DataFrame,
    leases: DataFrame,
    asset_statuses: DataFrame,
    *,
    as_of: dt.datetime,
    limit: int | None = None,
    ordered: bool = True,
    **selection,
) -> DataFrame:
    """Leased units without a GPS update in the last 24 hours, oldest first.

    Units that never reported come first. ``ordered=False`` leaves out the sort where no limit needs it.
    """
    seen = F.col("LastUpdate")
    rows = leased_positions(trailers, leases, asset_statuses, **selection)
    stale = rows.where(_is_stale(as_of)).select(
        F.col("Unit").alias("unit"),
        F.col("Fleetcity").alias("branch"),
        F.col("CustomerID").alias("customer_id"),
        seen.alias("last_update"),
        moments.hours_since(seen, as_of).alias("hours_since_update"),
        F.col("Address").alias("last_known_address"),
        F.col("City").alias("last_known_city"),
        F.col("State").alias("last_known_state"),
    )
    if ordered or limit is not None:
        stale = stale.orderBy(F.asc_nulls_first("last_update"), "unit", "customer_id")
    return stale if limit is None else stale.limit(limit)


def stale_gps_table(
    trailers: DataFrame,
    leases: DataFrame,
    asset_statuses: DataFrame,
    *,
    as_of: dt.datetime,
    limit: int = STALE_LIMIT,
    **selection,
) -> DataFrame:
    """The first stale rows with display texts."""
    return stale_gps(trailers, leases, asset_statuses, as_of=as_of, limit=limit, **selection).select(
        "unit",
        "branch",
        "customer_id",
        formats.hours_or_missing(F.col("hours_since_update")).alias("hours"),
        formats.place(F.col("last_known_city"), F.col("last_known_state")).alias("last_location"),
    )


def away_from_branch(
    trailers: DataFrame, leases: DataFrame, asset_statuses: DataFrame, *, ordered: bool = True, **selection
) -> DataFrame:
    """Home branch beside the current place, for every unit with a known state."""
    rows = leased_positions(trailers, leases, asset_statuses, **selection).where(F.col("State").isNotNull())
    places = rows.select(
        F.col("Unit").alias("unit"),
        F.col("Fleetcity").alias("home_branch"),
        F.col("City").alias("current_city"),
        F.col("State").alias("current_state"),
        F.col("CustomerID").alias("customer_id"),
    )
    return places.orderBy("home_branch", "current_state", "unit", "customer_id") if ordered else places


def location_cards(
    trailers: DataFrame, leases: DataFrame, asset_statuses: DataFrame, *, as_of: dt.datetime, **selection
) -> DataFrame:
    """Located rows, states covered, stale rows and the state with most units."""
    named = F.col("state").isNotNull()
    top = F.min(F.when(named, F.struct((-F.col("unit_count")).alias("negated"), "state")))
    total = lambda column: F.coalesce(F.sum(column), F.lit(0))
    return (
        _counts_by_state(trailers, leases, asset_statuses, as_of, **selection)
        .agg(
            total("located").alias("trailers_with_gps"),
            F.count("state").alias("states_covered"),
            top.alias("top"),
            total("stale").alias("stale_count"),
        )
        .select(
            "trailers_with_gps",
            "states_covered",
            F.col("top.state").alias("top_state"),
            (-F.col("top.negated")).alias("top_state_units"),
            "stale_count",
        )
    )


def location_detail(
    trailers: DataFrame,
    leases: DataFrame,
    asset_statuses: DataFrame,
    *,
    as_of: dt.datetime,
    **selection,
) -> DataFrame:
    """All located units with unit, lease and GPS columns, for the export."""
    return _located(trailers, leases, asset_statuses, as_of, **selection)

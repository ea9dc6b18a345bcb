"""Unit-month lease history, idle assets and bucket statistics.

The three views are ours to define.  A month is looked at on its last day, the
current month at ``as_of``; call that day ``d``:

* a unit is in the fleet when ``PurchaseDate <= d`` and it is not sold by ``d``;
* it is rented when a lease has ``DateOn <= d`` and no ``DateOff`` up to ``d``;
* otherwise it is idle, since its latest ``DateOff`` or, if it was never
  leased, since its purchase.

How it runs.  Leases shrink to one row per unit and starting month (partial
sums before the shuffle), so a unit that holds a third of all leases ends up
with at most one row per month.  Running sums over those rows give, for each
starting month, the state that holds until the next one.  Only then are the
months spelled out, by an ``explode`` that needs no shuffle.  Counts per month
need no unit-months at all: they sum where a state begins and ends.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yardline.functions import buckets, moments
from yardline.plans.units import rated_trailers

_OPEN_END = dt.date(9999, 12, 31)


def _started(leases: DataFrame, as_of: dt.datetime) -> DataFrame:
    return leases.where(F.col("DateOn") <= F.lit(as_of.date()))


def _end() -> Column:
    return F.coalesce(F.col("DateOff"), F.lit(_OPEN_END))


def lease_states(leases: DataFrame, *, as_of: dt.datetime, settled: DataFrame | None = None) -> DataFrame:
    """Per unit and lease-starting month: lease count and latest end so far.

    ``settled`` (``Unit, leases, latest_end``) stands for leases that are not
    among ``leases`` any more; they count as started before all others.
    """
    monthly = (
        _started(leases, as_of)
        .groupBy("Unit", moments.month_index(F.col("DateOn")).alias("start_month"))
        .agg(F.count(F.lit(1)).alias("leases"), F.max(_end()).alias("latest_end"))
    )
    if settled is not None:
        monthly = monthly.unionByName(settled.select("Unit", F.lit(0).alias("start_month"), "leases", "latest_end"))
    in_order = Window.partitionBy("Unit").orderBy("start_month")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return monthly.select(
        "Unit",
        "start_month",
        F.sum("leases").over(so_far).alias("cumulative_leases"),
        F.max("latest_end").over(so_far).alias("latest_end"),
        F.lag("start_month").over(in_order).isNull().alias("is_first"),
        F.lead("start_month").over(in_order).alias("next_month"),
    )


def _month_number(month: str | Column) -> Column:
    return F.lit(moments.index_of_key(month)) if isinstance(month, str) else month


def newest_fleet_month(trailers: DataFrame, *, as_of: dt.datetime) -> Column:
    """Index of the newest month in which any unit belongs to the fleet, as a scalar subquery."""
    first, last = _fleet_span(as_of, None)
    bought = trailers.where(F.col("PurchaseDate") <= F.lit(as_of.date()))
    return bought.where(first <= last).agg(F.max(last)).scalar()


def _fleet_span(as_of: dt.datetime, from_month: str | Column | None) -> tuple[Column, Column]:
    """First (not before ``from_month``) and last month index in which a unit belongs to the fleet."""
    today, current = F.lit(as_of.date()), moments.index_of_key(moments.month_key(as_of))
    bought, sold = F.col("PurchaseDate"), F.col("SoldDate")
    first = moments.month_index(bought)
    if from_month is not None:
        first = F.greatest(first, _month_number(from_month))
    last = F.when(sold <= today, moments.month_index(sold) - 1).otherwise(current)
    return first, last


def _states(
    units: DataFrame,
    leases: DataFrame,
    as_of: dt.datetime,
    from_month: str | Column | None,
    keep: Sequence[str],
    settled: DataFrame | None = None,
) -> DataFrame:
    """Fleet units with the months they belong to, and their lease states."""
    first, last = _fleet_span(as_of, from_month)
    spans = (
        units.where(F.col("PurchaseDate") <= F.lit(as_of.date()))
        .select("Unit", *keep, first.alias("first_month"), last.alias("last_month"))
        .where("first_month <= last_month")
    )
    return spans.join(lease_states(leases, as_of=as_of, settled=settled).hint("merge"), "Unit", "left")


def _lease_months() -> tuple[Column, Column]:
    """First and last month of a row of :func:`_states`; a unit's first row takes the months before its leases along."""
    is_first = F.coalesce("is_first", F.lit(True))
    low = F.when(is_first, F.col("first_month")).otherwise(F.greatest("start_month", "first_month"))
    return low, F.least(F.col("next_month") - 1, "last_month")


def _unit_days(months: DataFrame, as_of: dt.datetime, keep: Sequence[str]) -> DataFrame:
    """Rows of :func:`_states` with one ``month`` each: the day looked at and the leases by then."""
    started = F.col("month") >= F.col("start_month")
    day = F.least(F.last_day(moments.month_start(F.col("month"))), F.lit(as_of.date()))
    return months.select(
        "Unit",
        "PurchaseDate",
        *keep,
        "month",
        day.alias("day"),
        F.when(started, F.col("cumulative_leases")).otherwise(0).alias("cumulative_leases"),
        F.when(started, F.col("latest_end")).alias("latest_end"),
    )


def unit_months(
    units: DataFrame,
    leases: DataFrame,
    *,
    as_of: dt.datetime,
    from_month: str | None = None,
    keep: Sequence[str] = (),
    settled: DataFrame | None = None,
) -> DataFrame:
    """One row per fleet unit and month from its purchase, or ``from_month``, to ``as_of``.

    ``keep`` names unit columns to carry along.  ``latest_end`` is null and
    ``cumulative_leases`` 0 in the months before the first lease.

    The merge join is asked for: the lease side is already shuffled and sorted
    by unit, and the many months of a unit need the partitions of a shuffle,
    which a broadcast to a few unit files would not give.
    """
    states = _states(units, leases, as_of, from_month, ["PurchaseDate", *keep], settled)
    low, high = _lease_months()
    month = F.explode(F.when(low <= high, F.sequence(low, high)))
    return _unit_days(states.select("*", month.alias("month")), as_of, keep)


def _is_rented() -> Column:
    return F.coalesce(F.col("latest_end") > F.col("day"), F.lit(False))


_IDLE_KEEP = ("Fleetcity", "type_bucket", "usage_category", "length_bucket", "year_range", "Cost", "CardRateMonth")


def _idle_rows(rows: DataFrame, month_text: Column, edges: Sequence[int]) -> DataFrame:
    """Idle-asset columns of unit-day rows (``unit_months`` or one day)."""
    since = F.coalesce("latest_end", "PurchaseDate")
    months = F.col("month") - moments.month_index(since)
    return rows.where(~_is_rented()).select(
        month_text.alias("MonthStr"),
        "Unit",
        F.col("Fleetcity").alias("Branch"),
        F.col("type_bucket").alias("TypeBucket"),
        F.col("usage_category").alias("UsageCategory"),
        F.col("length_bucket").alias("LengthBucket"),
        F.col("year_range").alias("YearRange"),
        F.col("Cost").alias("AssetCost"),
        moments.month_of(F.col("latest_end")).alias("LastActiveMonth"),
        F.col("cumulative_leases").alias("CumulativeLeases"),
        months.alias("MonthsIdle"),
        buckets.idle_bucket(months, edges).alias("IdleDurationBucket"),
        F.col("CardRateMonth").alias("CardRate"),
    )


def idle_history(
    trailers: DataFrame,
    leases: DataFrame,
    card_rates: DataFrame,
    *,
    as_of: dt.datetime,
    from_month: str | None = None,
    edges: Sequence[int] = buckets.IDLE_EDGES,
    settled: DataFrame | None = None,
) -> DataFrame:
    """Idle units of every month since their purchase, or since ``from_month``.

    The price list joins before months are spelled out. ``settled``: see :func:`lease_states`.
    """
    units = rated_trailers(trailers, card_rates, as_of=as_of)
    rows = unit_months(units, leases, as_of=as_of, from_month=from_month, keep=_IDLE_KEEP, settled=settled)
    if from_month is None:
        return _idle_rows(rows, moments.month_of(moments.month_start(F.col("month"))), edges)
    first, last = moments.index_of_key(from_month), moments.index_of_key(moments.month_key(as_of))
    return _idle_rows(rows, moments.month_texts(F.col("month"), first, last), edges)


def fleet_units(trailers: DataFrame, *, as_of: dt.datetime) -> DataFrame:
    """Units bought by ``as_of`` and not sold by then."""
    today = F.lit(as_of.date())
    return trailers.where((F.col("PurchaseDate") <= today) & (F.col("SoldDate").isNull() | (F.col("SoldDate") > today)))


def _lease_order() -> Column:
    """Start date, then number, as one decimal: unlike a struct it needs no sort to aggregate."""
    day = F.unix_date("DateOn").cast("decimal(10,0)")
    return day * F.lit(f"1{0:020d}").cast("decimal(21,0)") + F.col("LeaseID").cast("decimal(20,0)")


def lease_totals(leases: DataFrame, *, as_of: dt.datetime) -> DataFrame:
    """Per unit: started leases, their latest end and the newest lease."""
    return (
        _started(leases, as_of)
        .groupBy("Unit")
        .agg(
            F.count(F.lit(1)).alias("leases"),
            F.max(_end()).alias("latest_end"),
            F.max_by("Rate", _lease_order()).alias("newest_rate"),
        )
    )


def idle_snapshot(
    trailers: DataFrame,
    leases: DataFrame,
    card_rates: DataFrame,
    *,
    as_of: dt.datetime,
    edges: Sequence[int] = buckets.IDLE_EDGES,
) -> DataFrame:
    """The ``as_of`` month of :func:`idle_history` without building the others.

    One aggregate per unit replaces the running sums: at ``as_of`` every
    started lease counts, so the count and the latest end are enough.
    """
    units = fleet_units(rated_trailers(trailers, card_rates, as_of=as_of), as_of=as_of).select(
        "Unit", "PurchaseDate", *_IDLE_KEEP
    )
    state = lease_totals(leases, as_of=as_of)
    rows = units.join(state, "Unit", "left").select(
        *units.columns,
        F.lit(moments.index_of_key(moments.month_key(as_of))).alias("month"),
        F.lit(as_of.date()).alias("day"),
        F.coalesce("leases", F.lit(0)).alias("cumulative_leases"),
        "latest_end",
    )
    return _idle_rows(rows, F.lit(moments.month_key(as_of)), edges)


def latest_month(history: DataFrame) -> DataFrame:
    """Rows of the newest month of a stored history (a pruned scan if partitioned)."""
    newest = history.agg(F.max("MonthStr")).scalar()
    return history.where(F.col("MonthStr") == newest)


def latest_idle_month(
    trailers: DataFrame,
    leases: DataFrame,
    card_rates: DataFrame,
    *,
    as_of: dt.datetime,
    edges: Sequence[int] = buckets.IDLE_EDGES,
) -> DataFrame:
    """The newest month of :func:`idle_history` that has a row, without building the others.

    Between two lease starts a unit is idle up to the last of those months or
    in none of them, and in the months before its first lease it is idle. So
    each row of the states has one newest idle month, and the rows of the
    newest of these are the answer: no month is spelled out.
    """
    units = rated_trailers(trailers, card_rates, as_of=as_of)
    states = _states(units, leases, as_of, None, ["PurchaseDate", *_IDLE_KEEP])
    low, high = _lease_months()
    day = F.least(F.last_day(moments.month_start(high)), F.lit(as_of.date()))
    leased_until = F.coalesce((high >= F.col("start_month")) & (F.col("latest_end") > day), F.lit(False))
    newest = F.when(~leased_until, high).otherwise(F.col("start_month") - 1)
    idle = states.select("*", F.when(newest >= low, newest).alias("month")).where("month IS NOT NULL")
    rows = idle.where(F.col("month") == idle.agg(F.max("month")).scalar())
    return _idle_rows(_unit_days(rows, as_of, _IDLE_KEEP), moments.month_of(moments.month_start(F.col("month"))), edges)


def bucket_statistics(
    trailers: DataFrame,
    leases: DataFrame,
    *,
    as_of: dt.datetime,
    from_month: str | Column | None = None,
    settled: DataFrame | None = None,
) -> DataFrame:
    """Fleet and rented units per month, for all branches and for each branch.

    With ``from_month`` (a key, or an index as a column) only months from there
    on, and only leases that have not ended before it are looked at.

    Units come and go, and are rented and free again, in few months: those
    changes are summed per month and branch, and running sums over that small
    result give the counts of every month.
    """
    if from_month is not None:
        since = moments.month_start(_month_number(from_month))
        leases = leases.where(F.col("DateOff").isNull() | (F.col("DateOff") > since))
    current = moments.index_of_key(moments.month_key(as_of))
    end = F.col("latest_end")
    rented_to = F.when(end > F.lit(as_of.date()), current).otherwise(moments.month_index(end) - 1)
    low = F.greatest("start_month", "first_month")
    high = F.least(F.col("next_month") - 1, "last_month", rented_to)

    def change(month: Column, units: int, rented: int) -> Column:
        return F.struct(month.alias("month"), F.lit(units).alias("units"), F.lit(rented).alias("rented"))

    of_unit = F.array(change(F.col("first_month"), 1, 0), change(F.col("last_month") + 1, -1, 0))
    of_lease = F.array(change(low, 0, 1), change(high + 1, 0, -1))
    none = F.array().cast("array<struct<month:int,units:int,rented:int>>")
    changes = F.concat(
        F.when(F.coalesce("is_first", F.lit(True)), of_unit).otherwise(none),
        F.when(F.col("start_month").isNotNull() & (low <= high), of_lease).otherwise(none),
    )
    summed = (
        _states(trailers, leases, as_of, from_month, ["Fleetcity"], settled)
        .select("Fleetcity", F.inline(changes))
        .groupBy("month", "Fleetcity")
        .agg(F.sum("units").alias("units"), F.sum("rented").alias("rented"))
    )
    in_order = Window.partitionBy("Fleetcity").orderBy("month")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.coalesce(F.lead("month").over(in_order) - 1, F.lit(current))
    by_branch = (
        summed.select("Fleetcity", "month", F.sum("units").over(so_far).alias("units"), F.sum("rented").over(so_far).alias("rented"), until.alias("until"))
        .where("units > 0 AND month <= until")
        .withColumn("month", F.explode(F.sequence("month", "until")))
    )
    level = F.grouping("Fleetcity")
    return (
        by_branch.groupingSets([["month"], ["month", "Fleetcity"]], "month", "Fleetcity")
        .agg(
            level.alias("all_branches"),
            F.sum("units").alias("NumTrailers"),
            F.sum("rented").alias("NumRentedTrailers"),
        )
        .select(
            moments.month_of(moments.month_start(F.col("month"))).alias("Month"),
            F.when(F.col("all_branches") == 1, "GLOBAL").otherwise("BY_BRANCH").alias("AggLevel"),
            F.when(F.col("all_branches") == 1, "ALL").otherwise(F.col("Fleetcity")).alias("Branch"),
            "NumTrailers",
            "NumRentedTrailers",
        )
    )

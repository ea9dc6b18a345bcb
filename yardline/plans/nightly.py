"""The stored views, kept up night by night without reading old leases again.

A folder holds the idle history and the bucket statistics by month, and the
lease state of each night:

* ``settled``: per unit, how many leases have ended and the latest end. They
  cannot change any more, so one row per unit is all that is kept of them;
* ``open``: the leases that run or are yet to start.

A night takes the leases that are new or changed since the night before,
settles those that have ended, and makes the months since the night before:
the settled leases are one row per unit there, only open and changed leases are
looked at one by one. The night is recorded last, so a night that failed is run
again from the same state. Running a recorded night again replaces it.

Months made earlier keep the bucket codes of their night. A lease that is told
only after it started, or changed after it ended, would alter months that are
made already: such leases are refused (:func:`late_leases` names them) and need
a new :func:`first_night`.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardline.functions import buckets, moments
from yardline.plans import store
from yardline.plans.lease_history import bucket_statistics, idle_history

LEASE = ["LeaseID", "Unit", "DateOn", "DateOff"]


class LateLeases(ValueError):
    """Changes that reach back before the last night."""


def split_leases(leases: DataFrame, *, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(ended by ``as_of``, counted per unit; the others, row by row)."""
    today = F.lit(as_of.date())
    ended = F.coalesce((F.col("DateOn") <= today) & (F.col("DateOff") <= today), F.lit(False))
    counted = leases.where(ended).groupBy("Unit").agg(F.count(F.lit(1)).alias("leases"), F.max("DateOff").alias("latest_end"))
    return counted, leases.where(~ended).select(*LEASE)


def pending(open_leases: DataFrame, changes: DataFrame) -> DataFrame:
    """Open leases with the changes in place of their old rows."""
    kept = open_leases.select(*LEASE).join(changes.select("LeaseID"), "LeaseID", "left_anti")
    return kept.select(*LEASE).unionByName(changes.select(*LEASE))


def add_settled(settled: DataFrame, ended: DataFrame) -> DataFrame:
    both = settled.unionByName(ended)
    return both.groupBy("Unit").agg(F.sum("leases").alias("leases"), F.max("latest_end").alias("latest_end"))


def late_leases(open_leases: DataFrame, changes: DataFrame, *, last_night: dt.date) -> DataFrame:
    """Changes that would alter months made by ``last_night``.

    A lease that started by then must be among the open ones, and neither its
    unit nor its start may change; its end may only come after that night.
    """
    before = open_leases.select("LeaseID", F.col("Unit").alias("old_unit"), F.col("DateOn").alias("old_on"))
    night = F.lit(last_night)
    touched = changes.join(before, "LeaseID", "left")
    same = (F.col("Unit") == F.col("old_unit")) & (F.col("DateOn") == F.col("old_on"))
    was_started = F.coalesce(F.col("old_on") <= night, F.lit(False))
    moved = was_started & ~F.coalesce(same, F.lit(False))
    told_late = (F.col("DateOn") <= night) & ~was_started
    ended_before = (F.col("DateOn") <= night) & F.coalesce(F.col("DateOff") <= night, F.lit(False))
    return touched.where(moved | told_late | ended_before).select(*LEASE)


def months_since(last_night: dt.date, as_of: dt.datetime) -> list[str]:
    """The months to make: from that of the day after the last night to the current one."""
    first = moments.index_of_key(moments.month_key(last_night + dt.timedelta(days=1)))
    last = moments.index_of_key(moments.month_key(as_of))
    return [f"{month // 12:04d}-{month % 12 + 1:02d}" for month in range(first, last + 1)]


def _state_path(folder: str, part: str, night: dt.date) -> str:
    return f"{folder.rstrip('/')}/state/{night.isoformat()}/{part}"


def idle_path(folder: str) -> str:
    return f"{folder.rstrip('/')}/idle"


def statistics_path(folder: str) -> str:
    return f"{folder.rstrip('/')}/statistics"


def _record(spark: SparkSession, folder: str, night: dt.date) -> None:
    """A folder per night whose one row says that all else of the night is written."""
    row = spark.range(1).select(F.lit(night).alias("done"))
    row.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/nights/night={night.isoformat()}")


def last_night(spark: SparkSession, folder: str, *, before: dt.date | None = None) -> dt.date | None:
    """The newest recorded night, or the newest one before a day."""
    try:
        nights = spark.read.schema("done date").parquet(f"{folder.rstrip('/')}/nights")
    except AnalysisException:
        return None
    chosen = nights if before is None else nights.where(F.col("done") < F.lit(before))
    return chosen.agg(F.max("done")).first()[0]


def load_state(spark: SparkSession, folder: str, night: dt.date) -> tuple[DataFrame, DataFrame]:
    """(settled, open) as they stood after a night."""
    return tuple(spark.read.parquet(_state_path(folder, part, night)) for part in ("settled", "open"))


def _save_state(folder: str, night: dt.date, settled: DataFrame, open_leases: DataFrame) -> None:
    settled.write.mode("overwrite").parquet(_state_path(folder, "settled", night))
    open_leases.write.mode("overwrite").parquet(_state_path(folder, "open", night))


def first_night(
    trailers: DataFrame,
    leases: DataFrame,
    card_rates: DataFrame,
    folder: str,
    *,
    as_of: dt.datetime,
    edges: Sequence[int] = buckets.IDLE_EDGES,
) -> None:
    """Build everything from all leases as they are known at ``as_of``."""
    store.save_idle_history(idle_history(trailers, leases, card_rates, as_of=as_of, edges=edges), idle_path(folder), rebuild=True)
    store.save_bucket_statistics(bucket_statistics(trailers, leases, as_of=as_of), statistics_path(folder), rebuild=True)
    _save_state(folder, as_of.date(), *split_leases(leases, as_of=as_of))
    _record(trailers.sparkSession, folder, as_of.date())


def next_night(
    spark: SparkSession,
    folder: str,
    trailers: DataFrame,
    changes: DataFrame,
    card_rates: DataFrame,
    *,
    as_of: dt.datetime,
    edges: Sequence[int] = buckets.IDLE_EDGES,
) -> list[str]:
    """Bring the folder from its last night to ``as_of``; the months made.

    ``changes`` holds the leases that are new or changed since then, each once
    as it is now.
    """
    before = last_night(spark, folder, before=as_of.date())
    if before is None:
        raise ValueError(f"{folder} has no night before {as_of.date()}")
    settled, open_leases = load_state(spark, folder, before)
    late = late_leases(open_leases, changes, last_night=before)
    if not late.isEmpty():
        raise LateLeases(f"{late.count()} leases reach back before {before}; run a first night")
    current = pending(open_leases, changes)
    months = months_since(before, as_of)
    made = {"as_of": as_of, "from_month": months[0], "settled": settled}
    store.replace_idle_months(idle_history(trailers, current, card_rates, edges=edges, **made), idle_path(folder), months)
    store.replace_statistics_months(bucket_statistics(trailers, current, **made), statistics_path(folder), months)
    ended, still_open = split_leases(current, as_of=as_of)
    _save_state(folder, as_of.date(), add_settled(settled, ended), still_open)
    _record(spark, folder, as_of.date())
    return months

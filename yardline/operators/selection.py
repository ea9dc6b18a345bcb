"""Filters shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unit statuses and the placeholder branch name.
AVAILABLE, LEASED = "AVAILABLE", "LEASED"
PLACEHOLDER_BRANCH = "TBD"
ACTIVE_LEASE = "ACTIVE"


def is_set(value: str | None) -> bool:
    """Whether an optional filter was chosen; ``all`` means no filter."""
    return value is not None and value != "all"


def where_equal(frame: DataFrame, **filters: str | None) -> DataFrame:
    """Equality filters for the chosen values, bound as literals."""
    for column, value in filters.items():
        if is_set(value):
            frame = frame.where(F.col(column) == F.lit(value))
    return frame


def rentable(trailers: DataFrame) -> DataFrame:
    return trailers.where(F.col("Status").isin(AVAILABLE, LEASED))


def not_placeholder(branch: Column) -> Column:
    """Drops the placeholder and, by three-valued logic, missing branches."""
    return branch != PLACEHOLDER_BRANCH


def named_branch(branch: Column) -> Column:
    return branch.isNotNull() & (branch != "") & not_placeholder(branch)


def fleet(trailers: DataFrame, branch: str | None = None) -> DataFrame:
    """Rentable units outside the placeholder branch."""
    return where_equal(rentable(trailers).where(not_placeholder(F.col("Fleetcity"))), Fleetcity=branch)


def units_of_branch(frame: DataFrame, trailers: DataFrame, branch: str | None) -> DataFrame:
    """Rows whose ``Unit`` belongs to the branch (semi join)."""
    if not is_set(branch):
        return frame
    units = where_equal(trailers, Fleetcity=branch).select("Unit")
    return frame.join(units, "Unit", "left_semi")


def count_where(condition: Column) -> Column:
    """Rows that meet the condition; null over no rows, like SUM(CASE ...)."""
    return F.sum(F.when(condition, 1).otherwise(0))


def one_row(*frames: DataFrame) -> DataFrame:
    """Side-by-side columns of frames that hold at most one row each.

    The rows are stacked with nulls for the missing columns and collapsed by
    ``max``, so nothing is joined without a key.
    """
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])

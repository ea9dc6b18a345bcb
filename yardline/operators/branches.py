"""Branch lists, branch key figures and fleet composition."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yardline.functions import buckets, status
from yardline.operators.selection import AVAILABLE, LEASED, count_where, fleet, named_branch, rentable, where_equal
from yardline.operators.utilization import utilization_by_branch
from yardline.plans.units import with_buckets

BOTTOM_BRANCHES = 5


def active_branches(trailers: DataFrame) -> DataFrame:
    return fleet(trailers).select(F.col("Fleetcity").alias("branch")).distinct().orderBy("branch")


def branch_summary(trailers: DataFrame, *, branch: str | None = None) -> DataFrame:
    """Per branch: unit counts, utilization and its most available type and length.

    Branch x type x length counts carry everything: they add up to the branch
    figures, and the smallest ``(-available, Type, Length)`` is the most
    available kind.  So there is one scan, no window and no join.
    """
    units = where_equal(rentable(trailers).where(named_branch(F.col("Fleetcity"))), Fleetcity=branch)
    kinds = units.groupBy(F.col("Fleetcity").alias("branch"), "Type", "Length").agg(
        F.count(F.lit(1)).alias("units"),
        count_where(F.col("Status") == LEASED).alias("leased"),
        count_where(F.col("Status") == AVAILABLE).alias("available"),
    )
    rank = F.struct((-F.col("available")).alias("negated"), "Type", "Length")
    return (
        kinds.groupBy("branch")
        .agg(
            F.sum("units").alias("total_trailers"),
            F.sum("leased").alias("leased_count"),
            F.sum("available").alias("available_count"),
            F.min(F.when(F.col("available") > 0, rank)).alias("top"),
        )
        .select(
            "branch",
            "total_trailers",
            "leased_count",
            "available_count",
            buckets.utilization(F.col("leased_count"), F.col("total_trailers")).alias("utilization"),
            F.col("top.Type").alias("most_available_type"),
            F.col("top.Length").alias("most_available_length"),
            (-F.col("top.negated")).alias("most_available_count"),
        )
        .orderBy("branch")
    )


def most_available_type(trailers: DataFrame) -> DataFrame:
    """The first kind per branch by available units, then type and length."""
    units = trailers.where((F.col("Status") == AVAILABLE) & named_branch(F.col("Fleetcity")))
    kinds = units.groupBy(F.col("Fleetcity").alias("branch"), "Type", "Length").agg(F.count(F.lit(1)).alias("type_count"))
    best_first = Window.partitionBy("branch").orderBy(F.desc("type_count"), "Type", "Length")
    return kinds.withColumn("rank", F.row_number().over(best_first)).where("rank = 1").orderBy("branch")


def branch_composition(trailers: DataFrame, *, as_of: dt.datetime) -> DataFrame:
    units = with_buckets(rentable(trailers).where(named_branch(F.col("Fleetcity"))), "type_bucket", as_of=as_of)
    return (
        units.groupBy(F.col("Fleetcity").alias("branch"), "type_bucket")
        .agg(F.count(F.lit(1)).alias("total_count"), count_where(F.col("Status") == LEASED).alias("leased_count"))
        .orderBy("branch", "type_bucket")
    )


def branch_status(trailers: DataFrame) -> DataFrame:
    """Branches, best utilization first, with status and display class."""
    value = F.col("utilization")
    return (
        utilization_by_branch(trailers)
        .select(
            "branch",
            "utilization",
            status.utilization_status(value).alias("status"),
            status.utilization_class(value).alias("utilization_class"),
        )
        .orderBy(F.desc("utilization"), "branch")
    )


def bottom_branches(trailers: DataFrame, *, limit: int = BOTTOM_BRANCHES) -> DataFrame:
    return utilization_by_branch(trailers).orderBy("utilization", "branch").limit(limit)

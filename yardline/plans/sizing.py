"""A broadcast that is asked for only after a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Estimates of file sources count compressed bytes; rows in memory take more.
DECODED = 3


def estimated_bytes(frame: DataFrame) -> int:
    """Catalyst's size estimate of a frame; unknown sizes are huge."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(frame: DataFrame) -> int:
    """The session's ``spark.sql.autoBroadcastJoinThreshold`` in bytes."""
    return frame.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def fits_broadcast(frame: DataFrame, *measures: DataFrame) -> bool:
    """Whether :func:`broadcast_if_small` would give a hint."""
    if not hasattr(frame, "_jdf"):
        return False  # A remote session does not show the estimate: no hint.
    return DECODED * sum(estimated_bytes(table) for table in measures or (frame,)) <= broadcast_limit(frame)


def broadcast_if_small(frame: DataFrame, *measures: DataFrame) -> DataFrame:
    """Mark the dimension side of a join, if Spark's own limit allows it.

    Between two small tables Spark may pick either as the broadcast side; the
    hint settles it for the dimension.  Beyond the limit there is no hint: the
    join shuffles, and adaptive execution splits skewed partitions.

    ``measures`` are the tables whose rows ``frame`` puts together, for frames
    that went through lookup joins: Catalyst estimates a join as the product
    of its sides, although a lookup adds no rows.
    """
    return F.broadcast(frame) if fits_broadcast(frame, *measures) else frame

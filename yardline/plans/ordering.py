"""A whole order without a total sort.

A range sort samples its input, that is, it runs everything below a second
time. Where the first key is a date, the place of a row follows from the date:
the days between the newest and the oldest are cut into steps, each step is
one task that sorts its own rows, and the tasks in turn give the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEP = "_step"


def default_steps(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def newest_first(frame: DataFrame, day: str, order: Sequence[Column | str], *, steps: int | None = None) -> DataFrame:
    """Rows in the order ``day`` descending, then ``order``; null days last.

    The bounds are the least and greatest ``day``, for which Spark scans that
    column alone. A day is not split, so more steps than days do not help.
    """
    parts = steps or default_steps(frame)
    newest, oldest = frame.agg(F.max(day)).scalar(), frame.agg(F.min(day)).scalar()
    span = F.date_diff(newest, oldest) + 1
    step = F.floor(F.date_diff(newest, F.col(day)).cast("long") * parts / span).cast("int")
    dealt = frame.withColumn(_STEP, F.coalesce(step, F.lit(parts - 1))).repartitionById(parts, F.col(_STEP))
    return dealt.drop(_STEP).sortWithinPartitions(F.col(day).desc_nulls_last(), *order)

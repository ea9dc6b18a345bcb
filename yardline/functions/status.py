"""Traffic-light classes of KPI values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from yardline.functions.cases import first_match

# Lowest good and lowest warning value.
UTILIZATION = (0.80, 0.60)
RATE_VARIANCE = (0.0, -0.10)
GROWTH = (0.05, 0.0)
# Highest good and highest warning number of months.
IDLE_MONTHS = (6, 12)
# Lowest utilization of each display class.
UTILIZATION_CLASSES = (("full", 0.8), ("high", 0.7), ("mid", 0.6), ("low", 0.4))


def _at_least(value: Column, limits: tuple[float, float]) -> Column:
    good, warning = limits
    return F.when(value >= good, "good").when(value >= warning, "warning").otherwise("critical")


def utilization_status(value: Column) -> Column:
    return _at_least(value, UTILIZATION)


def rate_status(variance: Column) -> Column:
    return _at_least(variance, RATE_VARIANCE)


def growth_status(growth: Column) -> Column:
    return _at_least(growth, GROWTH)


def idle_status(months: Column) -> Column:
    good, warning = IDLE_MONTHS
    return F.when(months <= good, "good").when(months <= warning, "warning").otherwise("critical")


def utilization_class(value: Column) -> Column:
    return first_match([(value >= lowest, name) for name, lowest in UTILIZATION_CLASSES], otherwise="empty")


def either(condition: Column, yes: str, no: str) -> Column:
    """``yes`` where the condition holds; ``no`` otherwise, also for null."""
    return F.when(condition, yes).otherwise(no)

"""Bucket codes of units, idle times and rate variances."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from yardline.functions.cases import first_match

# Equipment types that count as specialty.
RARE_TYPES = (
    "CHASSIS",
    "CONGEAR",
    "CURTAIN",
    "DROPDECK",
    "ELECTRIC STANDBY UNIT",
    "REEFER ELECTRIC STANDBY UNIT",
    "SEE COMMENTS",
    "MOVE VAN",
    "STEPDECK",
    "PUP",
    "PUP VAN",
)

# Type text to bucket code.
TYPE_CODES = {
    "DRY_VAN": ("VAN", "DRY VAN"),
    "DRY_VAN_LIFTGATE": ("VAN LIFTGATE", "LIFTGATE"),
    "REEFER_LIFTGATE": ("REEFER LIFTGATE",),
}

# Youngest and oldest age of each usage category.
USAGE_AGES = (
    ("OTR_0", 0, 3),
    ("OTR_1", 4, 6),
    ("OTR_2", 7, 8),
    ("CART_1", 9, 12),
    ("CART_2", 13, 16),
)
OLDEST_USAGE = "STORAGE"
USAGE_ORDER = tuple(code for code, _, _ in USAGE_AGES) + (OLDEST_USAGE,)

# Longest length in feet of each length code, the last is open.
LENGTH_LIMITS = (("20", 27), ("28-32", 32), ("40", 42), ("48", 50))
LONGEST = "53"

IDLE_EDGES = (6, 12, 24)
CRITICAL_IDLE = "24+ Months"

# Names of the billed-to-card variance classes.
NO_CARD_RATE = "No Card Rate"
AT_OR_ABOVE = "At or Above Card"
WITHIN_10 = "Within 10%"
BELOW_10_20 = "10-20% Below"
BELOW_20 = "More than 20% Below"


def type_bucket(kind: Column, rare_as_specialty: bool = True) -> Column:
    """Bucket of a type text; unknown texts keep their trimmed form.

    ``rare_as_specialty=False`` is the short form used by the detail exports,
    where only missing types are specialty.
    """
    text = F.trim(kind)
    specialty = kind.isNull() | (text == "")
    if rare_as_specialty:
        specialty = specialty | text.isin(*RARE_TYPES)
    coded = [(text.isin(*texts), code) for code, texts in TYPE_CODES.items()]
    return first_match([(specialty, "SPECIALTY"), *coded], otherwise=text)


def unit_age(year: Column, as_of: dt.datetime) -> Column:
    """Age in calendar years; null when the year text is no number."""
    return F.lit(as_of.year) - year.try_cast("int")


def usage_category(year: Column, as_of: dt.datetime) -> Column:
    """Age band; a negative or unknown age counts as the oldest."""
    age = unit_age(year, as_of)
    bands = [(age <= oldest, code) for code, _, oldest in USAGE_AGES]
    return first_match([(age < 0, OLDEST_USAGE), *bands], otherwise=OLDEST_USAGE)


def year_range(year: Column, as_of: dt.datetime) -> Column:
    """Model-year band of the usage category, such as ``1998-2001``."""
    age = unit_age(year, as_of)
    bands = [
        (age <= oldest, f"{as_of.year - oldest}-{as_of.year - youngest}") for _, youngest, oldest in USAGE_AGES
    ]
    oldest_banded = USAGE_AGES[-1][2]
    return first_match(
        [(age < 0, f"After {as_of.year}"), *bands, (age > oldest_banded, f"Before {as_of.year - oldest_banded}")]
    )


def length_bucket(length: Column) -> Column:
    """Length code; foot marks are dropped, a blank counts as 0, no number as longest."""
    digits = F.replace(length, F.lit("'"), F.lit(""))
    feet = F.when(F.trim(digits) == "", F.lit(0)).otherwise(digits.try_cast("int"))
    return first_match([(feet <= limit, name) for name, limit in LENGTH_LIMITS], otherwise=LONGEST)


def idle_label(low: int, high: int | None) -> str:
    return f"{low}+ Months" if high is None else f"{low}-{high} Months"


def idle_labels(edges: Sequence[int] = IDLE_EDGES) -> list[str]:
    lows = [0, *edges]
    return [idle_label(low, high) for low, high in zip(lows, [*edges, None])]


def idle_bucket(months: Column, edges: Sequence[int] = IDLE_EDGES) -> Column:
    """Half-open duration buckets: 6 months falls into ``6-12 Months``."""
    *closed, last = idle_labels(edges)
    return first_match([(months < high, label) for label, high in zip(closed, edges)], otherwise=last)


def idle_bucket_order(bucket: Column, edges: Sequence[int] = IDLE_EDGES) -> Column:
    """Sort key of a duration bucket; an unknown bucket comes last."""
    labels = idle_labels(edges)
    position = F.array_position(F.array(*map(F.lit, labels)), bucket)
    return F.when(position > 0, position).otherwise(len(labels) + 1)


def idle_bucket_name(value: str) -> str:
    """Accept ``0-6`` as well as ``0-6 Months``."""
    return value if value.endswith(" Months") else f"{value} Months"


def utilization(leased: Column, total: Column) -> Column:
    """Leased share as double, null for an empty group."""
    return leased.cast("double") / F.nullif(total, F.lit(0))


def variance_pct(billed: Column, card: Column) -> Column:
    """Billed minus card over card, as double; null without a positive card rate."""
    return F.when(card > 0, (billed - card).cast("double") / F.nullif(card, F.lit(0)).cast("double"))


def variance_bucket(billed: Column, card: Column) -> Column:
    """Class of a billed rate against its card rate.

    The edges are compared in exact decimals (``(b - c) / c >= -0.10`` becomes
    ``10 * (b - c) >= -c``), so a rate exactly 10% below is "within 10%".
    """
    gap = billed - card
    return (
        F.when(card.isNull(), NO_CARD_RATE)
        .when(gap >= 0, AT_OR_ABOVE)
        .when(gap * 10 >= -card, WITHIN_10)
        .when(gap * 5 >= -card, BELOW_10_20)
        .otherwise(BELOW_20)
    )

"""Exact sums of money on longs.

Spark adds up decimals of more than eight digits as objects. Amounts of up to
18 digits and two places fit a long as cents; two running sums, of thousand
millions of cents and of the rest, hold any number of them without overflow and
join to one decimal at the end. Wider amounts are summed as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

_LIMB = 1_000_000_000
#: Below this a double holds an amount's cents exactly.
_EXACT = 10**13


def _is_narrow(frame: DataFrame, name: str) -> bool:
    kind = frame.schema[name].dataType
    return isinstance(kind, DecimalType) and kind.precision <= 18 and kind.scale <= 2


def cents(amount: Column) -> Column:
    """The cents of a decimal of up to 18 digits and two places."""
    quick = F.rint(amount.cast("double") * 100).cast("bigint")
    return F.when(F.abs(amount) < _EXACT, quick).otherwise((amount * 100).cast("bigint"))


def total(frame: DataFrame, name: str, where: Column | None = None) -> Column:
    """Sum of an amount column of ``frame`` over the rows that ``where`` chooses: null without any, else an exact decimal."""
    amount = F.col(name) if where is None else F.when(where, F.col(name))
    if not _is_narrow(frame, name):
        return F.sum(amount)
    whole = cents(amount)
    high, low = F.sum(F.call_function("div", whole, F.lit(_LIMB).cast("bigint"))), F.sum(whole % _LIMB)
    joined = high.cast("decimal(19,0)") * F.lit(_LIMB).cast("decimal(10,0)") + low.cast("decimal(19,0)")
    return (joined.cast("decimal(30,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(28,2)")


def mean(frame: DataFrame, name: str, where: Column | None = None) -> Column:
    """Mean of an amount column, taken from its exact sum, as a double of six places."""
    amount = F.col(name) if where is None else F.when(where, F.col(name))
    if not _is_narrow(frame, name):
        return F.avg(amount).cast("double")
    return mean_of(total(frame, name, where), F.count(amount))


def mean_of(sum_: Column, count: Column) -> Column:
    return (sum_ / F.nullif(count, F.lit(0)).cast("decimal(20,0)")).cast("decimal(38,6)").cast("double")

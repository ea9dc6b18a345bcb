"""Calendar helpers around an explicit ``as_of`` moment."""

from __future__ import annotations

import datetime as dt
from calendar import monthrange

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIOD_MONTHS = {"L3M": 3, "L6M": 6}
DEFAULT_PERIOD_MONTHS = 12
_EPOCH_MONTH = 1970 * 12


def moment(value: dt.datetime) -> Column:
    """A timestamp literal without time zone."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def shift_months(value: dt.datetime, months: int) -> dt.datetime:
    """``value`` moved by whole months; the day is clamped to the month's end."""
    year, month0 = divmod(value.year * 12 + value.month - 1 + months, 12)
    return value.replace(year=year, month=month0 + 1, day=min(value.day, monthrange(year, month0 + 1)[1]))


def month_key(value: dt.datetime | dt.date) -> str:
    return f"{value.year:04d}-{value.month:02d}"


def month_of(date: Column) -> Column:
    """'yyyy-MM' of a date or timestamp column."""
    return F.date_format(date, "yyyy-MM")


def month_begin(date: Column) -> Column:
    """First day of the month: the cheap key to group by before ``month_of``."""
    return F.trunc(date, "month")


def month_texts(index: Column, first: int, last: int) -> Column:
    """'yyyy-MM' of a month index between two known ones, by table lookup.

    Formatting a date costs more than the rest of a unit-month row.
    """
    texts = [f"{month // 12:04d}-{month % 12 + 1:02d}" for month in range(first, last + 1)]
    return F.element_at(F.lit(texts), index - (first - 1))


def next_month(month: Column) -> Column:
    """The 'yyyy-MM' key after a 'yyyy-MM' key."""
    return month_of(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), 1))


def month_index(date: Column) -> Column:
    """Months since year 0; differences count calendar months."""
    return F.year(date) * 12 + F.month(date) - 1


def index_of_key(key: str) -> int:
    year, month = key.split("-")
    return int(year) * 12 + int(month) - 1


def month_start(index: Column) -> Column:
    """First day of the month with this index."""
    return F.add_months(F.lit("1970-01-01").cast("date"), index - _EPOCH_MONTH)


def period_months(period: str, as_of: dt.datetime) -> int:
    """Length of a named period; YTD is the number of months so far this year."""
    if period == "YTD":
        return as_of.month
    return PERIOD_MONTHS.get(period, DEFAULT_PERIOD_MONTHS)


def hours_since(ts: Column, as_of: dt.datetime) -> Column:
    """Hour boundaries between ``ts`` and ``as_of`` (10:59 to 11:01 counts 1).

    Taken from the date and the hour, so it does not depend on a time zone.
    """
    days = F.date_diff(F.lit(as_of.date()), ts.cast("date"))
    return days.cast("bigint") * 24 + F.lit(as_of.hour) - F.hour(ts)


def on_or_after(date: Column, value: dt.datetime) -> Column:
    """Whether a DATE, taken at midnight, is at or after a moment.

    Compared as dates, so the test reaches the scan.
    """
    day = F.lit(value.date())
    return date >= day if value.time() == dt.time() else date > day


def before(date: Column, value: dt.datetime) -> Column:
    """Whether a DATE, taken at midnight, is before a moment."""
    return ~on_or_after(date, value)


def in_force(date_on: Column, date_off: Column, as_of: dt.datetime) -> Column:
    """The date test of a lease that runs at ``as_of`` (DATE columns)."""
    today = F.lit(as_of.date())
    return (date_on <= today) & (date_off.isNull() | (date_off > today))

"""Display texts.  They end reports; no query computes with them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display labels of the codes.
USAGE_LABELS = {
    "OTR_0": "OTR 0-3yr",
    "OTR_1": "OTR 4-6yr",
    "OTR_2": "OTR 7-8yr",
    "CART_1": "Cartage 9-12yr",
    "CART_2": "Cartage 13-16yr",
    "STORAGE": "Storage 16+yr",
    "SPECIALTY": "Specialty",
}
TYPE_LABELS = {
    "DRY_VAN": "Dry Van",
    "DRY_VAN_LIFTGATE": "Dry Van Liftgate",
    "REEFER": "Reefer",
    "REEFER_LIFTGATE": "Reefer Liftgate",
    "FLATBED": "Flatbed",
    "SPECIALTY": "Specialty",
}
LENGTH_LABELS = {"20": "20'", "28-32": "28-32'", "40": "40'", "48": "48'", "53": "53'"}
IDLE_LABELS = {"0-6": "0-6 Months", "6-12": "6-12 Months", "12-24": "12-24 Months", "24+": "24+ Months"}
PERIOD_LABELS = {
    "LTM": "Last 12 Months",
    "YTD": "Year to Date",
    "LQA": "Last Quarter (Annualized)",
    "L3M": "Last 3 Months",
    "L6M": "Last 6 Months",
}


def label(code: Column, labels: Mapping[str, str]) -> Column:
    """Label of a code; a code without label stays as it is."""
    pairs = [F.lit(text) for pair in labels.items() for text in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)


def _pattern(value: Column, pattern: str) -> Column:
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def format_number(value: Column) -> Column:
    """Thousands separators and up to three decimals."""
    return _pattern(value, "#,##0.###")


def format_currency(value: Column, decimals: int = 0) -> Column:
    rounded = F.round(value, decimals)
    sign = F.when(rounded < 0, "-").otherwise("")
    return F.concat(sign, F.lit("$"), F.format_number(F.abs(rounded), decimals))


def format_percent(value: Column, decimals: int = 1) -> Column:
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.concat(_pattern(value.cast("double") * 100, pattern), F.lit("%"))


def display_name(code: Column) -> Column:
    """The first underscore of a code as a space."""
    return F.regexp_replace(code, "^([^_]*)_", "$1 ")


def last_active(month: Column) -> Column:
    return F.coalesce(month, F.lit("Never"))


def card_rate_or_dash(rate: Column) -> Column:
    return F.when(rate != 0, format_currency(rate)).otherwise("—")


def place(city: Column, state: Column) -> Column:
    """'City, State' when both are known."""
    known = (city != "") & (state != "")
    return F.when(known, F.concat_ws(", ", city, state)).otherwise("Unknown")


def hours_or_missing(hours: Column) -> Column:
    return F.when(hours != 0, hours.cast("string")).otherwise("N/A")

"""Edge rows of every column function."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from frames import AS_OF, money
from yardline.functions import buckets, formats, moments, status


def values(spark, kind, inputs, column):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [row[0] for row in frame.orderBy("i").select(column).collect()]


def test_type_bucket(spark):
    texts = [None, "", "  ", "CHASSIS", " PUP VAN ", "VAN", " DRY VAN ", "VAN LIFTGATE", "LIFTGATE", "REEFER LIFTGATE"]
    texts += [" FLATBED ", "van"]
    expected = ["SPECIALTY"] * 5 + ["DRY_VAN"] * 2 + ["DRY_VAN_LIFTGATE"] * 2 + ["REEFER_LIFTGATE", "FLATBED", "van"]
    assert values(spark, "string", texts, buckets.type_bucket(F.col("x"))) == expected
    short = values(spark, "string", texts, buckets.type_bucket(F.col("x"), rare_as_specialty=False))
    assert short[:5] == ["SPECIALTY"] * 3 + ["CHASSIS", "PUP VAN"] and short[5:] == expected[5:]


def test_every_rare_type_is_specialty(spark):
    assert set(values(spark, "string", buckets.RARE_TYPES, buckets.type_bucket(F.col("x")))) == {"SPECIALTY"}
    assert len(buckets.RARE_TYPES) == 11


def test_usage_category(spark):
    ages = [-1, 0, 3, 4, 6, 7, 8, 9, 12, 13, 16, 17]
    years = [str(AS_OF.year - age) for age in ages] + ["N/A", "", "2000.0", None]
    expected = ["STORAGE", "OTR_0", "OTR_0", "OTR_1", "OTR_1", "OTR_2", "OTR_2", "CART_1", "CART_1", "CART_2", "CART_2"]
    assert values(spark, "string", years, buckets.usage_category(F.col("x"), AS_OF)) == expected + ["STORAGE"] * 5


def test_year_range(spark):
    years = ["2002", "2001", "1998", "1997", "1985", "1984", "N/A"]
    expected = ["After 2001", "1998-2001", "1998-2001", "1995-1997", "1985-1988", "Before 1985", None]
    assert values(spark, "string", years, buckets.year_range(F.col("x"), AS_OF)) == expected


def test_length_bucket(spark):
    lengths = ["27", "28", "32", "33", "42", "43", "50", "51", "53'", "28'", "", "'", None, "long"]
    expected = ["20", "28-32", "28-32", "40", "40", "48", "48", "53", "53", "28-32", "20", "20", "53", "53"]
    assert values(spark, "string", lengths, buckets.length_bucket(F.col("x"))) == expected


def test_idle_bucket(spark):
    months = [0, 5, 6, 11, 12, 23, 24, 100]
    expected = ["0-6 Months"] * 2 + ["6-12 Months"] * 2 + ["12-24 Months"] * 2 + ["24+ Months"] * 2
    assert values(spark, "int", months, buckets.idle_bucket(F.col("x"))) == expected
    coarse = values(spark, "int", months, buckets.idle_bucket(F.col("x"), (12, 24)))
    assert coarse == ["0-12 Months"] * 4 + ["12-24 Months"] * 2 + ["24+ Months"] * 2


def test_idle_bucket_order_puts_unknown_last(spark):
    names = ["24+ Months", "0-6 Months", "other", "12-24 Months", "6-12 Months"]
    assert values(spark, "string", names, buckets.idle_bucket_order(F.col("x"))) == [4, 1, 5, 3, 2]


def test_idle_bucket_name_takes_both_forms():
    assert buckets.idle_bucket_name("0-6") == buckets.idle_bucket_name("0-6 Months") == "0-6 Months"


def test_utilization_of_nothing_is_null(spark):
    assert values(spark, "bigint", [0, 4], buckets.utilization(F.lit(1), F.col("x"))) == [None, 0.25]


@pytest.mark.parametrize(
    "billed, card, pct, bucket",
    [
        (1000, 1000, 0.0, buckets.AT_OR_ABOVE),
        (1200, 1000, 0.2, buckets.AT_OR_ABOVE),
        (900, 1000, -0.1, buckets.WITHIN_10),
        (899.99, 1000, -0.10001, buckets.BELOW_10_20),
        (800, 1000, -0.2, buckets.BELOW_10_20),
        (799.99, 1000, -0.20001, buckets.BELOW_20),
        (500, None, None, buckets.NO_CARD_RATE),
        (500, 0, None, buckets.AT_OR_ABOVE),
        (-1, 0, None, buckets.BELOW_20),
    ],
)
def test_variance(spark, billed, card, pct, bucket):
    frame = spark.createDataFrame([(money(billed), money(card))], "b decimal(8,2), c decimal(8,2)")
    row = frame.select(
        buckets.variance_pct(F.col("b"), F.col("c")), buckets.variance_bucket(F.col("b"), F.col("c"))
    ).first()
    assert row[0] == (None if pct is None else pytest.approx(pct))
    assert row[1] == bucket


def test_statuses(spark):
    x = F.col("x")
    assert values(spark, "double", [0.8, 0.79, 0.6, 0.59, None], status.utilization_status(x)) == [
        "good",
        "warning",
        "warning",
        "critical",
        "critical",
    ]
    assert values(spark, "double", [0.0, -0.1, -0.11], status.rate_status(x)) == ["good", "warning", "critical"]
    assert values(spark, "double", [0.05, 0.0, -0.01], status.growth_status(x)) == ["good", "warning", "critical"]
    assert values(spark, "double", [6.0, 6.1, 12.0, 24.0], status.idle_status(x)) == [
        "good",
        "warning",
        "warning",
        "critical",
    ]
    assert values(spark, "double", [0.8, 0.7, 0.6, 0.4, 0.39], status.utilization_class(x)) == [
        "full",
        "high",
        "mid",
        "low",
        "empty",
    ]
    assert values(spark, "int", [1, None], status.either(F.col("x") > 0, "yes", "no")) == ["yes", "no"]


def test_moments(spark):
    assert moments.shift_months(dt.datetime(2024, 3, 31, 8), -1) == dt.datetime(2024, 2, 29, 8)
    assert moments.shift_months(dt.datetime(2001, 1, 15), -13) == dt.datetime(1999, 12, 15)
    assert moments.month_key(AS_OF) == "2001-11"
    assert [moments.period_months(p, AS_OF) for p in ("L3M", "L6M", "LTM", "YTD", "LQA")] == [3, 6, 12, 11, 12]
    months = ["2001-11", "2001-12"]
    assert values(spark, "string", months, moments.next_month(F.col("x"))) == ["2001-12", "2002-01"]
    index = moments.index_of_key("2001-11")
    assert values(spark, "int", [index], moments.month_of(moments.month_start(F.col("x")))) == ["2001-11"]
    assert values(spark, "int", [index, index - 11], moments.month_texts(F.col("x"), index - 11, index)) == [
        "2001-11",
        "2000-12",
    ]


def test_hours_since_counts_boundaries(spark):
    times = [dt.datetime(2001, 11, 15, 11, 59), dt.datetime(2001, 11, 14, 12, 1), None]
    assert values(spark, "timestamp_ntz", times, moments.hours_since(F.col("x"), AS_OF)) == [1, 24, None]


def test_in_force(spark):
    rows = [
        ("2001-11-15", None, True),
        ("2001-11-16", None, False),
        ("2001-01-01", "2001-11-15", False),
        ("2001-01-01", "2001-11-16", True),
    ]
    frame = spark.createDataFrame([(a, b) for a, b, _ in rows], "a string, b string").select(
        F.to_date("a").alias("a"), F.to_date("b").alias("b")
    )
    assert [r[0] for r in frame.select(moments.in_force(F.col("a"), F.col("b"), AS_OF)).collect()] == [
        expected for *_, expected in rows
    ]


def test_formats(spark):
    x = F.col("x")
    assert values(spark, "double", [1234.5, -1234.5, 0.4], formats.format_currency(x)) == ["$1,235", "-$1,235", "$0"]
    assert values(spark, "double", [12.345], formats.format_currency(x, 2)) == ["$12.35"]
    assert values(spark, "double", [0.1234, -0.05, 12.0], formats.format_percent(x)) == ["12.3%", "-5.0%", "1200.0%"]
    assert values(spark, "double", [0.5], formats.format_percent(x, 0)) == ["50%"]
    assert values(spark, "double", [1234567.0, 1.5], formats.format_number(x)) == ["1,234,567", "1.5"]
    assert values(spark, "string", ["DRY_VAN_LIFTGATE", "REEFER"], formats.display_name(x)) == [
        "DRY VAN_LIFTGATE",
        "REEFER",
    ]
    assert values(spark, "string", ["OTR_0", "X", None], formats.label(x, formats.USAGE_LABELS)) == [
        "OTR 0-3yr",
        "X",
        None,
    ]
    assert values(spark, "string", [None, "2001-01"], formats.last_active(x)) == ["Never", "2001-01"]
    assert values(spark, "double", [None, 0.0, 950.0], formats.card_rate_or_dash(x)) == ["—", "—", "$950"]
    assert values(spark, "int", [None, 0, 30], formats.hours_or_missing(x)) == ["N/A", "N/A", "30"]
    places = [("Reno", "NV"), ("Reno", None), ("", "NV")]
    frame = spark.createDataFrame(places, "c string, s string")
    assert [r[0] for r in frame.select(formats.place(F.col("c"), F.col("s"))).collect()] == [
        "Reno, NV",
        "Unknown",
        "Unknown",
    ]


def test_dates_against_moments(spark):
    days = [dt.date(2001, 11, 14), dt.date(2001, 11, 15), dt.date(2001, 11, 16)]
    noon, midnight = AS_OF, dt.datetime(2001, 11, 15)
    assert values(spark, "date", days, moments.on_or_after(F.col("x"), noon)) == [False, False, True]
    assert values(spark, "date", days, moments.on_or_after(F.col("x"), midnight)) == [False, True, True]
    assert values(spark, "date", days, moments.before(F.col("x"), noon)) == [True, True, False]
    assert values(spark, "date", days, moments.before(F.col("x"), midnight)) == [True, False, False]

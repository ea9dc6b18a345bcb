"""Derived views against a brute-force count, and their invariants."""

from __future__ import annotations

import calendar
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import frames
from frames import AS_OF, day
from yardline.functions import buckets
from yardline.plans import lease_history, store
from yardline.plans.revenue_details import revenue_details
from yardline.sources import testdata

FROM_MONTH = "1999-06"


def month_days(first=(1999, 6), today=AS_OF.date()):
    year, month = first
    while (year, month) <= (today.year, today.month):
        last = dt.date(year, month, calendar.monthrange(year, month)[1])
        yield min(last, today)
        year, month = (year, month + 1) if month < 12 else (year + 1, 1)


def brute_force(units, leases):
    """(unit, month) -> (rented, started leases, last end, months idle)."""
    result = {}
    for unit in units:
        for d in month_days():
            if unit["PurchaseDate"] > d or (unit["SoldDate"] and unit["SoldDate"] <= d):
                continue
            mine = [lease for lease in leases if lease["Unit"] == unit["Unit"] and lease["DateOn"] <= d]
            rented = any(lease["DateOff"] is None or lease["DateOff"] > d for lease in mine)
            ends = [lease["DateOff"] for lease in mine if lease["DateOff"] and lease["DateOff"] <= d]
            since = max(ends) if ends else unit["PurchaseDate"]
            idle = (d.year - since.year) * 12 + d.month - since.month
            result[unit["Unit"], f"{d:%Y-%m}"] = (rented, len(mine), max(ends) if ends else None, idle)
    return result


@pytest.fixture(scope="module")
def random_fleet(spark):
    rng = random.Random(5)

    def any_day(low="1998-01-01", span=1500):
        return day(low) + dt.timedelta(days=rng.randrange(span))

    units = [
        {
            "Unit": f"U{i}",
            "PurchaseDate": any_day(),
            "SoldDate": any_day("2000-01-01", 900) if i % 5 == 0 else None,
            "Fleetcity": rng.choice(["North", "South", "TBD", "", None]),
        }
        for i in range(40)
    ]
    leases = []
    for number in range(300):
        # Unit U1 holds a third of all leases; some units have none.
        unit = "U1" if number % 3 == 0 else f"U{rng.randrange(30)}"
        began = any_day("1998-06-01", 1400)
        ended = None if rng.random() < 0.03 else began + dt.timedelta(days=rng.randrange(1, 200))
        leases.append({"LeaseID": number, "Unit": unit, "DateOn": began, "DateOff": ended})
    leases += [
        {"LeaseID": 900, "Unit": "U35", "DateOn": day("2001-06-01"), "DateOff": AS_OF.date()},
        {"LeaseID": 901, "Unit": "U36", "DateOn": AS_OF.date(), "DateOff": None},
        {"LeaseID": 902, "Unit": "U37", "DateOn": day("2001-11-16"), "DateOff": None},
        {"LeaseID": 903, "Unit": "U38", "DateOn": day("2001-05-31"), "DateOff": day("2001-06-30")},
    ]
    return units, leases, frames.trailers(spark, *units), frames.leases(spark, *leases), frames.card_rates(
        spark, ("DRY_VAN", "OTR_0", "53", 1000)
    )


def test_idle_history_equals_brute_force(random_fleet):
    units, leases, trailer_frame, lease_frame, rates = random_fleet
    expected = {
        key: (count, f"{end:%Y-%m}" if end else None, idle)
        for key, (rented, count, end, idle) in brute_force(units, leases).items()
        if not rented
    }
    history = lease_history.idle_history(trailer_frame, lease_frame, rates, as_of=AS_OF, from_month=FROM_MONTH)
    rows = history.collect()
    actual = {(r.Unit, r.MonthStr): (r.CumulativeLeases, r.LastActiveMonth, r.MonthsIdle) for r in rows}
    assert len(rows) == len(actual)
    assert actual == expected
    assert {r.CardRate for r in rows} == {frames.money(1000)}


def test_bucket_statistics_equals_brute_force(random_fleet):
    units, leases, trailer_frame, lease_frame, _ = random_fleet
    branch_of = {unit["Unit"]: unit["Fleetcity"] for unit in units}
    expected = {}
    for (unit, month), (rented, *_rest) in brute_force(units, leases).items():
        for key in ((month, "GLOBAL", "ALL"), (month, "BY_BRANCH", branch_of[unit])):
            total, leased = expected.get(key, (0, 0))
            expected[key] = (total + 1, leased + rented)
    statistics = lease_history.bucket_statistics(trailer_frame, lease_frame, as_of=AS_OF, from_month=FROM_MONTH)
    actual = {(r.Month, r.AggLevel, r.Branch): (r.NumTrailers, r.NumRentedTrailers) for r in statistics.collect()}
    assert actual == expected


def test_snapshot_is_the_newest_month(random_fleet):
    _, _, trailer_frame, lease_frame, rates = random_fleet
    history = lease_history.idle_history(trailer_frame, lease_frame, rates, as_of=AS_OF, from_month=FROM_MONTH)
    snapshot = lease_history.idle_snapshot(trailer_frame, lease_frame, rates, as_of=AS_OF)
    newest = lease_history.latest_month(history)
    assert snapshot.count() == newest.count() > 0
    assert snapshot.exceptAll(newest).isEmpty()


def test_snapshot_of_an_earlier_day_is_that_month(random_fleet):
    _, _, trailer_frame, lease_frame, rates = random_fleet
    earlier = dt.datetime(2000, 4, 30)
    history = lease_history.idle_history(trailer_frame, lease_frame, rates, as_of=earlier, from_month=FROM_MONTH)
    snapshot = lease_history.idle_snapshot(trailer_frame, lease_frame, rates, as_of=earlier)
    assert snapshot.exceptAll(lease_history.latest_month(history)).isEmpty()
    assert snapshot.select("MonthStr").distinct().collect() == [("2000-04",)]


def test_later_start_gives_the_same_months(random_fleet):
    _, _, trailer_frame, lease_frame, _ = random_fleet
    full = lease_history.bucket_statistics(trailer_frame, lease_frame, as_of=AS_OF, from_month=FROM_MONTH)
    short = lease_history.bucket_statistics(trailer_frame, lease_frame, as_of=AS_OF, from_month="2001-02")
    assert full.where("Month >= '2001-02'").exceptAll(short).isEmpty()
    assert short.agg(F.min("Month")).first()[0] == "2001-02"


def test_no_units_gives_no_rows(spark, random_fleet):
    _, _, trailer_frame, lease_frame, rates = random_fleet
    none = trailer_frame.where("false")
    assert lease_history.idle_history(none, lease_frame, rates, as_of=AS_OF, from_month=FROM_MONTH).isEmpty()
    assert lease_history.bucket_statistics(none, lease_frame, as_of=AS_OF, from_month=FROM_MONTH).isEmpty()


def test_no_leases_means_idle_since_purchase(spark, random_fleet):
    _, _, trailer_frame, lease_frame, rates = random_fleet
    snapshot = lease_history.idle_snapshot(trailer_frame, lease_frame.where("false"), rates, as_of=AS_OF)
    assert snapshot.where("CumulativeLeases <> 0 OR LastActiveMonth IS NOT NULL").isEmpty()
    assert snapshot.count() == lease_history.fleet_units(trailer_frame, as_of=AS_OF).count()


def test_stored_views_read_back(random_fleet, spark, tmp_path):
    _, _, trailer_frame, lease_frame, rates = random_fleet
    history = lease_history.idle_history(trailer_frame, lease_frame, rates, as_of=AS_OF, from_month=FROM_MONTH)
    store.save_idle_history(history, str(tmp_path / "idle"))
    stored = store.load_idle_history(spark, str(tmp_path / "idle"))
    assert stored.columns == history.columns
    assert stored.exceptAll(history).isEmpty() and history.exceptAll(stored).isEmpty()
    newest = lease_history.latest_month(stored)
    assert newest.select("MonthStr").distinct().collect() == [("2001-11",)]
    statistics = lease_history.bucket_statistics(trailer_frame, lease_frame, as_of=AS_OF, from_month=FROM_MONTH)
    store.save_bucket_statistics(statistics, str(tmp_path / "statistics"))
    assert store.load_bucket_statistics(spark, str(tmp_path / "statistics")).exceptAll(statistics).isEmpty()


def test_revenue_details_keeps_every_line(spark):
    lines = frames.invoice_lines(
        spark,
        {"UnitNumber": "U1", "BilledMonthlyRate": frames.money(900)},
        {"UnitNumber": "U2", "InvoiceNo": "I2"},
        {"UnitNumber": "unknown", "InvoiceNo": "I3"},
    )
    units = frames.trailers(spark, {"Unit": "U1"}, {"Unit": "U2", "Type": "FLATBED"})
    rates = frames.card_rates(spark, ("DRY_VAN", "OTR_0", "53", 1000))
    rows = {r.InvoiceNo: r for r in revenue_details(lines, units, rates, as_of=AS_OF).collect()}
    assert rows["I1"].MonthlyRateVariance == frames.money(-100) and rows["I1"].YearRange == "1998-2001"
    assert rows["I2"].CardRateMonth is None and rows["I2"].TypeBucket == "FLATBED"
    assert rows["I3"].Branch is None and rows["I3"].TypeBucket is None


def test_idle_and_rented_units_add_up(spark):
    """On the test tables: a fleet unit is either rented or idle in each month."""
    inputs = testdata.load(spark, "/root/testdata/sf0.001")
    span = {"as_of": testdata.AS_OF}
    idle = lease_history.idle_history(inputs.trailers, inputs.leases, inputs.card_rates, **span)
    idle = idle.groupBy("MonthStr").agg(F.count("*").alias("idle"))
    statistics = lease_history.bucket_statistics(inputs.trailers, inputs.leases, **span)
    total = statistics.where("AggLevel = 'GLOBAL'").join(idle, F.col("Month") == F.col("MonthStr"), "left")
    assert total.where("NumTrailers <> NumRentedTrailers + coalesce(idle, 0)").isEmpty()
    by_branch = statistics.where("AggLevel = 'BY_BRANCH'").groupBy("Month").agg(F.sum("NumTrailers").alias("n"))
    assert by_branch.join(statistics.where("AggLevel = 'GLOBAL'"), "Month").where("n <> NumTrailers").isEmpty()


def test_history_starts_at_the_purchase(random_fleet):
    _, _, trailer_frame, lease_frame, rates = random_fleet
    bought = trailer_frame.where(F.col("PurchaseDate") <= F.lit(AS_OF.date())).agg(F.date_format(F.min("PurchaseDate"), "yyyy-MM")).first()[0]
    statistics = lease_history.bucket_statistics(trailer_frame, lease_frame, as_of=AS_OF)
    assert statistics.agg(F.min("Month")).first()[0] == bought
    history = lease_history.idle_history(trailer_frame, lease_frame, rates, as_of=AS_OF)
    later = lease_history.idle_history(trailer_frame, lease_frame, rates, as_of=AS_OF, from_month=FROM_MONTH)
    assert history.where(F.col("MonthStr") >= FROM_MONTH).exceptAll(later).isEmpty() and later.exceptAll(history).isEmpty()


def test_saving_a_month_keeps_the_others(random_fleet, spark, tmp_path):
    _, _, trailer_frame, lease_frame, rates = random_fleet
    history = lease_history.idle_history(trailer_frame, lease_frame, rates, as_of=AS_OF, from_month="2001-09")
    path = str(tmp_path / "idle")
    store.save_idle_history(history, path)
    store.save_idle_history(history.where("MonthStr = '2001-11'"), path)
    months = lambda: sorted(r[0] for r in store.load_idle_history(spark, path).select("MonthStr").distinct().collect())
    assert months() == ["2001-09", "2001-10", "2001-11"]
    store.save_idle_history(history.where("MonthStr = '2001-11'"), path, rebuild=True)
    assert months() == ["2001-11"]


def test_wide_money_is_kept(random_fleet, spark, tmp_path):
    _, _, trailer_frame, lease_frame, rates = random_fleet
    wide = rates.withColumn("CardRateMonth", F.lit("1234567.89").cast("decimal(20,2)"))
    history = lease_history.idle_history(trailer_frame, lease_frame, wide, as_of=AS_OF, from_month="2001-11")
    store.save_idle_history(history, str(tmp_path / "idle"))
    stored = store.load_idle_history(spark, str(tmp_path / "idle"))
    assert stored.exceptAll(history).isEmpty() and stored.schema["CardRate"].dataType == history.schema["CardRate"].dataType


def test_money_is_never_rounded(spark):
    from yardline.sources.inputs import conform
    from yardline.sources.schemas import INVOICE_LINES

    line = frames.invoice_lines(spark, {"InvoiceNo": "I1"})
    fine = line.withColumn("BilledMonthlyRate", F.lit("1234567.8900").cast("decimal(19,4)")).withColumn("BilledMileageRate", F.lit("0.065").cast("decimal(9,3)"))
    row = conform(fine, INVOICE_LINES).first()
    assert str(row.BilledMonthlyRate) == "1234567.89" and str(row.BilledMileageRate) == "0.0650"
    for kind in ("decimal(9,3)", "double"):
        with pytest.raises(Exception, match="finer"):
            conform(line.withColumn("BilledDailyRate", F.lit("40.005").cast(kind)), INVOICE_LINES).collect()


def test_inputs_have_the_declared_types(spark):
    from yardline.sources.schemas import IDLE_ASSETS, INPUTS, REVENUE_DETAILS

    inputs = testdata.load(spark, "/root/testdata/sf0.001")
    for name, frame in inputs.as_dict().items():
        assert [(f.name, f.dataType) for f in frame.schema] == [(f.name, f.dataType) for f in INPUTS[name]]
    idle = lease_history.idle_snapshot(inputs.trailers, inputs.leases, inputs.card_rates, as_of=AS_OF)
    assert [(f.name, f.dataType) for f in idle.schema] == [(f.name, f.dataType) for f in IDLE_ASSETS]
    revenue = revenue_details(inputs.invoice_lines, inputs.trailers, inputs.card_rates, as_of=AS_OF)
    assert [(f.name, f.dataType) for f in revenue.schema] == [(f.name, f.dataType) for f in REVENUE_DETAILS]
    assert buckets.CRITICAL_IDLE in buckets.idle_labels()

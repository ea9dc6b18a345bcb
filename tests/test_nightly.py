"""Views kept up night by night, stored months, and reports in order without a total sort."""

from __future__ import annotations

import csv
import datetime as dt
import gzip
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import frames
from frames import AS_OF, day, money
from yardline import registry
from yardline.operators import reports, revenue
from yardline.plans import lease_history, nightly, ordering, store
from yardline.sources import csv_sink, testdata

NIGHTS = [dt.datetime(2001, 5, 31, 12), dt.datetime(2001, 7, 10, 12), dt.datetime(2001, 7, 11, 12), dt.datetime(2001, 9, 30, 23), AS_OF]


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def same_rows(left, right) -> bool:
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.fixture(scope="module")
def fleet(spark):
    rng = random.Random(12)
    units = [
        {"Unit": f"U{i}", "PurchaseDate": day("2000-11-01") + dt.timedelta(days=rng.randrange(380)), "Fleetcity": rng.choice(["North", "South", None])}
        for i in range(30)
    ]
    units[3]["SoldDate"], units[4]["SoldDate"] = day("2001-06-15"), day("2001-10-02")
    leases = []
    for number in range(260):
        began = day("2000-12-01") + dt.timedelta(days=rng.randrange(380))
        ended = None if rng.random() < 0.1 else began + dt.timedelta(days=rng.randrange(1, 120))
        leases.append({"LeaseID": number, "Unit": "U1" if number % 3 == 0 else f"U{rng.randrange(25)}", "DateOn": began, "DateOff": ended})
    leases += [
        {"LeaseID": 900, "Unit": "U27", "DateOn": day("2001-07-10"), "DateOff": day("2001-07-11")},
        {"LeaseID": 901, "Unit": "U28", "DateOn": day("2001-05-31"), "DateOff": day("2001-09-30")},
        {"LeaseID": 902, "Unit": "U29", "DateOn": day("2001-09-30"), "DateOff": day("2001-11-15")},
    ]
    return frames.trailers(spark, *units), frames.leases(spark, *leases), frames.card_rates(spark, ("DRY_VAN", "OTR_0", "53", 1000))


@pytest.fixture(scope="module")
def nights(spark, fleet, tmp_path_factory):
    """A folder that went through all nights."""
    units, leases, rates = fleet
    folder = str(tmp_path_factory.mktemp("nights"))
    nightly.first_night(units, testdata.leases_as_known(leases, NIGHTS[0]), rates, folder, as_of=NIGHTS[0])
    for before, now in zip(NIGHTS, NIGHTS[1:]):
        nightly.next_night(spark, folder, units, testdata.lease_changes(leases, before, now), rates, as_of=now)
    return folder


def views(spark, folder):
    return store.load_idle_history(spark, nightly.idle_path(folder)), store.load_bucket_statistics(spark, nightly.statistics_path(folder))


def rebuilt(fleet, as_of):
    units, leases, rates = fleet
    return lease_history.idle_history(units, leases, rates, as_of=as_of), lease_history.bucket_statistics(units, leases, as_of=as_of)


def test_nights_equal_a_rebuild(spark, fleet, nights):
    for stored, whole in zip(views(spark, nights), rebuilt(fleet, AS_OF)):
        assert whole.count() > 50 and same_rows(stored, whole)


def test_the_state_is_small(spark, fleet, nights):
    settled, still_open = nightly.load_state(spark, nights, AS_OF.date())
    ended = fleet[1].where(F.col("DateOff") <= F.lit(AS_OF.date()))
    assert settled.count() == ended.select("Unit").distinct().count()
    assert settled.agg(F.sum("leases")).first()[0] == ended.count()
    assert still_open.where(F.col("DateOff") <= F.lit(AS_OF.date())).isEmpty()


def test_a_night_may_run_again(spark, fleet, nights):
    units, leases, rates = fleet
    changes = testdata.lease_changes(leases, NIGHTS[-2], AS_OF)
    made = nightly.next_night(spark, nights, units, changes, rates, as_of=AS_OF)
    assert made == ["2001-10", "2001-11"] and nightly.last_night(spark, nights) == AS_OF.date()
    for stored, whole in zip(views(spark, nights), rebuilt(fleet, AS_OF)):
        assert same_rows(stored, whole)


def test_a_night_reads_state_and_changes_only(spark, fleet, nights, tmp_path):
    units, leases, rates = fleet
    testdata.lease_changes(leases, NIGHTS[-2], AS_OF).write.parquet(str(tmp_path / "changes"))
    settled, still_open = nightly.load_state(spark, nights, NIGHTS[-2].date())
    current = nightly.pending(still_open, spark.read.parquet(str(tmp_path / "changes")))
    history = lease_history.idle_history(units, current, rates, as_of=AS_OF, from_month="2001-10", settled=settled)
    places = history.inputFiles()
    assert places and all(re.search(r"/state/2001-09-30/(open|settled)/|/changes/", p) for p in places), places


def test_months_since():
    assert nightly.months_since(dt.date(2001, 8, 31), AS_OF) == ["2001-09", "2001-10", "2001-11"]
    assert nightly.months_since(dt.date(2000, 12, 30), dt.datetime(2001, 1, 2)) == ["2000-12", "2001-01"]


@pytest.mark.parametrize(
    "change",
    [
        {"LeaseID": 999, "DateOn": day("2001-06-01")},  # told after it started
        {"LeaseID": 1, "DateOn": day("2001-06-01"), "DateOff": day("2001-06-05")},  # ended before the night
        {"LeaseID": 1, "DateOn": day("2001-06-02")},  # another start
        {"LeaseID": 1, "Unit": "B", "DateOn": day("2001-06-01")},  # another unit
    ],
)
def test_late_leases_are_refused(spark, tmp_path, change):
    units, rates = frames.trailers(spark, {"Unit": "U1"}, {"Unit": "B"}), frames.card_rates(spark, ("DRY_VAN", "OTR_0", "53", 1))
    first, folder = dt.datetime(2001, 7, 1), str(tmp_path)
    nightly.first_night(units, frames.leases(spark, {"DateOn": day("2001-06-01")}), rates, folder, as_of=first)
    with pytest.raises(nightly.LateLeases, match="1 leases"):
        nightly.next_night(spark, folder, units, frames.leases(spark, change), rates, as_of=AS_OF)
    assert nightly.last_night(spark, folder) == first.date()
    nightly.next_night(spark, folder, units, frames.leases(spark, {"DateOn": day("2001-06-01"), "DateOff": day("2001-07-02")}), rates, as_of=AS_OF)
    rows = store.load_idle_history(spark, nightly.idle_path(folder)).where("Unit = 'U1' AND MonthStr > '2001-05'").collect()
    assert sorted((r.MonthStr, r.MonthsIdle) for r in rows) == [("2001-07", 0), ("2001-08", 1), ("2001-09", 2), ("2001-10", 3), ("2001-11", 4)]


def test_nights_without_state_or_rows(spark, tmp_path):
    units, rates = frames.trailers(spark, {}), frames.card_rates(spark, ("DRY_VAN", "OTR_0", "53", 1))
    none = frames.leases(spark).where("false")
    with pytest.raises(ValueError, match="no night"):
        nightly.next_night(spark, str(tmp_path / "x"), units, none, rates, as_of=AS_OF)
    nightly.first_night(units.where("false"), none, rates, str(tmp_path / "y"), as_of=NIGHTS[0])
    nightly.next_night(spark, str(tmp_path / "y"), units, none, rates, as_of=AS_OF)
    assert store.load_idle_history(spark, nightly.idle_path(str(tmp_path / "y"))).count() == 6


def test_a_month_that_lost_its_rows_is_empty(spark, tmp_path):
    path = str(tmp_path)
    store.save_idle_history(frames.idle(spark, {}, {"MonthStr": "2001-10"}), path)
    store.replace_idle_months(frames.idle(spark, {"MonthStr": "2001-10", "Unit": "B"}), path, ["2001-10", "2001-11"])
    left = store.load_idle_history(spark, path)
    assert [(r.MonthStr, r.Unit) for r in left.collect()] == [("2001-10", "B")]
    assert [r.Unit for r in store.load_latest_idle_month(spark, path).collect()] == ["B"]


def test_months_are_replaced_in_one_run(spark, tmp_path):
    path = str(tmp_path / "idle")
    store.save_idle_history(frames.idle(spark, {"MonthStr": "2001-08"}, {"MonthStr": "2001-09"}, {"MonthStr": "2001-10"}), path)
    computed = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    new = frames.idle(spark, {"MonthStr": "2001-07"}, {"MonthStr": "2001-08", "Unit": "B"}, {"MonthStr": "2001-09", "Unit": "C"}, {"MonthStr": "2001-11", "Unit": "D"})
    store.replace_idle_months(new.mapInArrow(seen, new.schema), path, ["2001-08", "2001-09", "2001-10", "2001-11"])
    assert computed.value == 4
    left = store.load_idle_history(spark, path).collect()
    assert sorted((r.MonthStr, r.Unit) for r in left) == [("2001-08", "B"), ("2001-09", "C"), ("2001-11", "D")]


def test_the_latest_month_is_read_by_its_folder(spark, tmp_path):
    store.save_idle_history(frames.idle(spark, {}, {"MonthStr": "2001-10"}, {"MonthStr": "2001-09"}), str(tmp_path))
    latest = store.load_latest_idle_month(spark, str(tmp_path))
    rows = latest.collect()
    assert [r.MonthStr for r in rows] == ["2001-11"]
    scan = latest._jdf.queryExecution().executedPlan()
    assert re.search(r"PartitionFilters: \[[^\]]*MonthStr#\d+ = (ReusedSubquery )?Subquery", scan.toString())
    files = latest.select(F.input_file_name().alias("f")).distinct().collect()
    assert all("MonthStr=2001-11" in r.f for r in files)


def test_decimals_of_months_agree(spark, tmp_path):
    path, wide = str(tmp_path), "decimal(20,4)"
    store.save_idle_history(frames.idle(spark, {"MonthStr": "2001-01"}), path)
    second = frames.idle(spark, {"MonthStr": "2001-02", "CardRate": money(7)})
    store.save_idle_history(second.withColumn("CardRate", F.col("CardRate").cast(wide)), path)
    rows = {r.MonthStr: r.CardRate for r in store.load_idle_history(spark, path).collect()}
    assert rows == {"2001-01": money(1000), "2001-02": money(7)}
    for value in ("1.0001", "99999999999999999.99"):
        finer = second.withColumn("CardRate", F.lit(value).cast("decimal(24,4)"))
        with pytest.raises(Exception, match="CardRate does not fit the stored decimal"):
            store.save_idle_history(finer, path)
    both = store.load_idle_history(spark, path).withColumn("CardRate", F.col("CardRate").cast(wide))
    store.save_idle_history(both, str(tmp_path / "wide"), rebuild=True)
    assert dict(store.load_idle_history(spark, str(tmp_path / "wide")).dtypes)["CardRate"] == wide


@pytest.mark.parametrize("as_of", [AS_OF, dt.datetime(2001, 3, 31), dt.datetime(2001, 6, 15)])
def test_latest_idle_month_without_the_history(fleet, as_of):
    units, leases, rates = fleet
    whole = lease_history.latest_month(lease_history.idle_history(units, leases, rates, as_of=as_of))
    newest = lease_history.latest_idle_month(units, leases, rates, as_of=as_of)
    assert newest.columns == whole.columns and same_rows(newest, whole) and not newest.isEmpty()


def test_latest_idle_month_goes_back_where_no_unit_is_idle_now(spark, fleet):
    rates, units = fleet[2], frames.trailers(spark, {"Unit": "A"}, {"Unit": "B"})
    leases = frames.leases(spark, {"LeaseID": 1, "Unit": "A", "DateOn": day("2001-03-05")}, {"LeaseID": 2, "Unit": "B", "DateOn": day("2000-05-05")})
    newest = lease_history.latest_idle_month(units, leases, rates, as_of=AS_OF)
    assert [(r.Unit, r.MonthStr) for r in newest.collect()] == [("A", "2001-02")]
    assert same_rows(newest, lease_history.latest_month(lease_history.idle_history(units, leases, rates, as_of=AS_OF)))
    assert lease_history.latest_idle_month(units.where("false"), leases, rates, as_of=AS_OF).isEmpty()
    assert "explode" not in plan_of(newest).lower()


# ---- order


def lines(spark, n=400):
    rng = random.Random(9)
    rows = [
        {"UnitNumber": f"U{rng.randrange(40)}", "Branch": rng.choice(["North", "South", None, "a,b"]), "InvoiceNo": f"I{i}", "BillingStopDate": day("1999-01-01") + dt.timedelta(days=rng.choice([3, 700, rng.randrange(900)]))}
        for i in range(n)
    ]
    return frames.revenue(spark, *rows)


@pytest.mark.parametrize("steps", [1, 3, 64, 2000])
def test_tasks_in_turn_give_the_order(spark, steps):
    order = ["Branch", "UnitNumber", "InvoiceNo"]
    rows = lines(spark)
    got = ordering.newest_first(rows, "BillingStopDate", order, steps=steps)
    assert [r.InvoiceNo for r in got.collect()] == [r.InvoiceNo for r in rows.orderBy(F.desc("BillingStopDate"), *order).collect()]
    nulls = rows.withColumn("BillingStopDate", F.when(F.col("InvoiceNo") < "I3", F.col("BillingStopDate")))
    assert [r.InvoiceNo for r in ordering.newest_first(nulls, "BillingStopDate", order, steps=steps).collect()] == [
        r.InvoiceNo for r in nulls.orderBy(F.desc_nulls_last("BillingStopDate"), *order).collect()
    ]
    assert ordering.newest_first(rows.where("false"), "BillingStopDate", order, steps=steps).collect() == []


def test_the_revenue_report_reads_whole_lines_once(spark):
    inputs = testdata.load(spark, "/root/testdata/sf0.001")
    from yardline.plans.revenue_details import revenue_details

    report = reports.report_revenue(revenue_details(inputs.invoice_lines, inputs.trailers, inputs.card_rates, as_of=AS_OF))
    report.collect()
    plan = plan_of(report)
    assert "rangepartitioning" not in plan
    wide = [c for c in re.findall(r"FileScan parquet \[(.*?)\].*?lineitem", plan) if "l_extendedprice" in c]
    assert len({re.sub(r"#\d+L?", "", c) for c in wide}) == 1 and len(wide) <= 2  # initial and final plan show the same scan


def test_an_export_by_month_is_in_order(spark, tmp_path):
    report = reports.report_revenue(lines(spark))
    result = csv_sink.write_csv_by_month(report, str(tmp_path / "x"), "BillingStopDate")
    assert result.rows == 400
    months = sorted((p for p in (tmp_path / "x").iterdir() if p.is_dir()), reverse=True)
    read = [row for m in months for part in sorted(m.glob("part-*.csv")) for row in csv.DictReader(part.open())]
    assert [r["InvoiceNo"] for r in read] == [r.InvoiceNo for r in report.collect()]
    back = csv_sink.read_csv(spark, result.path, report.schema)
    assert same_rows(back, report) and back.columns == report.columns


def test_variances_are_not_exchanged(spark):
    rows = [{}, {"CardRateMonth": None, "InvoiceNo": "I2"}, {"CardRateMonth": money(0), "InvoiceNo": "I3"}]
    report = reports.report_revenue(frames.revenue(spark, *rows))
    got = {r.InvoiceNo: (r.MonthlyRateVariance, r.VariancePercent) for r in report.collect()}
    assert got == {"I1": (money(-100), -0.1), "I2": (None, None), "I3": (money(900), None)}
    below = plan_of(report).split("Exchange")[1]
    assert "MonthlyRateVariance" not in below and "VariancePercent" not in below
    assert report.schema == reports.report_revenue(frames.revenue(spark, *rows), ordered=False).schema


def test_packed_exports_hold_the_same_text(spark, tmp_path):
    report = reports.report_revenue(lines(spark))
    texts = []
    for name, packed, opened in (("plain", {}, open), ("packed", {"compression": "gzip"}, gzip.open)):
        result = csv_sink.write_csv_by_month(report, str(tmp_path / name), "BillingStopDate", **packed)
        whole = csv_sink.export_report(report, "revenue", str(tmp_path / f"{name}-whole"), as_of=AS_OF, **packed)
        assert result.rows == whole.rows == 400
        back = csv_sink.read_report(spark, "revenue", str(tmp_path / f"{name}-whole"), report.schema, as_of=AS_OF)
        assert same_rows(back, report) and same_rows(csv_sink.read_csv(spark, result.path, report.schema), report)
        files = sorted((p.relative_to(tmp_path / name).as_posix().split("/")[0], p.name) for p in (tmp_path / name).rglob("part-*"))
        texts.append([opened(tmp_path / name / month / part, "rt").read() for month, part in files])
    assert texts[0] == texts[1]


def test_the_lines_export_is_packed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "work_folder", lambda _, name: str(tmp_path / name))
    fleet = registry.Fleet(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(registry, "_reports", lambda f: {"revenue": reports.report_revenue(f.revenue)})
    exported = registry._revenue_export(fleet).count()
    status = registry._export_status(fleet).where("selection = 'all'").first()
    assert exported == status.rows == status.rows_read == fleet.lines.count()
    for folder in ("lines", "exports"):
        files = [p.name for p in (tmp_path / folder).rglob("part-*") if ".status" not in str(p.parent)]
        assert files and all(name.endswith(".csv.gz") for name in files)


def test_lines_are_exchanged_with_short_codes(spark):
    names = ("TypeBucket", "UsageCategory", "LengthBucket")
    known = [dict(zip(names, v)) for v in (("SPECIALTY", "STORAGE", "53"), ("REEFER", "OTR_0", "20"), ("DRY_VAN_LIFTGATE", "CART_2", "28-32"))]
    other = [dict(zip(names, v)) for v in ((None, None, None), ("VAN X", "OTR_9", ""), ("", "STORAGE", None), (None, "CART_1", "54"))]
    frame = frames.revenue(spark, *({"InvoiceNo": f"I{i}"} | v for i, v in enumerate(known + other)))
    report = reports.report_revenue(frame)
    got = {r.InvoiceNo: {n: r[n] for n in names} for r in report.collect()}
    assert got == {f"I{i}": v for i, v in enumerate(known + other)}
    assert same_rows(report, reports.report_revenue(frame, ordered=False))
    assert "_codes" in plan_of(report).split("Exchange")[1]


def test_all_reports_are_written_packed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "work_folder", lambda _, name: str(tmp_path / name))
    fleet = registry.Fleet(spark, "/root/testdata/sf0.001")
    reported = registry._reports(fleet)
    monkeypatch.setattr(registry, "_reports", lambda f: {name: reported[name] for name in ("inventory", "idle")})
    for row in registry._export_status(fleet).collect():
        assert row.rows == row.rows_read and (row.selection == "none" or row.rows > 0)
    files = [p.name for p in (tmp_path / "exports").rglob("part-*") if ".status" not in str(p.parent)]
    assert files and all(name.endswith(".csv.gz") for name in files)


def test_an_unfinished_export_is_refused(spark, tmp_path):
    report = reports.report_inventory(frames.trailers(spark, {"Type": "  VAN", "Make": 'a "b", c\nd'}), as_of=AS_OF)
    with pytest.raises(ValueError, match="missing"):
        csv_sink.read_report(spark, "inventory", str(tmp_path), report.schema, as_of=AS_OF)
    result = csv_sink.export_report(report, "inventory", str(tmp_path), as_of=AS_OF)
    assert Path(result.path).is_dir()
    assert csv_sink.export_status(spark, result.path).collect() == [("fleet-inventory-2001-11-15.csv", 1, "ok")]
    broken = report.withColumn("Unit", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        csv_sink.export_report(broken, "inventory", str(tmp_path), as_of=AS_OF)
    with pytest.raises(ValueError, match="writing"):
        csv_sink.read_report(spark, "inventory", str(tmp_path), report.schema, as_of=AS_OF)


# ---- invoices


def test_reconciliation_tells_orphans_apart(spark):
    schema = testdata.load(spark, "/root/testdata/sf0.001").invoices.schema
    rows = [("A", 1, day("2001-01-01"), money(1800)), ("B", 1, None, money(1)), ("C", None, None, None), ("D", 2, None, money(0)), ("A2", 2, None, money(5))]
    headers = spark.createDataFrame(rows, schema)
    held = [{"InvoiceNo": "A"}, {"InvoiceNo": "A"}, {"InvoiceNo": "B"}, {"InvoiceNo": "C"}, {"InvoiceNo": "Z"}, {"InvoiceNo": "Z"}]
    own = frames.invoice_lines(spark, *held)
    found = {r.invoice_no: (r.status, r.line_count, r.difference) for r in revenue.invoice_reconciliation(headers, own).collect()}
    assert found == {
        "A": ("agrees", 2, money(0)),
        "B": ("differs", 1, money(899)),
        "C": ("no total", 1, None),
        "D": ("no lines", 0, None),
        "A2": ("no lines", 0, None),
        "Z": ("no header", 2, None),
    }
    assert sorted(r.invoice_no for r in revenue.headers_without_lines(headers, own).collect()) == ["A2", "D"]
    assert [r.invoice_no for r in revenue.lines_without_header(headers, own).collect()] == ["Z", "Z"]
    assert revenue.invoice_reconciliation(headers.where("false"), own.where("false")).isEmpty()

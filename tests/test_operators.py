"""Filters, ties, fallbacks and empty inputs of the operators."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

import frames
from frames import AS_OF, day, money
from yardline.functions import buckets
from yardline.operators import branches, idle, kpis, locations, reports, revenue, selection, utilization
from yardline.plans.revenue_details import revenue_details
from yardline.sources import testdata


@pytest.fixture(scope="module")
def small(spark):
    return testdata.load(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def fleet(spark):
    return frames.trailers(
        spark,
        {"Unit": "A1", "Status": "LEASED"},
        {"Unit": "A2", "Status": "AVAILABLE", "Type": "REEFER", "Length": "40"},
        {"Unit": "A3", "Status": "AVAILABLE", "Type": None, "Length": None},
        {"Unit": "B1", "Status": "AVAILABLE", "Fleetcity": "South"},
        {"Unit": "C1", "Status": "LEASED", "Fleetcity": ""},
        {"Unit": "D1", "Status": "LEASED", "Fleetcity": None},
        {"Unit": "E1", "Status": "LEASED", "Fleetcity": "TBD"},
        {"Unit": "F1", "Status": "BOS"},
    )


def only(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0]


# Utilization and branches


def test_global_keeps_blank_and_drops_missing_branch(fleet):
    row = only(utilization.global_utilization(fleet))
    assert (row.total_trailers, row.leased_trailers, row.available_trailers, row.other_status) == (5, 2, 3, 0)
    assert row.utilization == pytest.approx(0.4)


def test_branch_filter_and_all(fleet):
    assert only(utilization.global_utilization(fleet, branch="North")).total_trailers == 3
    assert only(utilization.global_utilization(fleet, branch="all")).total_trailers == 5
    assert only(utilization.global_utilization(fleet, branch="it's")).total_trailers == 0


def test_breakdowns_add_up(small):
    total = only(utilization.global_utilization(small.trailers)).total_trailers
    for frame in (
        utilization.utilization_by_type(small.trailers, as_of=AS_OF),
        utilization.utilization_by_usage(small.trailers, as_of=AS_OF),
        utilization.utilization_matrix(small.trailers, as_of=AS_OF),
    ):
        assert only(frame.agg(F.sum("total_trailers").alias("n"))).n == total
    blank = small.trailers.where("Fleetcity = '' AND Status IN ('AVAILABLE', 'LEASED')").count()
    by_branch = utilization.utilization_by_branch(small.trailers)
    assert only(by_branch.agg(F.sum("total_trailers").alias("n"))).n == total - blank


def test_combined_equals_the_single_queries(small):
    combined = utilization.fleet_combined(small.trailers, as_of=AS_OF)
    single = utilization.utilization_matrix(small.trailers, as_of=AS_OF)
    cells = combined.where("breakdown = 'matrix'").select(*single.columns)
    assert cells.exceptAll(single).isEmpty() and single.exceptAll(cells).isEmpty()


def test_nested_form_parses_back(fleet):
    nested = utilization.fleet_combined_json(fleet, as_of=AS_OF)
    assert only(nested).total_trailers == 5
    parsed = {r.branch: r.utilization for r in utilization.parse_breakdown(nested, "by_branch_json").collect()}
    assert parsed == {"North": pytest.approx(1 / 3), "South": 0.0}
    empty = nested.withColumn("by_branch_json", F.lit(None).cast("string"))
    assert utilization.parse_breakdown(empty, "by_branch_json").isEmpty()


def test_nested_form_of_no_units(fleet):
    row = only(utilization.fleet_combined_json(fleet.where("false"), as_of=AS_OF))
    assert row.total_trailers == 0 and row.by_branch_json == "[]"


def test_pivot_has_all_usage_columns(fleet):
    pivot = utilization.utilization_pivot(fleet, as_of=AS_OF)
    assert pivot.columns == ["type_bucket", *buckets.USAGE_ORDER]
    assert only(pivot.where("type_bucket = 'DRY_VAN'")).STORAGE is None


def test_display_texts(fleet):
    row = only(utilization.utilization_display(fleet))
    assert (row.value, row.subtitle, row.status, row.gauge_percent) == ("40.0%", "2 of 5 on rent", "critical", 40.0)


def test_most_available_breaks_ties_by_type_then_length(fleet):
    row = only(branches.branch_summary(fleet, branch="North"))
    assert (row.most_available_type, row.most_available_length, row.most_available_count) == (None, None, 1)
    ranked = {r.branch: (r.Type, r.Length, r.type_count) for r in branches.most_available_type(fleet).collect()}
    assert ranked == {"North": (None, None, 1), "South": ("VAN", "53'", 1)}


def test_branch_without_available_units(spark):
    units = frames.trailers(spark, {"Unit": "A1"}, {"Unit": "A2"})
    row = only(branches.branch_summary(units))
    assert (row.total_trailers, row.most_available_type, row.most_available_count) == (2, None, None)


def test_bottom_branches_and_lists(fleet):
    assert [r.branch for r in branches.bottom_branches(fleet, limit=1).collect()] == ["South"]
    assert [r.branch for r in branches.branch_status(fleet).collect()] == ["North", "South"]
    assert [r.branch for r in branches.active_branches(fleet).collect()] == ["", "North", "South"]


# Trend


def test_month_over_month_uses_present_months(spark):
    rows = [("2001-11", "GLOBAL", "ALL", 10, 6), ("2001-08", "GLOBAL", "ALL", 10, 4), ("2001-07", "GLOBAL", "ALL", 10, 1)]
    statistics = frames.statistics(spark, *rows)
    assert only(utilization.mom_change(statistics)).mom_utilization_change == pytest.approx(0.2)
    one = statistics.where("Month = '2001-11'")
    assert only(utilization.mom_change(one)).mom_utilization_change is None
    assert [r.Month for r in utilization.utilization_trend(statistics, as_of=AS_OF).collect()] == [
        "2001-07",
        "2001-08",
        "2001-11",
    ]


def test_fleet_kpis_use_the_calendar_month_before(spark, fleet):
    leases = frames.leases(
        spark,
        {"LeaseID": 1, "Unit": "A1", "DateOn": day("2001-10-01"), "DateOff": day("2001-11-10")},
        {"LeaseID": 2, "Unit": "A2", "DateOn": day("2001-12-24"), "DateOff": day("2001-11-30")},
        {"LeaseID": 3, "Unit": "B1", "DateOn": day("1999-01-01"), "DateOff": day("2001-11-30")},
        {"LeaseID": 4, "Unit": "B1", "DateOn": day("2000-11-15"), "DateOff": None},
    )
    rows = [
        ("2001-11", "GLOBAL", "ALL", 10, 6),
        ("2001-10", "GLOBAL", "ALL", 10, 5),
        ("2001-11", "BY_BRANCH", "North", 4, 1),
        ("2001-09", "BY_BRANCH", "North", 4, 3),
        ("2001-12", "BY_BRANCH", "TBD", 4, 3),
    ]
    statistics = frames.statistics(spark, *rows)
    row = only(kpis.fleet_kpis(statistics, fleet, leases, as_of=AS_OF))
    assert row.month == "2001-11" and row.current_utilization == pytest.approx(0.6)
    assert row.mm_change == pytest.approx(0.1) and row.leased_at_start == 5
    assert (row.new_leases, row.ended_leases, row.units_returned_latest) == (2, 1, 3)
    assert row.asset_churn_pct == pytest.approx(0.6)
    assert (row.mm_status, row.lease_activity_status, row.churn_status) == ("good", "good", "warning")
    north = only(kpis.fleet_kpis(statistics, fleet, leases, as_of=AS_OF, branch="North", period="L3M"))
    assert north.previous_utilization == 0.0 and north.mm_change == pytest.approx(0.25)
    assert (north.new_leases, north.units_returned_latest, north.asset_churn_pct) == (2, 2, 0.0)
    south = only(kpis.fleet_kpis(statistics, fleet, leases, as_of=AS_OF, branch="South"))
    assert south.current_utilization == 0.0 and south.mm_change == 0.0
    live = statistics.withColumn("NumRentedTrailers", F.lit(0).cast("bigint"))
    assert only(kpis.fleet_kpis(live, fleet, leases, as_of=AS_OF)).current_utilization == pytest.approx(0.4)


def test_fleet_kpis_without_any_data(spark, fleet):
    nothing = frames.statistics(spark).where("false")
    row = only(kpis.fleet_kpis(nothing, fleet.where("false"), frames.leases(spark).where("false"), as_of=AS_OF))
    assert (row.month, row.current_utilization, row.new_leases, row.asset_churn_pct) == (None, 0.0, 0, 0.0)


# Idle


@pytest.fixture(scope="module")
def idle_rows(spark):
    critical = {"IdleDurationBucket": "24+ Months", "MonthsIdle": 30}
    return frames.idle(
        spark,
        {"Unit": "U1"},
        {"Unit": "U2", "CumulativeLeases": 0, "LastActiveMonth": None, **critical},
        {"Unit": "U3", "Branch": "South", "TypeBucket": "REEFER", "CardRate": None, **critical},
        {"Unit": "U4", "Branch": "TBD"},
        {"Unit": "U5", "Branch": None},
        {"Unit": "U6", "Branch": "South", "IdleDurationBucket": "6-12 Months", "MonthsIdle": 7},
    )


def test_idle_selection(idle_rows):
    assert only(idle.idle_summary(idle_rows)).total_idle == 4
    assert only(idle.idle_summary(idle_rows, exclude_placeholder=False)).total_idle == 6
    assert only(idle.idle_summary(idle_rows, branch="South", idle_bucket="6-12")).total_idle == 1
    assert only(idle.idle_summary(idle_rows, type_bucket="REEFER", usage_category="all")).critical_count == 1


def test_idle_summary_of_nothing_is_zero(idle_rows):
    row = only(idle.idle_summary(idle_rows.where("false")))
    assert (row.total_idle, row.total_idle_cost, row.avg_months_idle, row.total_opportunity_cost) == (0, 0, 0.0, 0)


def test_idle_groups(idle_rows):
    assert [r.idle_bucket for r in idle.idle_by_duration(idle_rows).collect()] == [
        "0-6 Months",
        "6-12 Months",
        "24+ Months",
    ]
    total = only(idle.idle_summary(idle_rows)).total_idle
    assert sum(r.unit_count for r in idle.idle_by_duration(idle_rows).collect()) == total
    assert [r.branch for r in idle.idle_by_branch(idle_rows, exclude_placeholder=False).collect()] == [
        None,
        "North",
        "South",
        "TBD",
    ]
    assert [(r.branch, r.never_leased_share) for r in idle.never_leased_share(idle_rows).collect()] == [("North", 0.5)]


def test_idle_breakdown_prefers_the_shorter_bucket_on_ties(idle_rows):
    rows = {r.type_bucket: r for r in idle.idle_breakdown(idle_rows).collect()}
    assert rows["DRY_VAN"].max_duration_bucket == "0-6 Months"
    assert rows["DRY_VAN"].never_leased_pct == pytest.approx(1 / 3)
    assert idle.idle_breakdown(idle_rows, limit=1).count() == 1


def test_critical_table(idle_rows):
    rows = idle.critical_idle_top(idle_rows).collect()
    assert [(r.unit, r.last_active) for r in rows] == [("U2", "Never"), ("U3", "2001-08")]
    assert idle.critical_idle_top(idle_rows, limit=1).count() == 1


# Revenue


@pytest.fixture(scope="module")
def rates(spark):
    return frames.revenue(
        spark,
        {"InvoiceNo": "1", "BilledMonthlyRate": money(1000)},
        {"InvoiceNo": "2", "BilledMonthlyRate": money(900)},
        {"InvoiceNo": "3", "BilledMonthlyRate": money(700), "CardRateMonth": money(0), "BillingStopDate": day("2001-08-31")},
        {"InvoiceNo": "4", "CardRateMonth": None, "Branch": "South", "BillingStopDate": day("2001-10-31")},
        {"InvoiceNo": "5", "Branch": "TBD", "BillingStopDate": day("2001-12-31")},
        {"InvoiceNo": "6", "Branch": None},
    )


def test_revenue_summary(rates):
    row = only(revenue.revenue_summary(rates))
    assert (row.invoice_count, row.total_billed) == (3, money(2600))
    assert row.avg_variance_pct == pytest.approx(-0.05)
    assert (row.at_or_above_card, row.below_card) == (2, 1)
    share = only(revenue.rate_share(rates))
    assert share.at_or_above_share == pytest.approx(2 / 3) and share.below_status == "warning"


def test_newest_month_ignores_card_rate_and_branch_filter(rates):
    row = only(revenue.revenue_latest_month(rates))
    assert (row.month, row.avg_variance_pct, row.at_or_above_card) == ("2001-10", None, None)
    north = only(revenue.revenue_latest_month(rates.where("InvoiceNo <> '4'"), branch="South"))
    assert (north.month, north.below_card) == ("2001-09", None)


def test_variance_distribution(rates):
    rows = {r.variance_bucket: r.invoice_count for r in revenue.variance_distribution(rates).collect()}
    assert rows == {buckets.AT_OR_ABOVE: 2, buckets.WITHIN_10: 1, buckets.NO_CARD_RATE: 1}
    assert sum(r.share for r in revenue.variance_shares(rates).collect()) == pytest.approx(1)


def test_revenue_growth(rates):
    rows = revenue.revenue_growth(rates).collect()
    assert [(r.month, r.status) for r in rows] == [("2001-08", None), ("2001-09", "good")]
    assert rows[1].growth == pytest.approx(1900 / 700 - 1)


def test_empty_revenue(rates):
    none = rates.where("false")
    row = only(revenue.revenue_summary(none))
    assert (row.invoice_count, row.total_billed, row.below_card) == (0, None, None)
    assert revenue.revenue_by_branch(none).isEmpty()
    assert only(revenue.revenue_latest_month(none)).month is None


@pytest.fixture(scope="module")
def billing(spark):
    lines = frames.invoice_lines(
        spark,
        {"UnitNumber": "F1", "InvoiceNo": "1", "BilledMonthlyRate": money(100)},
        {"UnitNumber": "F1", "InvoiceNo": "2", "BilledMonthlyRate": money(200), "BillingStopDate": day("2001-11-01")},
        {"UnitNumber": "F2", "InvoiceNo": "3", "BilledMonthlyRate": money(50), "LineKind": "REPAIR"},
        {"UnitNumber": "V1", "InvoiceNo": "4", "BilledMonthlyRate": money(900)},
        {"UnitNumber": "T1", "InvoiceNo": "5", "BilledMonthlyRate": money(900)},
        {"UnitNumber": "??", "InvoiceNo": "6", "BilledMonthlyRate": money(10)},
    )
    units = frames.trailers(
        spark,
        {"Unit": "F1", "Type": "FLATBED"},
        {"Unit": "F2", "Type": "FLATBED", "Fleetcity": "South"},
        {"Unit": "V1"},
        {"Unit": "T1", "Type": "FLATBED", "Fleetcity": "TBD"},
    )
    return lines, units, frames.card_rates(spark, ("DRY_VAN", "OTR_0", "53", 1000))


def test_units_without_card_rate(billing):
    rows = revenue.units_without_card_rate(*billing, as_of=AS_OF).collect()
    assert [(r.unit, r.avg_billed_rate, r.invoice_count) for r in rows] == [("F1", 150.0, 2), ("F2", 50.0, 1)]
    bucket = only(revenue.units_without_card_rate_summary(*billing, as_of=AS_OF))
    assert (bucket.unit_count, bucket.total_revenue_at_risk) == (2, money(350))
    total = only(revenue.revenue_at_risk_total(*billing, as_of=AS_OF, branch="South"))
    assert (total.total_units, total.total_revenue_at_risk) == (1, money(50))
    nothing = only(revenue.revenue_at_risk_total(*billing, as_of=AS_OF, branch="West"))
    assert (nothing.total_units, nothing.total_revenue_at_risk) == (0, 0)


def test_unit_totals_equal_the_line_level_view(billing):
    lines, units, card_rates = billing
    by_line = (
        revenue.select_revenue(revenue_details(lines, units, card_rates, as_of=AS_OF))
        .where("CardRateMonth IS NULL")
        .agg(F.countDistinct("UnitNumber").alias("n"), F.sum("BilledMonthlyRate").alias("m"))
    )
    total = only(revenue.revenue_at_risk_total(*billing, as_of=AS_OF))
    assert tuple(only(by_line)) == tuple(total)


def test_revenue_components_and_recent(billing):
    lines, units, _ = billing
    rows = {(r.month, r.branch): r for r in revenue.revenue_components(lines, units).collect()}
    assert rows["2001-10", "South"].repair_revenue == money(50) and rows["2001-10", "South"].lease_revenue == 0
    assert rows["2001-10", None].total_revenue == money(10)
    recent = {r.branch: r.total_revenue for r in revenue.recent_revenue_by_branch(lines, units, as_of=AS_OF).collect()}
    assert recent["North"] == money(1200) and recent[None] == money(10)


def test_branch_comparison(spark, billing, idle_rows):
    lines, units, _ = billing
    rows = {r.branch: r for r in revenue.branch_comparison(units, idle_rows, lines, as_of=AS_OF).collect()}
    assert (rows["North"].revenue_mtd, rows["North"].revenue_ytd, rows["North"].idle_count) == (
        money(200),
        money(1200),
        2,
    )
    assert rows["South"].revenue_mtd == 0


# Locations


@pytest.fixture(scope="module")
def positions(spark):
    units = frames.trailers(
        spark, {"Unit": "A"}, {"Unit": "B"}, {"Unit": "C"}, {"Unit": "D", "Status": "AVAILABLE"}, {"Unit": "E"}
    )
    leases = frames.leases(
        spark,
        {"LeaseID": 1, "Unit": "A", "CustomerID": 1},
        {"LeaseID": 2, "Unit": "A", "CustomerID": 2},
        {"LeaseID": 3, "Unit": "B", "DateOff": AS_OF.date()},
        {"LeaseID": 4, "Unit": "C"},
        {"LeaseID": 5, "Unit": "D"},
        {"LeaseID": 6, "Unit": "E", "LeaseStatus": "CLOSED"},
    )
    gps = frames.gps(
        spark,
        {"AssetName": "A", "State": None},
        {"AssetName": "B", "Latitude": None, "LastUpdate": AS_OF - dt.timedelta(hours=24)},
        {"AssetName": "D", "State": "D"},
    )
    return units, leases, gps


def test_leases_multiply_positions(positions):
    rows = locations.leased_locations(*positions, as_of=AS_OF).collect()
    assert sorted((r.unit, r.customer_id) for r in rows) == [("A", 1), ("A", 2)]
    assert locations.leased_locations(*positions, as_of=AS_OF, limit=1).count() == 1
    bounds = only(locations.location_bounds(*positions, as_of=AS_OF))
    assert (bounds.south, bounds.east, bounds.located_rows) == (40.0, -100.0, 2)


def test_stale_keeps_units_without_gps(positions):
    rows = locations.stale_gps(*positions, as_of=AS_OF).collect()
    assert [(r.unit, r.hours_since_update) for r in rows] == [("C", None)]
    later = AS_OF + dt.timedelta(minutes=1)
    assert [r.unit for r in locations.stale_gps(*positions, as_of=later).collect()] == ["C", "B"]
    assert only(locations.stale_gps_table(*positions, as_of=AS_OF)).last_location == "Unknown"


def test_states(positions):
    assert [tuple(r) for r in locations.locations_by_state(*positions).collect()] == [("S", 1)]
    assert only(locations.state_share(*positions, as_of=AS_OF)).share_percent == 50.0
    assert [r.unit for r in locations.away_from_branch(*positions).collect()] == ["B"]
    cards = only(locations.location_cards(*positions, as_of=AS_OF))
    assert (cards.trailers_with_gps, cards.states_covered, cards.top_state, cards.stale_count) == (2, 1, "S", 1)


def test_no_positions(positions):
    units, leases, gps = positions
    nothing = gps.where("false")
    assert locations.leased_locations(units, leases, nothing, as_of=AS_OF).isEmpty()
    assert locations.stale_gps(units, leases, nothing, as_of=AS_OF).count() == 4
    assert only(locations.location_bounds(units, leases, nothing, as_of=AS_OF)).south is None


# Combined figures and exports


def test_alerts(spark, fleet, rates):
    low = kpis.alerts(fleet, rates.where("BilledMonthlyRate = 900 AND CardRateMonth IS NOT NULL")).collect()
    assert [r.severity for r in low] == ["critical"]
    poor = frames.revenue(spark, {"BilledMonthlyRate": money(500)})
    assert [r.severity for r in kpis.alerts(fleet, poor).collect()] == ["critical", "warning"]
    full = frames.trailers(spark, {"Unit": "A"})
    assert [r.severity for r in kpis.alerts(full, rates).collect()] == ["good"]
    assert [r.severity for r in kpis.alerts(full.where("false"), rates).collect()] == ["critical"]


def test_overview_falls_back_to_available_units(spark, fleet, positions, rates, idle_rows):
    _, leases, gps = positions
    full = only(kpis.overview_kpis(fleet, leases, gps, idle_rows, rates, as_of=AS_OF))
    assert (full.idle_assets, full.critical_status, full.never_leased_status) == (4, "critical", "neutral")
    empty = only(kpis.overview_kpis(fleet, leases, gps, idle_rows.where("false"), rates, as_of=AS_OF))
    assert (empty.idle_assets, empty.critical_count, empty.critical_status) == (3, 0, "good")


def test_reports_honour_every_filter(fleet, idle_rows, rates):
    assert reports.report_inventory(fleet, as_of=AS_OF).count() == 7
    assert only(reports.report_inventory(fleet, as_of=AS_OF, status="BOS")).Unit == "F1"
    assert only(reports.report_inventory(fleet, as_of=AS_OF, type_bucket="REEFER")).LengthBucket == "40"
    assert reports.report_utilization(fleet, as_of=AS_OF, usage_category="STORAGE").isEmpty()
    assert reports.report_utilization(fleet, as_of=AS_OF, branch="North", type_bucket="DRY_VAN").count() == 1
    assert reports.report_idle(idle_rows).count() == 6
    assert only(reports.report_idle(idle_rows, idle_bucket="6-12")).Unit == "U6"
    assert [r.Unit for r in reports.report_critical_idle(idle_rows).collect()] == ["U2", "U3"]
    assert only(reports.report_never_leased(idle_rows)).MonthsSincePurchase == 30
    assert reports.report_revenue(rates).count() == 6
    assert reports.report_revenue(rates, as_of=dt.datetime(2001, 12, 15), period="L3M").count() == 5
    with pytest.raises(ValueError):
        reports.report_revenue(rates, period="L3M")


def test_unordered_reports_hold_the_same_rows(small):
    ordered = reports.report_inventory(small.trailers, as_of=AS_OF)
    loose = reports.report_inventory(small.trailers, as_of=AS_OF, ordered=False)
    assert ordered.exceptAll(loose).isEmpty() and ordered.count() == loose.count()


def test_one_row_combines_without_a_key(spark):
    left, right = spark.range(1).select(F.lit(1).alias("a")), spark.range(1).select(F.lit("x").alias("b"))
    assert tuple(only(selection.one_row(left, right))) == (1, "x")

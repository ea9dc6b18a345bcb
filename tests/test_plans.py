"""Plan facts that matter at scale."""

from __future__ import annotations

import re

import pytest

import frames
from frames import AS_OF
from yardline import registry
from yardline.plans import lease_history, store
from yardline.plans.revenue_details import revenue_details
from yardline.plans.sizing import broadcast_if_small
from yardline.sources import testdata

SF_DIR = "/root/testdata/sf0.01"
QUERIES = registry.queries()


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def scans(plan: str, table: str) -> int:
    return len(re.findall(rf"FileScan parquet .*{table}\.parquet", plan))


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan_of(query(spark, SF_DIR)) for name, query in QUERIES.items()}


def test_no_query_joins_without_a_key(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_no_query_runs_python(plans):
    for name, plan in plans.items():
        assert not re.search(r"Python|Pandas|ArrowEval", plan), name


def test_no_invoice_line_is_broadcast(plans):
    for name, plan in plans.items():
        for build in re.findall(r"BroadcastExchange.*?(?=\n\S|\Z)", plan, re.S):
            first_scan = re.search(r"FileScan parquet.*?(\w+)\.parquet", build)
            assert first_scan is None or first_scan.group(1) != "lineitem" or "HashAggregate" in build, name


def test_combined_breakdown_reads_units_once(plans):
    assert scans(plans["fleet_combined"], "part") == 1
    assert scans(plans["branch_summary"], "part") == 1
    assert scans(plans["idle_breakdown"], "orders") == 1
    assert scans(plans["variance_shares"], "lineitem") == 1
    assert scans(plans["revenue_latest_month"], "lineitem") == 1


def test_card_rates_are_broadcast(plans):
    assert re.search(r"BroadcastExchange.*\n.*LocalTableScan", plans["revenue_details"])


def test_revenue_summary_reads_two_line_columns(plans):
    scan = re.search(r"FileScan parquet \[(.*?)\].*lineitem", plans["revenue_summary"])
    assert len(scan.group(1).split(",")) == 2


def test_top_k_is_not_a_full_sort(plans):
    for name in ("critical_idle_top", "stale_gps_top", "bottom_branches", "latest_two_months"):
        assert "TakeOrderedAndProject" in plans[name], name


def test_rank_filter_limits_before_the_shuffle(plans):
    assert plans["most_available_type"].count("WindowGroupLimit") == 2


def test_snapshot_needs_no_window(plans):
    assert "Window" not in plans["idle_summary"] and "explode" not in plans["idle_summary"]


def test_months_are_spelled_out_after_they_are_counted(plans):
    """Only summed changes per month and branch become months."""
    for name in ("bucket_statistics", "fleet_kpis", "mom_change"):
        plan = plans[name]
        assert "Generate inline" in plan and "Generate explode(CASE" not in plan, name


def test_positions_are_joined_once(plans):
    for name in ("location_cards", "state_share"):
        assert scans(plans[name], "orders") == scans(plans[name], "events") == 1, name


def test_newest_of_many_events_needs_no_sort(spark, monkeypatch):
    names = ("stale_gps", "leased_locations", "away_from_branch")
    few = {name: sorted(map(str, QUERIES[name](spark, SF_DIR).collect())) for name in names}
    monkeypatch.setattr(testdata, "MANY_EVENTS", 0)
    for name in names:
        frame = QUERIES[name](spark, SF_DIR)
        assert "SortAggregate" not in plan_of(frame), name
        assert sorted(map(str, frame.collect())) == few[name], name


def test_lines_meet_small_units_before_a_shuffle(plans):
    for name in ("recent_revenue_by_branch", "branch_comparison"):
        assert not re.search(r"Exchange hashpartitioning\(UnitNumber", plans[name]), name


def test_newest_lease_needs_no_sort(plans):
    assert "SortAggregate" not in plans["idle_units_last_rate"]


def test_units_beyond_the_limit_are_not_broadcast(spark):
    inputs = testdata.load(spark, SF_DIR)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "1000")
    try:
        plan = plan_of(revenue_details(inputs.invoice_lines, inputs.trailers, inputs.card_rates, as_of=AS_OF))
        assert "SortMergeJoin" in plan and "BroadcastHashJoin [UnitNumber" not in plan
        assert broadcast_if_small(inputs.trailers) is inputs.trailers
    finally:
        spark.conf.set(key, before)


def test_shuffled_joins_give_the_same_rows(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    names = ("revenue_by_branch", "leased_locations", "idle_summary", "units_without_card_rate", "recent_revenue_by_branch", "branch_comparison")
    broadcast = {name: sorted(map(str, QUERIES[name](spark, SF_DIR).collect())) for name in names}
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        for name in names:
            assert sorted(map(str, QUERIES[name](spark, SF_DIR).collect())) == broadcast[name], name
    finally:
        spark.conf.set(key, before)


def test_stored_history_prunes_months(spark, tmp_path):
    units = frames.trailers(spark, {"Unit": "A"}, {"Unit": "B"})
    leases = frames.leases(spark, {"Unit": "A"})
    rates = frames.card_rates(spark, ("DRY_VAN", "OTR_0", "53", 1000))
    history = lease_history.idle_history(units, leases, rates, as_of=AS_OF, from_month="2001-01")
    store.save_idle_history(history, str(tmp_path / "idle"))
    stored = store.load_idle_history(spark, str(tmp_path / "idle"))
    plan = plan_of(stored.where("MonthStr = '2001-11'"))
    assert re.search(r"PartitionFilters: \[[^\]]*MonthStr", plan)

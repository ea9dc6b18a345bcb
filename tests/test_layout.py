"""Bucketed tables, split joins, one spelling of keys, money on longs, two-month statistics."""

from __future__ import annotations

import datetime as dt
import random
import re
import statistics as stats
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import frames
from frames import AS_OF, day, money
from yardline.functions import money as amounts
from yardline.operators import kpis, locations, revenue, utilization
from yardline.plans import colocated, lease_history, skew
from yardline.plans.revenue_details import revenue_details
from yardline.sources import collation, testdata

SF_DIR = "/root/testdata/sf0.001"


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def same_rows(left, right) -> bool:
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.fixture
def no_broadcast(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    inputs, folder = testdata.load(spark, SF_DIR), str(tmp_path_factory.mktemp("buckets"))
    colocated.save(inputs, folder, "layout_test", 4)
    return inputs, folder, colocated.load(spark, inputs, "layout_test")


def unit_exchanges(frame) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\((?:Unit|UnitNumber|AssetName)#[^)]*\)", plan_of(frame))


def test_bucketed_tables_need_no_exchange_on_the_unit(spark, bucketed, no_broadcast):
    inputs, _, tables = bucketed
    now = {"as_of": AS_OF}
    history = lease_history.idle_history(tables.trailers, tables.leases, inputs.card_rates, **now)
    details = revenue_details(tables.invoice_lines, tables.trailers, inputs.card_rates, **now)
    positions = tables.trailers.join(tables.asset_statuses, F.col("Unit") == F.col("AssetName"), "left")
    # The price list joins the units on other columns first; that side is dealt again, the large tables are not.
    for frame, table in ((history, "leases"), (details, "invoice_lines")):
        scans = [line for line in plan_of(frame).splitlines() if table in line and "Bucketed: true" in line]
        assert scans, table
    statistics = lease_history.bucket_statistics(tables.trailers, tables.leases, **now)
    for frame in (statistics, positions, lease_history.lease_states(tables.leases, **now)):
        assert not unit_exchanges(frame)
    assert unit_exchanges(lease_history.bucket_statistics(inputs.trailers, inputs.leases, **now))
    assert same_rows(history, lease_history.idle_history(inputs.trailers, inputs.leases, inputs.card_rates, **now))
    assert same_rows(details, revenue_details(inputs.invoice_lines, inputs.trailers, inputs.card_rates, **now))


def test_buckets_can_be_declared_again(spark, bucketed, no_broadcast):
    inputs, folder, tables = bucketed
    colocated.declare(spark, inputs, folder, "layout_again", 4)
    again = colocated.load(spark, inputs, "layout_again")
    assert same_rows(again.leases, tables.leases)
    assert not unit_exchanges(lease_history.bucket_statistics(again.trailers, again.leases, as_of=AS_OF))


# ---- skew


def test_a_heavy_unit_is_dealt_to_many_tasks(spark, no_broadcast):
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {key: spark.conf.get(key) for key in keys}
    try:
        for key, value in keys.items():
            spark.conf.set(key, value)
        facts = spark.range(60_000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 997)).alias("Unit"), F.col("id").alias("row"))
        units = spark.range(997).select(F.col("id").alias("Unit"), (F.col("id") * 2).alias("size"))
        joined = skew.split_join(facts, units, "Unit", tasks=8)
        held = [r[0] for r in joined.groupBy(F.spark_partition_id()).count().select("count").collect()]
        plain = [r[0] for r in facts.join(units, "Unit").groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert max(plain) > 2.5 * stats.median(plain)
        assert len(held) == 8 and max(held) <= 1.5 * stats.median(held)
        assert joined.columns == ["Unit", "row", "size"] and same_rows(joined, facts.join(units, "Unit"))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_split_joins_keep_rows(spark):
    rows = [("A", 1)] * 40 + [("B", 2), ("B", 2), ("C", 3), (None, 4), (None, 4)]
    facts = spark.createDataFrame(rows, "Unit string, n int")
    units = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "z"), ("D", "w"), (None, "v")], "Unit string, v string")
    for tasks in (1, 4, 50):
        got = Counter(map(tuple, skew.split_join(facts, units, "Unit", tasks=tasks).collect()))
        assert got == Counter(map(tuple, facts.join(units, "Unit").collect()))
    assert skew.split_join(facts.where("false"), units, "Unit", tasks=4).isEmpty()
    assert skew.split_join(facts, units.where("false"), "Unit", tasks=4).isEmpty()


def test_positions_of_a_heavy_unit(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(locations, "MANY_LEASES", 0)
    inputs = testdata.load(spark, SF_DIR)
    heavy = inputs.leases.withColumn("Unit", F.when(F.col("LeaseID") % 3 == 0, "U0000001").otherwise(F.col("Unit")))
    split = locations.stale_gps(inputs.trailers, heavy, inputs.asset_statuses, as_of=AS_OF)
    assert "xxhash64" in plan_of(split)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100MB")
    plain = locations.stale_gps(inputs.trailers, heavy, inputs.asset_statuses, as_of=AS_OF)
    assert "BroadcastHashJoin" in plan_of(plain) and same_rows(split, plain) and plain.count() > 50


# ---- one spelling


def test_keys_are_brought_to_one_spelling(spark):
    inputs = testdata.load(spark, SF_DIR)
    messy = testdata.misspelt(inputs)
    one = collation.collate_keys(messy)
    for name in ("leases", "asset_statuses", "invoice_lines"):
        assert same_rows(getattr(one, name), getattr(inputs, name))
        assert getattr(one, name).schema.names == getattr(inputs, name).schema.names
    spelled = [r[0] for r in one.trailers.select("Fleetcity").distinct().collect() if r[0]]
    assert len(spelled) == len({s.strip().lower() for s in spelled}) and len(spelled) > 5
    by_branch = utilization.utilization_by_branch(one.trailers)
    assert sorted(r.total_trailers for r in by_branch.collect()) == sorted(r.total_trailers for r in utilization.utilization_by_branch(inputs.trailers).collect())
    plan = plan_of(one.leases)
    assert "Cartesian" not in plan and "NestedLoop" not in plan and re.search(r"(BroadcastHash|SortMerge)Join .*collat", plan), plan


@pytest.mark.parametrize(
    "rule,expected",
    [
        (collation.IGNORE_CASE_AND_SPACES, ["A", "A", "A", "b", "b", "é ", "x", None]),
        (collation.IGNORE_CASE, ["A", "A", "A  ", "b", "b", "é ", "x ", None]),
        (collation.IGNORE_SPACES, ["A", "a", "A", "b", "B", "é ", "x", None]),
    ],
)
def test_texts_under_each_rule(spark, rule, expected):
    master = spark.createDataFrame([("A",), ("b",), ("é ",), (None,)], "k string")
    frame = spark.createDataFrame(list(enumerate(["A", "a", "A  ", "b", "B", "é ", "x ", None])), "i int, k string")
    got = collation.respelled(frame, "k", collation.spellings(master, "k", rule), rule)
    assert got.columns == ["i", "k"] and dict(got.dtypes)["k"] == "string"
    assert [r.k for r in got.orderBy("i").collect()] == expected


# ---- money


def test_totals_are_exact(spark):
    big = Decimal("9999999999999999.99")
    rows = [(1, big)] * 400 + [(1, -big), (2, Decimal("0.01")), (2, Decimal("-0.02")), (2, None), (3, None), (4, Decimal("10000000000000.01")), (4, Decimal("9999999999999.99"))]
    frame = spark.createDataFrame(rows, "k int, x decimal(18,2)")
    got = {r.k: (r.t, r.m) for r in frame.groupBy("k").agg(amounts.total(frame, "x").alias("t"), amounts.mean(frame, "x").alias("m")).collect()}
    assert got[1][0] == big * 399 and got[2] == (Decimal("-0.01"), -0.005) and got[3] == (None, None)
    assert got[4][0] == Decimal("20000000000000.00")
    plain = frame.groupBy("k").agg(F.sum("x").alias("t"), F.avg("x").cast("double").alias("m"))
    assert {r.k: (r.t, r.m) for r in plain.where("k > 1").collect()} == {k: v for k, v in got.items() if k > 1}
    assert frame.agg(amounts.total(frame, "x", F.col("k") == 2)).first()[0] == Decimal("-0.01")
    wide = frame.withColumn("x", F.col("x").cast("decimal(22,4)"))
    assert wide.groupBy("k").agg(amounts.total(wide, "x").alias("t")).where("k = 2").first().t == Decimal("-0.0100")
    assert frame.where("false").agg(amounts.total(frame, "x"), amounts.mean(frame, "x")).first() == (None, None)


def test_rates_sum_on_longs(spark):
    rates = frames.revenue(spark, {}, {"BilledMonthlyRate": money(1100.33)}, {"CardRateMonth": None})
    summary = revenue.revenue_summary(rates)
    assert "decimal(28,2)" in dict(summary.dtypes)["total_billed"]
    buffers = re.findall(r"HashAggregate\(keys=\[\], functions=\[(.*)\]", plan_of(summary))
    assert buffers and not any("partial_avg(BilledMonthlyRate" in b or "partial_sum(BilledMonthlyRate" in b for b in buffers)
    row = summary.first()
    assert (row.total_billed, row.avg_billed_rate, row.avg_card_rate, row.avg_variance) == (money(2000.33), 1000.165, 1000.0, 0.165)


def test_periods_in_one_pass(spark):
    rates = frames.revenue(spark, {"BillingStopDate": day("2001-11-01")}, {"BillingStopDate": day("2001-06-01")}, {"BillingStopDate": day("2000-12-14")})
    found = {r.period: (r.label, r.invoice_count, r.total_billed) for r in revenue.revenue_by_period(rates, as_of=AS_OF).collect()}
    assert found["L3M"] == ("Last 3 Months", 1, money(900)) and found["L6M"][1] == 2 and found["LTM"][1] == 3 and found["YTD"][1] == 2
    empty = {r.period: (r.invoice_count, r.total_billed) for r in revenue.revenue_by_period(rates.where("false"), as_of=AS_OF).collect()}
    assert set(empty.values()) == {(0, None)} and len(empty) == 5


# ---- two months of statistics


@pytest.mark.parametrize("sold", [None, "2001-06-10", "2001-11-15"])
def test_kpis_need_two_months_only(spark, sold):
    rng = random.Random(1)
    units = frames.trailers(spark, *[{"Unit": f"U{i}", "SoldDate": sold and day(sold), "Fleetcity": rng.choice(["North", "South"])} for i in range(12)])
    leases = frames.leases(
        spark,
        *[
            {"LeaseID": k, "Unit": f"U{k % 14}", "DateOn": day("2000-01-01") + dt.timedelta(days=11 * k), "DateOff": None if k % 9 == 0 else day("2000-01-20") + dt.timedelta(days=12 * k)}
            for k in range(60)
        ],
    )
    every = lease_history.bucket_statistics(units, leases, as_of=AS_OF)
    newest = lease_history.newest_fleet_month(units, as_of=AS_OF)
    two = lease_history.bucket_statistics(units, leases, as_of=AS_OF, from_month=newest - 1)
    months = sorted({r.Month for r in every.collect()})[-2:]
    assert same_rows(two, every.where(F.col("Month").isin(months))) and len({r.Month for r in two.collect()}) == 2
    for branch in (None, "North"):
        assert kpis.fleet_kpis(two, units, leases, as_of=AS_OF, branch=branch).collect() == kpis.fleet_kpis(every, units, leases, as_of=AS_OF, branch=branch).collect()
    none = units.where("false")
    assert lease_history.bucket_statistics(none, leases, as_of=AS_OF, from_month=lease_history.newest_fleet_month(none, as_of=AS_OF) - 1).isEmpty()


def test_the_map_limit_binds_with_ties(spark):
    units = frames.trailers(spark, *[{"Unit": f"U{i}"} for i in range(6)])
    leases = frames.leases(spark, *[{"LeaseID": k, "Unit": f"U{k // 3}", "CustomerID": 9 - k % 3} for k in range(18)])
    gps = frames.gps(spark, *[{"AssetName": f"U{i}"} for i in range(6)])
    for limit in (1, 4, 5, 18, 100):
        rows = locations.leased_locations(units, leases, gps, as_of=AS_OF, limit=limit).collect()
        want = sorted((f"U{k // 3}", 9 - k % 3) for k in range(18))[:limit]
        assert [(r.unit, r.customer_id) for r in rows] == want

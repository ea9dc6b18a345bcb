"""Every registered query, by name.

A query takes the session and a directory of test tables, derives the fleet
inputs from the whole tables and returns a lazy DataFrame.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yardline.functions import buckets, moments
from yardline.operators import audit, branches, idle, kpis, locations, reports, revenue, utilization
from yardline.plans import colocated, lease_history, nightly, store
from yardline.plans.revenue_details import revenue_details
from yardline.plans.units import enriched_trailers
from yardline.sources import collation, csv_sink, testdata
from yardline.sources.csv_sink import date_cells
from yardline.sources.folders import work_folder
from yardline.sources.inputs import Inputs
from yardline.sources.tables import run_query
from yardline.sources.testdata import AS_OF, FIRST_NIGHT

BRANCH = "Branch 3"
COARSE_IDLE_EDGES = (12, 24)
NOW = {"as_of": AS_OF}
# Exports grow with the tables: their text is written packed.
LINES_FILES = {"compression": "gzip"}

Query = Callable[[SparkSession, str], DataFrame]


class Fleet:
    """Inputs and derived views of one test directory, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def trailers(self) -> DataFrame:
        return testdata.trailers(self.spark, self.sf_dir)

    @cached_property
    def leases(self) -> DataFrame:
        return testdata.leases(self.spark, self.sf_dir)

    @cached_property
    def lines(self) -> DataFrame:
        return testdata.invoice_lines(self.spark, self.sf_dir)

    @cached_property
    def headers(self) -> DataFrame:
        return testdata.invoice_headers(self.spark, self.sf_dir)

    @cached_property
    def invoices(self) -> DataFrame:
        return testdata.invoices(self.spark, self.sf_dir)

    @cached_property
    def gps(self) -> DataFrame:
        return testdata.asset_statuses(self.spark, self.sf_dir)

    @cached_property
    def rates(self) -> DataFrame:
        return testdata.card_rates(self.spark)

    @cached_property
    def positions(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.trailers, self.leases, self.gps

    @cached_property
    def revenue(self) -> DataFrame:
        return revenue_details(self.lines, self.trailers, self.rates, **NOW)

    @cached_property
    def idle(self) -> DataFrame:
        return lease_history.idle_snapshot(self.trailers, self.leases, self.rates, **NOW)

    @cached_property
    def history(self) -> DataFrame:
        return lease_history.idle_history(self.trailers, self.leases, self.rates, **NOW)

    @cached_property
    def latest(self) -> DataFrame:
        return lease_history.latest_idle_month(self.trailers, self.leases, self.rates, **NOW)

    @cached_property
    def nightly(self) -> str:
        """A folder of stored views, built on a first night and brought to ``AS_OF`` by the changes since."""
        folder = work_folder(self.spark, "nightly")
        known = testdata.leases_as_known(self.leases, FIRST_NIGHT)
        nightly.first_night(self.trailers, known, self.rates, folder, as_of=FIRST_NIGHT)
        changes = testdata.lease_changes(self.leases, FIRST_NIGHT, AS_OF)
        nightly.next_night(self.spark, folder, self.trailers, changes, self.rates, **NOW)
        return folder

    @cached_property
    def stored_idle(self) -> str:
        """The stored idle history, its current month replaced once more from the snapshot."""
        path = work_folder(self.spark, "idle")
        store.save_idle_history(self.history, path, rebuild=True)
        store.replace_idle_months(self.idle, path, [moments.month_key(AS_OF)])
        return path

    @cached_property
    def one_spelling(self) -> Inputs:
        """Inputs with mixed case and trailing blanks in their keys, brought to one spelling."""
        return collation.collate_keys(testdata.misspelt(testdata.load(self.spark, self.sf_dir)))

    @cached_property
    def bucketed(self) -> Inputs:
        """The inputs, written to and read from buckets by unit."""
        inputs, folder = testdata.load(self.spark, self.sf_dir), work_folder(self.spark, "buckets")
        prefix = folder.rsplit("/", 1)[-1].replace("-", "_")
        colocated.save(inputs, folder, prefix, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return colocated.load(self.spark, inputs, prefix)

    @cached_property
    def stored_statistics(self) -> str:
        path = work_folder(self.spark, "statistics")
        store.save_bucket_statistics(self.statistics(), path, rebuild=True)
        return path

    def statistics(self, from_month: str | Column | None = None) -> DataFrame:
        return lease_history.bucket_statistics(self.trailers, self.leases, from_month=from_month, **NOW)

    @cached_property
    def newest_statistics(self) -> DataFrame:
        """Statistics of the newest month that has units and of the one before."""
        return self.statistics(lease_history.newest_fleet_month(self.trailers, **NOW) - 1)

    @cached_property
    def trend_statistics(self) -> DataFrame:
        """Statistics of the months the yearly trend shows."""
        return self.statistics(utilization.first_trend_month(AS_OF))


def _rounded(frame: DataFrame, column: str = "avg_variance_pct") -> DataFrame:
    """Round a mean of doubles, whose last digits depend on the order of the sum."""
    return frame.withColumn(column, F.round(column, 6))


def _audit(fleet: Fleet) -> DataFrame:
    return audit.source_audit(
        {
            "trailers": fleet.trailers,
            "leases": fleet.leases,
            "invoices": fleet.invoices,
            "invoice_lines": fleet.lines,
            "asset_statuses": fleet.gps,
            "card_rates": fleet.rates,
        }
    )


def _status_sql(fleet: Fleet) -> DataFrame:
    text = "SELECT Status AS status, max(Cost) AS highest_cost FROM {trailers} GROUP BY Status"
    return run_query(fleet.spark, text, trailers=fleet.trailers)


def _leased_sql(fleet: Fleet) -> DataFrame:
    text = (
        "SELECT t.Fleetcity AS branch, count(*) AS lease_count, sum(l.Rate) AS total_rate FROM {leases} l "
        "JOIN {trailers} t ON l.Unit = t.Unit WHERE t.Fleetcity <> :placeholder AND l.DateOn >= :since GROUP BY t.Fleetcity"
    )
    params = {"placeholder": "TBD", "since": dt.date(1996, 1, 1)}
    return run_query(fleet.spark, text, params, leases=fleet.leases, trailers=fleet.trailers)


def _bucketed_history(f: Fleet) -> DataFrame:
    return lease_history.idle_history(f.bucketed.trailers, f.bucketed.leases, f.rates, **NOW)


def _bucketed_revenue(f: Fleet) -> DataFrame:
    return date_cells(revenue_details(f.bucketed.invoice_lines, f.bucketed.trailers, f.rates, **NOW))


def _one_spelling_states(f: Fleet) -> DataFrame:
    return locations.locations_by_state(f.one_spelling.trailers, f.one_spelling.leases, f.one_spelling.asset_statuses)


def _reports(f: Fleet) -> dict[str, DataFrame]:
    return {
        "utilization": reports.report_utilization(f.trailers, **NOW),
        "inventory": reports.report_inventory(f.trailers, **NOW),
        "revenue": reports.report_revenue(f.revenue),
        "idle": reports.report_idle(f.idle),
        "critical-idle": reports.report_critical_idle(f.idle),
        "never-leased": reports.report_never_leased(f.idle),
        "locations": reports.report_locations(*f.positions, **NOW),
    }


def _inventory_round_trip(f: Fleet) -> DataFrame:
    """The inventory report, written as CSV and read back in its types."""
    folder, report = work_folder(f.spark, "exports"), _reports(f)["inventory"]
    csv_sink.export_report(report, "inventory", folder, **NOW)
    return csv_sink.read_report(f.spark, "inventory", folder, report.schema, **NOW)


def _revenue_export(f: Fleet) -> DataFrame:
    """All invoice lines, written in order by month and read back."""
    path, report = work_folder(f.spark, "lines"), reports.report_revenue(f.revenue)
    csv_sink.write_csv_by_month(report, path, "BillingStopDate", **LINES_FILES)
    return date_cells(csv_sink.read_csv(f.spark, path, report.schema))


def _empty_export(f: Fleet) -> DataFrame:
    """The status row of a report whose filter matches no unit."""
    folder, report = work_folder(f.spark, "exports"), reports.report_inventory(f.trailers, status="NO SUCH STATUS", **NOW)
    return csv_sink.export_status(f.spark, csv_sink.export_report(report, "inventory", folder, **NOW).path)


def _export_status(f: Fleet) -> DataFrame:
    """Status rows of all reports, and of one whose filter matches nothing, with the rows that read back."""
    told, empty = work_folder(f.spark, "exports"), reports.report_utilization(f.trailers, type_bucket="NO SUCH TYPE", **NOW)
    found = []
    for folder, selection, chosen in ((told, "all", _reports(f)), (f"{told}-none", "none", {"utilization": empty})):
        for name, report in chosen.items():
            result = csv_sink.export_report(report, name, folder, **NOW, **LINES_FILES)
            rows = csv_sink.read_report(f.spark, name, folder, report.schema, **NOW).agg(F.count(F.lit(1)).alias("rows_read"))
            status = csv_sink.export_status(f.spark, result.path)
            found.append(status.select(F.lit(selection).alias("selection"), "*", rows.scalar().alias("rows_read")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


_QUERIES: dict[str, Callable[[Fleet], DataFrame]] = {
    # Bucket codes
    "type_bucket": lambda f: f.trailers.select("Unit", buckets.type_bucket(F.col("Type")).alias("type_bucket")),
    "type_bucket_short": lambda f: f.trailers.select(
        "Unit", buckets.type_bucket(F.col("Type"), rare_as_specialty=False).alias("type_bucket")
    ),
    "usage_category": lambda f: f.trailers.select(
        "Unit", buckets.usage_category(F.col("Year"), AS_OF).alias("usage_category")
    ),
    "length_bucket": lambda f: f.trailers.select("Unit", buckets.length_bucket(F.col("Length")).alias("length_bucket")),
    # Derived views
    "trailers_enriched": lambda f: date_cells(enriched_trailers(f.trailers, **NOW)),
    "idle_history": lambda f: f.history,
    "bucket_statistics": lambda f: f.statistics(),
    "revenue_details": lambda f: date_cells(f.revenue),
    # Stored tables and views
    "idle_history_bucketed": _bucketed_history,
    "revenue_details_bucketed": _bucketed_revenue,
    "idle_history_incremental": lambda f: store.load_idle_history(f.spark, nightly.idle_path(f.nightly)),
    "bucket_statistics_incremental": lambda f: store.load_bucket_statistics(f.spark, nightly.statistics_path(f.nightly)),
    "idle_summary_stored": lambda f: idle.idle_summary(store.load_latest_idle_month(f.spark, f.stored_idle)),
    "idle_by_duration_stored": lambda f: idle.idle_by_duration(store.load_latest_idle_month(f.spark, f.stored_idle)),
    "idle_trend_stored": lambda f: idle.idle_trend(store.load_idle_history(f.spark, f.stored_idle)),
    "utilization_trend_stored": lambda f: utilization.utilization_trend(
        store.load_bucket_statistics(f.spark, f.stored_statistics), **NOW
    ),
    "latest_two_months_stored": lambda f: utilization.latest_two_months(
        store.load_bucket_statistics(f.spark, f.stored_statistics)
    ),
    # Utilization
    "global_utilization": lambda f: utilization.global_utilization(f.trailers),
    "global_utilization_of_branch": lambda f: utilization.global_utilization(f.trailers, branch=BRANCH),
    "status_counts": lambda f: utilization.status_counts(f.trailers),
    "utilization_by_branch": lambda f: utilization.utilization_by_branch(f.trailers),
    "utilization_by_type": lambda f: utilization.utilization_by_type(f.trailers, **NOW),
    "utilization_by_usage": lambda f: utilization.utilization_by_usage(f.trailers, **NOW),
    "utilization_matrix": lambda f: utilization.utilization_matrix(f.trailers, **NOW),
    "utilization_by_branch_filtered": lambda f: utilization.utilization_by_branch(f.trailers, type_bucket="DRY_VAN", **NOW),
    "utilization_by_usage_filtered": lambda f: utilization.utilization_by_usage(
        f.trailers, branch=BRANCH, type_bucket="DRY_VAN", **NOW
    ),
    "utilization_matrix_filtered": lambda f: utilization.utilization_matrix(
        f.trailers, type_bucket="REEFER", usage_category="OTR_0", **NOW
    ),
    "fleet_combined_filtered": lambda f: utilization.fleet_combined(f.trailers, type_bucket="DRY_VAN", **NOW),
    "utilization_display": lambda f: utilization.utilization_display(f.trailers),
    "utilization_pivot": lambda f: utilization.utilization_pivot(f.trailers, **NOW),
    "utilization_by_branch_type_age": lambda f: utilization.utilization_by_branch_type_age(f.trailers, **NOW),
    "utilization_by_branch_collated": lambda f: utilization.utilization_by_branch(f.one_spelling.trailers),
    "length_labelled": lambda f: utilization.length_labelled(f.trailers, **NOW),
    "usage_labelled": lambda f: utilization.usage_labelled(f.trailers, **NOW),
    "type_chart": lambda f: utilization.type_chart(f.trailers, **NOW),
    "fleet_combined": lambda f: utilization.fleet_combined(f.trailers, **NOW),
    "fleet_combined_of_branch": lambda f: utilization.fleet_combined(f.trailers, branch=BRANCH, **NOW),
    "fleet_combined_nested": lambda f: utilization.fleet_combined_json(f.trailers, **NOW),
    "fleet_combined_parsed": lambda f: utilization.parse_breakdown(
        utilization.fleet_combined_json(f.trailers, **NOW), "matrix_json"
    ),
    "utilization_trend": lambda f: utilization.utilization_trend(f.trend_statistics, **NOW),
    "utilization_trend_of_branch": lambda f: utilization.utilization_trend(f.trend_statistics, branch=BRANCH, **NOW),
    "utilization_trend_by_branch": lambda f: utilization.utilization_trend_by_branch(f.trend_statistics, **NOW),
    "latest_two_months": lambda f: utilization.latest_two_months(f.statistics()),
    "mom_change": lambda f: utilization.mom_change(f.statistics()),
    "mom_change_of_branch": lambda f: utilization.mom_change(f.statistics(), branch=BRANCH),
    # Branches
    "active_branches": lambda f: branches.active_branches(f.trailers),
    "branch_summary": lambda f: branches.branch_summary(f.trailers),
    "branch_summary_of_branch": lambda f: branches.branch_summary(f.trailers, branch=BRANCH),
    "most_available_type": lambda f: branches.most_available_type(f.trailers),
    "branch_composition": lambda f: branches.branch_composition(f.trailers, **NOW),
    "branch_status": lambda f: branches.branch_status(f.trailers),
    "bottom_branches": lambda f: branches.bottom_branches(f.trailers),
    "branch_comparison": lambda f: revenue.branch_comparison(f.trailers, f.idle, f.lines, **NOW),
    # Idle assets
    "idle_summary": lambda f: idle.idle_summary(f.idle),
    "idle_summary_of_branch": lambda f: idle.idle_summary(f.idle, branch=BRANCH),
    "idle_summary_all_branches": lambda f: idle.idle_summary(f.idle, exclude_placeholder=False),
    "idle_status": lambda f: idle.idle_status(f.idle),
    "idle_by_duration": lambda f: idle.idle_by_duration(f.idle),
    "idle_duration_options": lambda f: idle.idle_duration_options(f.idle),
    "idle_by_duration_coarse": lambda f: idle.idle_by_duration(
        lease_history.idle_snapshot(f.trailers, f.leases, f.rates, edges=COARSE_IDLE_EDGES, **NOW),
        edges=COARSE_IDLE_EDGES,
    ),
    "idle_by_branch": lambda f: idle.idle_by_branch(f.idle),
    "idle_by_branch_all_branches": lambda f: idle.idle_by_branch(f.idle, exclude_placeholder=False),
    "idle_by_type": lambda f: idle.idle_by_type(f.idle),
    "idle_by_usage": lambda f: idle.idle_by_usage(f.idle),
    "idle_trend": lambda f: idle.idle_trend(f.history),
    "idle_summary_latest_month": lambda f: idle.idle_summary(f.latest),
    "idle_by_duration_latest_month": lambda f: idle.idle_by_duration(f.latest),
    "report_idle_latest_month": lambda f: reports.report_idle(f.latest),
    "idle_summary_filtered": lambda f: idle.idle_summary(f.idle, type_bucket="DRY_VAN", usage_category="CART_1"),
    "idle_by_branch_filtered": lambda f: idle.idle_by_branch(f.idle, type_bucket="DRY_VAN", idle_bucket="0-6"),
    "idle_by_duration_filtered": lambda f: idle.idle_by_duration(f.idle, branch=BRANCH, usage_category="STORAGE"),
    "idle_matrix_filtered": lambda f: idle.idle_matrix(f.idle, branch=BRANCH, idle_bucket="0-6 Months"),
    "idle_matrix": lambda f: idle.idle_matrix(f.idle),
    "idle_breakdown": lambda f: idle.idle_breakdown(f.idle),
    "idle_breakdown_top": lambda f: idle.idle_breakdown(f.idle, limit=idle.TOP_TYPES),
    "idle_top_branches": lambda f: idle.idle_top_branches(f.idle),
    "never_leased": lambda f: idle.never_leased(f.idle),
    "never_leased_by_branch": lambda f: idle.never_leased_by_branch(f.idle),
    "never_leased_share": lambda f: idle.never_leased_share(f.idle),
    "critical_idle": lambda f: idle.critical_idle(f.idle),
    "critical_idle_top": lambda f: idle.critical_idle_top(f.idle),
    "critical_idle_table": lambda f: idle.critical_idle_table(f.idle),
    "idle_units_last_rate": lambda f: idle.idle_units_last_rate(f.trailers, f.leases, **NOW),
    # Revenue
    "variance_pct": lambda f: revenue.variance_lines(f.revenue),
    "revenue_summary": lambda f: _rounded(revenue.revenue_summary(f.revenue)),
    "revenue_summary_of_branch": lambda f: _rounded(revenue.revenue_summary(f.revenue, branch=BRANCH)),
    "revenue_summary_of_period": lambda f: _rounded(revenue.revenue_summary(f.revenue, period="L6M", **NOW)),
    "revenue_by_period": lambda f: revenue.revenue_by_period(f.revenue, **NOW),
    "invoice_totals": lambda f: revenue.invoice_totals(f.headers, f.lines),
    "invoice_reconciliation": lambda f: revenue.invoice_reconciliation(f.invoices, f.lines),
    "invoice_reconciliation_summary": lambda f: revenue.reconciliation_summary(
        revenue.invoice_reconciliation(f.invoices, f.lines)
    ),
    "lines_without_header": lambda f: revenue.lines_without_header(f.invoices, f.lines),
    "headers_without_lines": lambda f: revenue.headers_without_lines(f.invoices, f.lines),
    "rate_share": lambda f: revenue.rate_share(f.revenue),
    "revenue_by_branch": lambda f: _rounded(revenue.revenue_by_branch(f.revenue)),
    "branch_rate_status": lambda f: _rounded(revenue.branch_rate_status(f.revenue), "variance"),
    "revenue_by_type": lambda f: revenue.revenue_by_type(f.revenue),
    "revenue_type_chart": lambda f: revenue.type_chart(f.revenue),
    "revenue_by_usage": lambda f: revenue.revenue_by_usage(f.revenue),
    "revenue_trend": lambda f: revenue.revenue_trend(f.revenue),
    "revenue_latest_month": lambda f: _rounded(revenue.revenue_latest_month(f.revenue)),
    "revenue_latest_month_of_branch": lambda f: _rounded(revenue.revenue_latest_month(f.revenue, branch=BRANCH)),
    "variance_distribution": lambda f: revenue.variance_distribution(f.revenue),
    "variance_shares": lambda f: revenue.variance_shares(f.revenue),
    "units_without_card_rate": lambda f: revenue.units_without_card_rate(f.lines, f.trailers, f.rates, **NOW),
    "units_without_card_rate_summary": lambda f: revenue.units_without_card_rate_summary(
        f.lines, f.trailers, f.rates, **NOW
    ),
    "units_without_card_rate_top": lambda f: revenue.units_without_card_rate_summary(
        f.lines, f.trailers, f.rates, limit=revenue.TOP_MISSING_BUCKETS, **NOW
    ),
    "revenue_at_risk_total": lambda f: revenue.revenue_at_risk_total(f.lines, f.trailers, f.rates, **NOW),
    "recent_revenue_by_branch": lambda f: revenue.recent_revenue_by_branch(f.lines, f.trailers, **NOW),
    "revenue_growth": lambda f: revenue.revenue_growth(f.revenue),
    "revenue_components": lambda f: revenue.revenue_components(f.lines, f.trailers),
    "rate_realization": lambda f: revenue.rate_realization(f.trailers, f.leases, f.rates, **NOW),
    # Locations
    "leased_locations": lambda f: locations.leased_locations(*f.positions, **NOW),
    "leased_locations_map": lambda f: locations.leased_locations(
        *f.positions, rare_as_specialty=False, limit=locations.MAP_LIMIT, **NOW
    ),
    "leased_locations_filtered": lambda f: locations.leased_locations(
        *f.positions, branch=BRANCH, type_bucket="REEFER", **NOW
    ),
    "locations_by_state_of_branch": lambda f: locations.locations_by_state(*f.positions, branch=BRANCH),
    "stale_gps_of_branch": lambda f: locations.stale_gps(*f.positions, branch=BRANCH, **NOW),
    "location_bounds": lambda f: locations.location_bounds(*f.positions, **NOW),
    "locations_by_state": lambda f: locations.locations_by_state(*f.positions),
    "locations_by_state_collated": _one_spelling_states,
    "state_share": lambda f: locations.state_share(*f.positions, **NOW),
    "location_cards": lambda f: locations.location_cards(*f.positions, **NOW),
    "stale_gps": lambda f: locations.stale_gps(*f.positions, **NOW),
    "stale_gps_top": lambda f: locations.stale_gps_table(*f.positions, **NOW),
    "away_from_branch": lambda f: locations.away_from_branch(*f.positions),
    # Combined key figures
    "fleet_kpis": lambda f: kpis.fleet_kpis(f.newest_statistics, f.trailers, f.leases, **NOW),
    "fleet_kpis_of_branch": lambda f: kpis.fleet_kpis(
        f.newest_statistics, f.trailers, f.leases, branch=BRANCH, period="L3M", **NOW
    ),
    "alerts": lambda f: _rounded(kpis.alerts(f.trailers, f.revenue), "value"),
    "overview_kpis": lambda f: _rounded(kpis.overview_kpis(*f.positions, f.idle, f.revenue, **NOW)),
    "overview_kpis_of_branch": lambda f: _rounded(
        kpis.overview_kpis(*f.positions, f.idle, f.revenue, branch=BRANCH, **NOW)
    ),
    # Detail exports, with the date cells of the CSV files
    "report_utilization": lambda f: date_cells(reports.report_utilization(f.trailers, **NOW)),
    "report_utilization_filtered": lambda f: date_cells(
        reports.report_utilization(f.trailers, type_bucket="REEFER", usage_category="OTR_0", **NOW)
    ),
    "report_inventory": lambda f: date_cells(reports.report_inventory(f.trailers, **NOW)),
    "report_inventory_filtered": lambda f: date_cells(
        reports.report_inventory(f.trailers, branch=BRANCH, type_bucket="DRY_VAN", status="BOS", **NOW)
    ),
    "report_revenue": lambda f: date_cells(reports.report_revenue(f.revenue)),
    "report_revenue_filtered": lambda f: date_cells(
        reports.report_revenue(f.revenue, branch=BRANCH, type_bucket="REEFER", period="L6M", **NOW)
    ),
    "report_idle": lambda f: reports.report_idle(f.idle),
    "report_idle_filtered": lambda f: reports.report_idle(
        f.idle, branch=BRANCH, type_bucket="DRY_VAN", idle_bucket="6-12"
    ),
    "report_critical_idle": lambda f: reports.report_critical_idle(f.idle),
    "report_never_leased": lambda f: reports.report_never_leased(f.idle),
    "report_locations": lambda f: date_cells(reports.report_locations(*f.positions, **NOW)),
    "report_critical_idle_filtered": lambda f: reports.report_critical_idle(f.idle, branch=BRANCH),
    "report_never_leased_filtered": lambda f: reports.report_never_leased(f.idle, type_bucket="DRY_VAN"),
    "report_locations_filtered": lambda f: date_cells(reports.report_locations(*f.positions, state="S03", **NOW)),
    # Exports, written and read back
    "csv_round_trip": _inventory_round_trip,
    "revenue_export": _revenue_export,
    "empty_export": _empty_export,
    "export_status": _export_status,
    "source_audit": _audit,
    # SQL text, without and with bound parameters
    "sql_text": _status_sql,
    "sql_text_with_parameters": _leased_sql,
}


def _bind(build: Callable[[Fleet], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(Fleet(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {name: _bind(build) for name, build in _QUERIES.items()}

"""Physical-plan checks: the plans we want at scale, not just the right rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from opsframes.operators import activity as A
from opsframes.operators import logs as L
from opsframes.sources.catalog import catalog

from conftest import SF_SMALL

STREAM_KEYS = {"stream_log_volume", "stream_alerts", "stream_alert_actions", "export_table",
               "export_table_csv", "text_logs_quarantine"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return catalog(spark, SF_SMALL)


def test_top_k_is_take_ordered(spark, tables):
    for df in (A.top_users(tables.user_activities), L.recent_logs(tables.logs),
               L.search_logs(tables.logs, "slow")):
        p = plan(df)
        assert "TakeOrderedAndProject" in p, p


def test_date_range_reaches_the_scan(spark, tables):
    df = L.classified_logs(tables.logs, start="2024-01-10", end="2024-01-12")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp,2024-01-10T00:00)," in p, p
    assert "LessThan(timestamp,2024-01-13T00:00)" in p


def test_known_date_range_prunes_partitions(spark, tables):
    df = L.classified_logs(tables.between("logs", "2024-01-10", "2024-01-12"), start="2024-01-10",
                           end="2024-01-12")
    p = plan(df)
    assert "PartitionFilters: [isnotnull(date" in p and "(date#" in p, p
    assert "date" not in df.columns
    assert df.count() == L.classified_logs(tables.logs, start="2024-01-10", end="2024-01-12").count()


def test_scan_reads_only_needed_columns(spark, tables):
    p = plan(L.log_volume(tables.logs))
    assert "ReadSchema: struct<timestamp:timestamp_ntz,severity:string>" in p, p


def test_summary_cards_scan_once(spark, tables):
    for df in (A.activity_summary(tables.user_activities), L.error_summary(tables.logs)):
        assert plan(df).count("FileScan parquet") == 1


def test_distinct_counts_work_on_pairs_not_on_rows(spark, tables):
    p = plan(A.activity_summary(tables.user_activities))
    # bottom up: the scan, the count per pair, and only then the doubling for two distinct counts
    below = p[p.index("Expand"):]
    assert "functions=[partial_count(1)" in below[:below.index("FileScan")], p


def test_latest_action_hash_aggregates(spark, tables):
    from opsframes.operators import alerts as AL
    assert "SortAggregate" not in plan(AL.apply_alert_actions(tables.alerts, tables.alert_actions))


def test_crosstab_scans_once_without_pivot(spark, tables):
    p = plan(L.log_class_by_severity(tables.logs))
    assert "pivotfirst" not in p.lower()
    assert "FileScan" not in p.split("InMemoryRelation")[0] and p.count("InMemoryTableScan") == 1  # the counts are kept, the logs not read again


def test_alert_rules_of_a_table_share_a_scan(spark, tables):
    """As run: the plan after reuse of exchanges."""
    from opsframes.operators import rules as R

    def ran(df) -> str:
        df.collect()
        p = plan(df)
        return p.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]

    p = ran(R.log_alerts(tables.logs))
    assert p.count("FileScan parquet") == 1 and p.count("Exchange hashpartitioning") == 2 and "SortAggregate" not in p, p
    p = ran(R.activity_alerts(tables.user_activities))
    assert p.count("FileScan parquet") == 1 and "ReusedExchange" in p and "SortAggregate" not in p and "Window" not in p, p
    p = ran(R.generate_alerts(*[tables.between(n) for n in ("logs", "api_metrics", "infra_metrics", "user_activities")]))
    at = {n: sum("FileScan parquet" in line and f"/{n}]" in line for line in p.splitlines()) for n in ("logs", "api_metrics", "user_activities")}
    assert at == {"logs": 1, "api_metrics": 1, "user_activities": 2}, p


@pytest.mark.parametrize("name", ["api_avg_last_day", "api_overview", "api_avg_by_endpoint", "endpoint_response_range", "cpu_gauges",
                                  "server_trend", "server_network_range"])
def test_ranges_up_to_the_latest_row_prune_dates(spark, tables, name):
    """A partition filter on every scan, so that only the dates that the range reaches are listed and read."""
    p = plan(E.queries()[name](spark, SF_SMALL))
    scans = [line for line in p.splitlines() if "FileScan parquet" in line]
    assert scans and all("PartitionFilters: [isnotnull(date" in line and "date#" in line for line in scans), p


def test_recent_holds_what_the_range_takes(spark, tables):
    from pyspark.sql import functions as F
    from opsframes.functions.params import since
    for name in ("api_metrics", "infra_metrics"):
        full = getattr(tables, name)
        for code in ("24h", "3d", "1w"):
            want = full.where(since("timestamp", full, code))
            few = tables.recent(name, code)
            assert few.where(since("timestamp", few, code)).exceptAll(want).count() == 0
            assert want.exceptAll(few).count() == 0 and few.count() < full.count()
        assert tables.recent(name).select(F.to_date("timestamp")).distinct().count() == 1


def test_no_registered_query_pairs_rows(spark, tables):
    """No cartesian products or nested-loop joins anywhere in the registry."""
    for name, fn in E.queries().items():
        if name in STREAM_KEYS:
            continue
        p = plan(fn(spark, SF_SMALL))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in p, (name, bad)


def test_no_python_udfs_in_registered_queries(spark, tables):
    for name, fn in E.queries().items():
        if name in STREAM_KEYS:
            continue
        p = plan(fn(spark, SF_SMALL))
        for bad in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
            assert bad not in p, (name, bad)


def test_new_location_joins_aggregated_sides(spark, tables):
    from opsframes.operators.rules import suspicious_new_location

    df = suspicious_new_location(tables.user_activities)
    p = optimized(df)
    # both sides of the join are aggregates: a hot user is collapsed before the shuffle
    assert p.count("Aggregate") >= 2 and "Window" not in p
    # the per-user firsts come from the per-(user, ip) firsts: the activities are scanned once
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1, final


def test_hot_paths_run_in_whole_stage_codegen(spark, tables):
    """Scan, filter, projection and partial aggregation fuse into generated code (``*(n)`` nodes)."""
    import re

    for df in (L.log_volume(tables.logs), L.error_summary(tables.logs), A.top_users(tables.user_activities),
               L.classified_logs(tables.logs, severities=["ERROR"])):
        df.collect()  # executes this DataFrame's own plan, so AQE's final plan is what we read
        p = plan(df)
        assert re.search(r"\*\(\d+\) (Filter|HashAggregate|Project|ColumnarToRow)", p), p

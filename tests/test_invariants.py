"""Invariants over the test tables: totals, shares, paging, range nesting."""

from __future__ import annotations

import pytest

from opsframes.operators import activity as A
from opsframes.operators import alerts as AL
from opsframes.operators import logs as L
from opsframes.operators import metrics as M
from opsframes.operators import views as V
from opsframes.sources.catalog import catalog

from conftest import SF_SMALL, rows


@pytest.fixture(scope="module")
def t(spark):
    return catalog(spark, SF_SMALL)


def test_group_counts_sum_to_total(t):
    n = t.logs.count()
    assert sum(r[0] for r in rows(L.log_volume(t.logs), "count")) == n
    assert sum(r[0] for r in rows(L.logs_by_endpoint(t.logs), "count")) == n
    errors = t.logs.where("severity in ('ERROR', 'CRITICAL')").count()
    assert sum(r[0] for r in rows(L.error_trend(t.logs), "count")) == errors
    s = L.error_summary(t.logs).collect()[0]
    assert s["errors"] + s["critical"] == errors
    xt = L.log_class_by_severity(t.logs).collect()
    assert sum(sum(v for k, v in r.asDict().items() if k != "log_class") for r in xt) == n


def test_shares_sum_to_one(t):
    for df in (L.log_class_counts(t.logs), A.action_counts(t.user_activities), AL.alerts_by_type(t.alerts)):
        assert abs(sum(r[0] for r in rows(df, "share")) - 1.0) < 1e-12


def test_pages_are_disjoint_and_cover(t):
    errors = t.logs.where("severity = 'ERROR'")
    n = errors.count()
    sort = [("timestamp", "desc"), ("log_id", "desc")]
    pages = []
    p = 0
    while True:
        page = rows(V.table_page(t.logs, {"severity": "ERROR"}, sort, page=p, size=7), "log_id")
        if not page:
            break
        pages.extend(r[0] for r in page)
        p += 1
    assert len(pages) == len(set(pages)) == n


def test_keyset_pages_equal_offset_pages(t):
    sort = [("timestamp", "desc"), ("log_id", "desc")]
    after = None
    for p in range(4):
        by_offset = rows(V.table_page(t.logs, {"severity": ["ERROR", "CRITICAL"]}, sort, page=p, size=5))
        by_key = rows(V.page_after(t.logs, sort, after, size=5, filters={"severity": ["ERROR", "CRITICAL"]}))
        assert by_offset == by_key
        after = (by_key[-1][1], by_key[-1][0])


def test_column_filter_ops(t):
    everything = 10 ** 6
    typed = rows(V.table_page(t.logs, {"message": "Invalid"}, size=everything), "log_id")
    assert typed and sorted(typed) == sorted(rows(V.table_page(t.logs, {"message": ("contains", "Invalid")}, size=everything), "log_id"))
    assert V.table_page(t.logs, {"message": ("=", "Invalid")}, size=everything).count() == 0
    day = str(t.logs.agg({"timestamp": "min"}).first()[0])[:10]
    assert V.table_page(t.logs, {"timestamp": ("datestartswith", day)}, size=everything).count() == \
        t.logs.where(f"date(timestamp) = date'{day}'").count() > 0
    assert V.table_page(t.logs, {"message": ("contains", "Invalid")}, size=10 ** 6).count() == \
        t.logs.where("severity = 'ERROR'").count()
    assert V.table_page(t.logs, {"log_id": (">=", 990)}, size=10 ** 6).count() == 10


def test_narrower_range_within_wider(t):
    day = {r[0]: r[1:] for r in rows(M.api_avg_by_endpoint(t.api_metrics, range_code="24h"))}
    assert day and len(day) <= len({r[0] for r in rows(M.api_avg_by_endpoint(t.api_metrics, range_code="3d"))})
    n = {code: M.server_trend(t.infra_metrics, "server-1", code).count() for code in ("24h", "3d", "1w", None)}
    assert n["24h"] <= n["3d"] <= n["1w"] <= n[None]
    assert M.server_network(t.infra_metrics, "server-1").count() == 2 * n[None]


def test_log_flags_single_label(t):
    got = rows(V.row_flags(t.logs, V.LOG_ROW_RULES).select("severity", "flags").distinct())
    expect = {"ERROR": ["error"], "CRITICAL": ["critical"], "WARNING": ["warning"], "INFO": []}
    assert {r[0]: r[1] for r in got} == expect


def test_generated_alert_keys_unique_and_mapped(t):
    from pyspark.sql import functions as F

    from opsframes import schemas as S
    from opsframes.operators import rules as R

    alerts = R.generate_alerts(t.logs, t.api_metrics, t.infra_metrics, t.user_activities, response_ms=100.0)
    n, keys = alerts.agg(F.count(F.lit(1)), F.count_distinct("alert_key")).collect()[0]
    assert n == keys and n > 0
    for r in alerts.groupBy("type", "severity", "priority", "status").count().collect():
        assert r["type"] in S.ALERT_TYPES and r["status"] == "active"
        assert r["severity"] == R.RULE_SEVERITY[r["type"]]
        assert r["priority"] == S.PRIORITY_OF_SEVERITY[r["severity"]]


def test_between_same_rows_lazy_and_stored(spark, t):
    from opsframes.sources.tables import load

    lazy = load(spark, SF_SMALL)
    a = sorted(rows(t.between("logs", "2024-01-03", "2024-01-04").select("log_id")))
    b = sorted(rows(lazy.between("logs", "2024-01-03", "2024-01-04").select("log_id")))
    assert a == b and a
    t.register("t_")
    assert spark.sql("select count(*) from t_logs").collect()[0][0] == t.logs.count()


def test_range_codes(t):
    import datetime as dt

    n = {c: M.server_trend(t.infra_metrics, "server-1", c).count() for c in ("1w", "bogus", None, "24h")}
    assert n["bogus"] == n["1w"]
    latest = t.infra_metrics.agg({"timestamp": "max"}).collect()[0][0]
    want = t.infra_metrics.where(
        (t.infra_metrics.server == "server-1") & (t.infra_metrics.timestamp >= latest - dt.timedelta(days=1))).count()
    assert n["24h"] == want

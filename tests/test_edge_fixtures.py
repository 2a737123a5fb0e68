"""Hand-written edge fixtures (FIXTURES.md section 3), one test per rule."""

from __future__ import annotations

from conftest import (make_actions, make_activities, make_alerts, make_api, make_infra, make_logs, rows)

from opsframes.operators import activity as A
from opsframes.operators import alerts as AL
from opsframes.operators import logs as L
from opsframes.operators import metrics as M
from opsframes.operators import views as V


def _log(i, t, sev="INFO", ep="/api/users", user="user_1", msg="m", cls="Network"):
    return (i, t, sev, ep, user, msg, cls)


def test_crosstab_absent_cell_is_zero(spark):
    logs = make_logs(spark, [
        _log(1, "2024-01-01 01:00:00", "CRITICAL", cls="Network"),
        _log(2, "2024-01-01 02:00:00", "INFO", cls="Database"),
        _log(3, "2024-01-01 03:00:00", "ERROR", cls="Database"),
    ])
    out = {r["log_class"]: r.asDict() for r in L.log_class_by_severity(logs).collect()}
    assert out["Database"]["CRITICAL"] == 0
    assert out["Database"]["ERROR"] == 1 and out["Network"]["CRITICAL"] == 1
    assert L.log_class_by_severity(logs).columns == ["log_class", "CRITICAL", "ERROR", "INFO", "WARNING"]


def test_search_is_case_insensitive_regex(spark):
    logs = make_logs(spark, [
        _log(1, "2024-01-01 01:00:00", msg="value a.b here"),
        _log(2, "2024-01-01 02:00:00", msg="value AXB here"),
        _log(3, "2024-01-01 03:00:00", msg="value ab here"),
        _log(4, "2024-01-01 04:00:00", ep="/api/Orders"),
    ])
    assert sorted(r[0] for r in rows(L.search_logs(logs, "a.b"), "log_id")) == [1, 2]
    assert sorted(r[0] for r in rows(L.search_logs(logs, "ORDERS|axb"), "log_id")) == [2, 4]
    # no term: the newest rows, newest first
    assert [r[0] for r in rows(L.search_logs(logs, "", n=2), "log_id")] == [4, 3]


def test_date_range_inclusive_and_needs_both_ends(spark):
    logs = make_logs(spark, [
        _log(1, "2024-01-01 23:59:59"),
        _log(2, "2024-01-02 00:00:00"),
        _log(3, "2024-01-02 23:59:59"),
        _log(4, "2024-01-03 00:00:00"),
    ])
    got = sorted(r[0] for r in rows(L.classified_logs(logs, start="2024-01-02", end="2024-01-02"), "log_id"))
    assert got == [2, 3]
    got = sorted(r[0] for r in rows(L.classified_logs(logs, start="2024-01-01", end="2024-01-03"), "log_id"))
    assert got == [1, 2, 3, 4]
    assert L.classified_logs(logs, start="2024-01-02").count() == 4
    assert L.classified_logs(logs, end="2024-01-02").count() == 4


def test_empty_selection_all_and_none_mean_no_filter(spark):
    logs = make_logs(spark, [
        _log(1, "2024-01-01 01:00:00", "ERROR", ep="/api/users"),
        _log(2, "2024-01-01 02:00:00", "CRITICAL", ep="/api/orders"),
        _log(3, "2024-01-01 03:00:00", "INFO"),
    ])
    for sev in ("all", None):
        assert L.error_logs(logs, sev, []).count() == 2
        assert L.error_logs(logs, sev, None).count() == 2
    assert L.error_logs(logs, "ERROR", ["/api/orders"]).count() == 0
    assert L.classified_logs(logs, [], [], None, None).count() == 3
    assert sum(r[0] for r in rows(L.log_volume(logs, []), "count")) == 3
    assert sum(r[0] for r in rows(L.log_volume(logs, ["ERROR"]), "count")) == 1


def test_mean_of_means_is_unweighted(spark):
    api = make_api(spark, [
        ("2024-01-05 01:00:00", "/api/users", 100.0, 1.0, 10.0),
        ("2024-01-05 02:00:00", "/api/users", 100.0, 1.0, 10.0),
        ("2024-01-05 03:00:00", "/api/users", 100.0, 1.0, 10.0),
        ("2024-01-05 01:00:00", "/api/orders", 400.0, 3.0, 20.0),
    ])
    over = M.api_overview(api).collect()[0]
    assert over["avg_response_time"] == 250.0  # (100 + 400) / 2, not 175
    assert over["avg_error_rate"] == 2.0 and over["active_endpoints"] == 7


def test_last_calendar_day_differs_from_last_24h(spark):
    api = make_api(spark, [
        ("2024-01-04 22:00:00", "/api/users", 1000.0, 0.0, 1.0),
        ("2024-01-05 00:00:00", "/api/users", 100.0, 0.0, 1.0),
        ("2024-01-05 01:00:00", "/api/users", 200.0, 0.0, 1.0),
    ])
    last_day = M.api_avg_last_day(api).collect()[0]["response_time"]
    last_24h = M.api_avg_by_endpoint(api, range_code="24h").collect()[0]["response_time"]
    assert last_day == 150.0
    assert abs(last_24h - 1300.0 / 3) < 1e-9


def test_snapshot_skips_servers_missing_at_latest_timestamp(spark):
    infra = make_infra(spark, [
        ("2024-01-05 10:00:00", "server-1", 10.0, 1.0, 1.0, 1.0, 1.0),
        ("2024-01-05 10:00:00", "server-2", 20.0, 1.0, 1.0, 1.0, 1.0),
        ("2024-01-05 11:00:00", "server-1", 30.0, 1.0, 1.0, 1.0, 1.0),
    ])
    got = rows(M.cpu_gauges(infra), "server", "cpu_usage")
    assert got == [("server-1", 30.0)]


def test_per_server_snapshot_keeps_silent_servers(spark):
    infra = make_infra(spark, [
        ("2024-01-05 10:00:00", "server-2", 20.0, 1.0, 1.0, 1.0, 1.0),
        ("2024-01-05 09:00:00", "server-2", 95.0, 1.0, 1.0, 1.0, 1.0),
        ("2024-01-05 11:00:00", "server-1", 30.0, 1.0, 1.0, 1.0, 1.0),
    ])
    got = rows(M.cpu_gauges_per_server(infra), "server", "cpu_usage", "band")
    assert got == [("server-1", 30.0, "normal"), ("server-2", 20.0, "normal")]


def test_cpu_bands_half_open_and_breach_strict(spark):
    infra = make_infra(spark, [
        ("2024-01-05 10:00:00", s, cpu, 1.0, 1.0, 1.0, 1.0)
        for s, cpu in [("server-1", 59.99), ("server-2", 60.0), ("server-3", 80.0), ("api-server", 90.0),
                       ("db-server", 90.01)]
    ])
    got = rows(M.cpu_gauges(infra), "server", "band", "breach")
    assert got == [("server-1", "normal", False), ("server-2", "elevated", False), ("server-3", "high", False),
                   ("api-server", "high", False), ("db-server", "high", True)]


def _act(i, t, user="user_1", action="login", ip="10.0.0.1", susp=False, reason=None):
    return (i, t, user, action, ip, susp, reason)


def test_suspicious_without_reason_dropped_from_groups_kept_in_total(spark):
    acts = make_activities(spark, [
        _act(1, "2024-01-01 01:00:00", susp=True, reason="Unusual access time"),
        _act(2, "2024-01-01 02:00:00", susp=True, reason=None),
        _act(3, "2024-01-01 03:00:00"),
    ])
    assert rows(A.suspicious_by_reason(acts)) == [("Unusual access time", 1)]
    assert A.activity_summary(acts).collect()[0]["suspicious_activities"] == 2
    assert A.suspicious_activities(acts).count() == 2
    assert rows(A.suspicious_reasons(acts)) == [("Unusual access time",)]


def test_distinct_users_counts_null_as_a_value(spark):
    acts = make_activities(spark, [
        _act(1, "2024-01-01 01:00:00", user="user_1"),
        _act(2, "2024-01-01 02:00:00", user=None),
        _act(3, "2024-01-01 03:00:00", user="user_1", ip="10.0.0.2"),
    ])
    s = A.activity_summary(acts).collect()[0]
    assert s["unique_users"] == 2 and s["unique_ips"] == 2 and s["total_activities"] == 3
    assert [r[0] for r in rows(A.top_users(acts), "user_id")] == ["user_1"]


def test_top_users_ties_broken_by_user_id(spark):
    data = []
    i = 0
    for u, n in [("user_9", 3), ("user_2", 2), ("user_3", 2), ("user_1", 2), ("user_5", 1)]:
        for _ in range(n):
            i += 1
            data.append(_act(i, "2024-01-01 01:00:00", user=u))
    got = rows(A.top_users(make_activities(spark, data), k=3))
    assert got == [("user_9", 3), ("user_1", 2), ("user_2", 2)]


def _alert(i, prio="low", status="resolved", sev="INFO"):
    return (i, "2024-01-01 01:00:00", "Memory Leak", sev, prio, "d", status)


def test_alert_flags_overlap_in_rule_order(spark):
    alerts = make_alerts(spark, [_alert(1, "critical", "active"), _alert(2, "low", "resolved"),
                                 _alert(3, "medium", "active")])
    got = {r[0]: r[1] for r in rows(V.row_flags(alerts, V.ALERT_ROW_RULES), "alert_id", "flags")}
    assert got == {1: ["critical", "active"], 2: [], 3: ["medium", "active"]}


def test_latest_action_wins_and_unacted_alert_unchanged(spark):
    alerts = make_alerts(spark, [_alert(1, status="active"), _alert(2, status="active")])
    actions = make_actions(spark, [(1, "resolved", "2024-01-02 10:00:00"),
                                   (1, "acknowledged", "2024-01-02 09:00:00"),
                                   (7, "resolved", "2024-01-02 09:00:00")])
    got = {r[0]: r[1] for r in rows(AL.apply_alert_actions(alerts, actions), "alert_id", "status")}
    assert got == {1: "resolved", 2: "active"}


def test_priority_order_and_summary(spark):
    alerts = make_alerts(spark, [_alert(1, "low"), _alert(2, "critical", "active"), _alert(3, "high", "active"),
                                 _alert(4, "low", "acknowledged")])
    assert [r[0] for r in rows(AL.alerts_by_priority(alerts), "priority")] == ["critical", "high", "low"]
    s = AL.alert_summary(alerts).collect()[0].asDict()
    assert s == {"active": 2, "acknowledged": 1, "resolved": 1, "critical": 1}
    assert AL.filter_alerts(alerts, None, "low").count() == 2
    assert [r[0] for r in rows(AL.active_alerts(alerts), "alert_id")] == [3, 2]


def test_null_group_keys_are_left_out(spark):
    from pyspark.sql import types as T

    from opsframes import schemas as S
    from conftest import ts

    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in S.LOGS])
    logs = spark.createDataFrame([
        (1, ts("2024-01-01 01:00:00"), "ERROR", None, "user_1", "m", "Network"),
        (2, None, "ERROR", "/api/users", "user_1", "m", None),
        (3, ts("2024-01-01 02:00:00"), "ERROR", "/api/users", "user_1", "m", "Network"),
    ], nullable)
    assert rows(L.errors_by_endpoint(logs)) == [("/api/users", "ERROR", 2)]
    assert rows(L.error_trend(logs), "count") == [(2,)]
    assert rows(L.log_class_counts(logs), "log_class", "count") == [("Network", 2)]
    assert L.error_summary(logs).collect()[0]["affected_endpoints"] == 2  # null counts as a value

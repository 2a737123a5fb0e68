"""Equivalent DuckDB SQL for every registered query.

The driver pre-registers only the raw tables, so each statement starts
with the adapter CTEs of :mod:`opsframes.sources.tables` written in SQL
(only those it needs). Averages of doubles are rounded to 6 places on both
sides, since summation order differs between engines.
"""

from __future__ import annotations

import re

from .. import schemas as S
from ..operators.rules import RULE_SEVERITY
from ..operators.views import ALERT_ROW_RULES as _ALERT_RULES
from ..operators.views import LOG_ROW_RULES as _LOG_RULES
from ..operators.views import SUSPICIOUS_ROW_RULES as _SUSP_RULES
from . import params as P


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pick(expr: str, values) -> str:
    """``values[expr]`` for a 0-based integer expression."""
    whens = " ".join(f"WHEN {i} THEN {_q(v)}" for i, v in enumerate(values))
    return f"CASE {expr} {whens} END"


def _lookup(expr: str, mapping) -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in mapping.items())
    return f"CASE {expr} {whens} END"


def _template(tpl: str, **exprs: str) -> str:
    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", tpl):
        if m.start() > pos:
            parts.append(_q(tpl[pos:m.start()]))
        parts.append(exprs[m.group(1)])
        pos = m.end()
    if pos < len(tpl):
        parts.append(_q(tpl[pos:]))
    return "(" + " || ".join(parts) + ")"


def _by_key(expr: str, templates, **exprs: str) -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {_template(t, **exprs)}" for k, t in templates.items())
    return f"CASE {expr} {whens} END"


def _rank(expr: str, mapping) -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {int(v)}" for k, v in mapping.items())
    return f"CAST(CASE {expr} {whens} END AS INTEGER)"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


_USER = "('user_' || CAST(user_id AS VARCHAR))"


def _hour(c: str) -> str:
    return f"CAST(date_trunc('hour', {c}) AS TIMESTAMP)"


_HOUR = _hour("ts")
_ERR = _in(S.ERROR_SEVERITIES)

CTES: dict[str, tuple[list[str], str]] = {
    "ev": ([], f"""
SELECT event_id, ts, user_id, event_type,
       CAST(value AS DECIMAL(18,2)) AS value,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       {_pick('event_id % 7', S.ENDPOINTS)} AS endpoint,
       CASE WHEN event_type = 'error' AND CAST(value AS DECIMAL(18,2)) >= 100 THEN 'CRITICAL'
            WHEN event_type = 'error' THEN 'ERROR'
            WHEN event_type = 'signup' THEN 'WARNING'
            ELSE 'INFO' END AS severity
FROM events"""),
    "logs": (["ev"], f"""
SELECT event_id AS log_id, ts AS "timestamp", severity, endpoint, {_USER} AS user_id,
       {_by_key('severity', S.LOG_MESSAGES, endpoint='endpoint')} AS message,
       {_pick('k % 5', S.LOG_CLASSES)} AS log_class
FROM ev"""),
    "api_metrics": (["ev"], f"""
SELECT {_HOUR} AS "timestamp", endpoint,
       CAST(sum(value) AS DOUBLE) / count(*) AS response_time,
       100.0 * CAST(count(*) FILTER (WHERE severity IN {_ERR}) AS DOUBLE) / count(*) AS error_rate,
       CAST(count(*) AS DOUBLE) / 60 AS throughput
FROM ev GROUP BY 1, 2"""),
    "infra_metrics": (["ev"], f"""
SELECT {_HOUR} AS "timestamp", {_pick('event_id % 5', S.SERVERS)} AS server,
       least(100.0, CAST(sum(value) AS DOUBLE) / count(*)) AS cpu_usage,
       CAST(sum(k) AS DOUBLE) / count(*) AS memory_usage,
       CAST(max(k) AS DOUBLE) AS disk_usage,
       CAST(sum(value) AS DOUBLE) AS network_in,
       CAST(sum(k) AS DOUBLE) AS network_out
FROM ev GROUP BY 1, 2"""),
    "user_activities": (["ev"], f"""
SELECT event_id AS activity_id, ts AS "timestamp", {_USER} AS user_id,
       {_pick('k % 7', S.ACTIONS)} AS action,
       CASE WHEN event_id % 38 < 19 THEN '192.168.1.' || CAST(event_id % 38 + 1 AS VARCHAR)
            ELSE '10.0.0.' || CAST(event_id % 38 - 18 AS VARCHAR) END AS ip_address,
       (k % 10 = 0) AS is_suspicious,
       CASE WHEN k % 10 = 0 THEN {_pick('event_id % 5', S.SUSPICIOUS_REASONS)} END AS reason
FROM ev"""),
    "alerts0": (["ev"], f"""
SELECT event_id, ts, endpoint, {_USER} AS usr,
       {_pick('event_id % 5', S.SERVERS)} AS server,
       {_pick('event_id % 6', S.ALERT_TYPES)} AS type,
       {_pick('k % 4', S.SEVERITY_LEVELS)} AS severity,
       {_pick('k % 3', S.ALERT_STATUSES)} AS status
FROM ev WHERE event_type = 'error' AND value >= 50"""),
    "alerts": (["alerts0"], f"""
SELECT event_id AS alert_id, ts AS "timestamp", type, severity,
       {_lookup('severity', S.PRIORITY_OF_SEVERITY)} AS priority,
       {_by_key('type', S.ALERT_DESCRIPTIONS, endpoint='endpoint', server='server', user='usr')} AS description,
       status
FROM alerts0"""),
    "alert_actions": ([], """
SELECT event_id - event_id % 3 AS alert_id,
       CASE WHEN event_id % 2 = 0 THEN 'acknowledged' ELSE 'resolved' END AS new_status,
       ts AS acted
FROM events"""),
}


def _needed(sql: str) -> list[str]:
    """Adapter CTEs referenced by ``sql``, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for name in CTES:
        if re.search(rf"\b{name}\b", sql):
            visit(name)
    return order


def with_tables(sql: str) -> str:
    names = _needed(sql)
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({CTES[n][1].strip()})" for n in names)
    return f"WITH {ctes}\n{sql.strip()}"


def _r(expr: str, alias: str) -> str:
    return f"round({expr}, 6) AS {alias}"


def _share(key: str, table: str, where: str = "") -> str:
    cond = f"{key} IS NOT NULL" + (f" AND {where}" if where else "")
    return f"""
SELECT {key}, count(*) AS count,
       CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share
FROM {table} WHERE {cond} GROUP BY {key}"""


def _means(table: str, where: str) -> str:
    return f"""
SELECT endpoint, {_r('avg(response_time)', 'response_time')}, {_r('avg(error_rate)', 'error_rate')},
       {_r('avg(throughput)', 'throughput')}
FROM {table} WHERE {where} GROUP BY endpoint"""


_LAST_DAY = "CAST(\"timestamp\" AS DATE) = (SELECT max(CAST(\"timestamp\" AS DATE)) FROM api_metrics)"


def _since(table: str, code: str) -> str:
    interval = S.RANGE_CODES.get(code, S.RANGE_DEFAULT)
    return f"\"timestamp\" >= (SELECT max(\"timestamp\") FROM {table}) - INTERVAL '{interval}'"


def _flags(rules) -> str:
    parts = []
    for flag, column, op, value in rules:
        cond = f"{column} = {_q(value)}" if op == "=" else f"contains({column}, {_q(value)})"
        parts.append(f"CASE WHEN {cond} THEN {_q(flag)} END")
    return "concat_ws(',', " + ", ".join(parts) + ")"


_CPU_BAND = ("CASE " + " ".join(f"WHEN cpu_usage < {hi} THEN {_q(lab)}" for hi, lab in S.CPU_BANDS)
             + f" ELSE {_q(S.CPU_BAND_TOP)} END")
_LOG_COLS = 'log_id, "timestamp", severity, endpoint, user_id, message, log_class'
_ACT_COLS = 'activity_id, "timestamp", user_id, action, ip_address, is_suspicious, reason'
_ALERT_COLS = 'alert_id, "timestamp", type, severity, priority, description, status'


def _generated(alert_type: str, rule: str, source: str, ts: str, kind: str, entity: str, ident: str = "") -> str:
    values = {"endpoint": "''", "server": "''", "user": "''"}
    values[kind] = entity
    sev = RULE_SEVERITY[alert_type]
    key = [_q(rule), entity, f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"] + ([f"CAST({ident} AS VARCHAR)"] if ident else [])
    return f"""
SELECT concat_ws('|', {', '.join(key)}) AS alert_key, CAST({ts} AS TIMESTAMP) AS "timestamp",
       {_q(alert_type)} AS type, {_q(sev)} AS severity, {_q(S.PRIORITY_OF_SEVERITY[sev])} AS priority,
       {_template(S.ALERT_DESCRIPTIONS[alert_type], **values)} AS description, 'active' AS status
FROM ({source}) g"""


def _rules_sql() -> dict[str, str]:
    p = P.RULES
    leak = f"""
SELECT "timestamp", server, memory_usage FROM (
  SELECT "timestamp", server, memory_usage,
         {', '.join(f"lag(memory_usage, {i}) OVER w AS lag{i}" for i in range(1, p['leak_samples']))}
  FROM infra_metrics WINDOW w AS (PARTITION BY server ORDER BY "timestamp", memory_usage)) x
WHERE {' AND '.join(['memory_usage > lag1'] + [f"lag{i} > lag{i + 1}" for i in range(1, p['leak_samples'] - 1)])}"""
    unavailable = f"""
SELECT {_hour('"timestamp"')} AS "timestamp", endpoint, count(*) AS critical_count
FROM logs WHERE severity = 'CRITICAL' AND "timestamp" IS NOT NULL AND endpoint IS NOT NULL
GROUP BY 1, 2 HAVING count(*) >= {p['critical_logs']}"""
    failed = f"""
SELECT user_id, min("timestamp") AS first, max("timestamp") AS last, count(*) AS failures FROM (
  SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY "timestamp", log_id ROWS UNBOUNDED PRECEDING) AS burst FROM (
    SELECT user_id, "timestamp", log_id,
           CASE WHEN "timestamp" < lag("timestamp") OVER (PARTITION BY user_id ORDER BY "timestamp", log_id)
                                   + INTERVAL '{p['login_gap']} seconds' THEN 0 ELSE 1 END AS starts
    FROM logs WHERE endpoint = '/api/auth/login' AND severity IN {_ERR} AND user_id IS NOT NULL
      AND "timestamp" IS NOT NULL) s) b
GROUP BY user_id, burst HAVING count(*) >= {p['failed_logins']}"""
    h1, h2 = p["hours"]
    access = f'SELECT {_ACT_COLS} FROM user_activities WHERE hour("timestamp") < {h1} OR hour("timestamp") >= {h2}'
    new_loc = """
SELECT activity_id, "timestamp", user_id, action, ip_address FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, ip_address ORDER BY "timestamp", activity_id) AS rn_pair,
            row_number() OVER (PARTITION BY user_id ORDER BY "timestamp", activity_id) AS rn_user
  FROM user_activities WHERE user_id IS NOT NULL AND ip_address IS NOT NULL) x
WHERE rn_pair = 1 AND rn_user > 1"""
    exports = f"""
SELECT user_id, CAST("timestamp" AS DATE) AS date, count(*) AS count
FROM user_activities WHERE action = 'export_data' AND user_id IS NOT NULL AND "timestamp" IS NOT NULL
GROUP BY 1, 2 HAVING count(*) >= {p['exports']}"""
    deletions = f"""
SELECT user_id, {_hour('"timestamp"')} AS "timestamp", count(*) AS count
FROM user_activities WHERE action = 'delete_resource' AND user_id IS NOT NULL AND "timestamp" IS NOT NULL
GROUP BY 1, 2 HAVING count(*) >= {p['deletions']}"""
    error_rate = f"SELECT * FROM api_metrics WHERE error_rate > {p['error_rate']}"
    slow = f"SELECT * FROM api_metrics WHERE response_time > {p['response_ms']}"
    cpu = f"SELECT * FROM infra_metrics WHERE cpu_usage > {p['cpu']}"
    generated = " UNION ALL ".join([
        _generated("High Error Rate", "error_rate", error_rate, '"timestamp"', "endpoint", "endpoint"),
        _generated("Service Unavailable", "unavailable", unavailable, '"timestamp"', "endpoint", "endpoint"),
        _generated("Slow Response Time", "slow_response", slow, '"timestamp"', "endpoint", "endpoint"),
        _generated("High CPU Usage", "high_cpu", cpu, '"timestamp"', "server", "server"),
        _generated("Memory Leak", "memory_leak", leak, '"timestamp"', "server", "server"),
        _generated("Suspicious Activity", "failed_logins", failed, "first", "user", "user_id"),
        _generated("Suspicious Activity", "access_time", access, '"timestamp"', "user", "user_id", "activity_id"),
        _generated("Suspicious Activity", "new_location", new_loc, '"timestamp"', "user", "user_id", "activity_id"),
        _generated("Suspicious Activity", "export_volume", exports, "CAST(date AS TIMESTAMP)", "user", "user_id"),
        _generated("Suspicious Activity", "deletions", deletions, '"timestamp"', "user", "user_id"),
    ])
    latest_action = """
SELECT a.alert_id, a."timestamp", a.type, a.severity, a.priority, a.description,
       coalesce(l.new_status, a.status) AS status, l.acted AS status_changed
FROM alerts a LEFT JOIN (
  SELECT alert_id, arg_max(new_status, (acted, new_status)) AS new_status, max(acted) AS acted
  FROM alert_actions GROUP BY alert_id) l ON a.alert_id = l.alert_id"""
    sev_all = _in(S.SEVERITY_LEVELS)
    wm = P.STREAM["watermark"]
    stream_volume = f"""
SELECT date, severity, count FROM (
  SELECT CAST("timestamp" AS DATE) AS date, severity, count(*) AS count
  FROM logs WHERE severity IN {sev_all} GROUP BY 1, 2) v
WHERE CAST(date AS TIMESTAMP) + INTERVAL '{P.STREAM['window']}'
      <= (SELECT max("timestamp") FROM logs WHERE severity IN {sev_all}) - INTERVAL '{wm}'"""
    closed = f"\"timestamp\" + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '{wm}'"
    stream_alerts = " UNION ALL ".join([
        _generated("High Error Rate", "error_rate", f"{error_rate} AND {closed}", '"timestamp"', "endpoint",
                   "endpoint"),
        _generated("Slow Response Time", "slow_response", f"{slow} AND {closed}", '"timestamp"', "endpoint",
                   "endpoint"),
        _generated("High CPU Usage", "high_cpu", f"{cpu} AND {closed}", '"timestamp"', "server", "server"),
        _generated("Memory Leak", "memory_leak", f"{leak} AND {closed}", '"timestamp"', "server", "server"),
    ])
    within = P.STREAM["within"]
    d = P.DAMAGE
    live_actions = f"""
SELECT a.alert_id, a."timestamp", a.type, a.severity, a.priority, a.description,
       coalesce(l.new_status, a.status) AS status, l.acted AS status_changed
FROM alerts a LEFT JOIN (
  SELECT c.alert_id, arg_max(c.new_status, (c.acted, c.new_status)) AS new_status, max(c.acted) AS acted
  FROM alert_actions c JOIN alerts b ON b.alert_id = c.alert_id
  WHERE c.acted >= b."timestamp" AND c.acted <= b."timestamp" + INTERVAL '{within}'
  GROUP BY c.alert_id) l ON a.alert_id = l.alert_id
WHERE a."timestamp" + INTERVAL '{within}'
      <= least((SELECT max("timestamp") FROM alerts), (SELECT max(acted) FROM alert_actions)) - INTERVAL '{wm}'"""
    return {
        "export_table": 'SELECT *, CAST("timestamp" AS DATE) AS date FROM logs',
        "export_table_csv": 'SELECT *, CAST("timestamp" AS DATE) AS date FROM logs',
        "text_logs": f"""
SELECT log_id, date_trunc('second', "timestamp") AS "timestamp", severity, endpoint, user_id, message, log_class FROM logs
WHERE log_id % {d['every']} NOT IN ({d['id']}, {d['time']}, {d['missing']}, {d['cut']})""",
        "text_logs_quarantine": f"""
SELECT format, CASE log_id % {d['every']} WHEN {d['id']} THEN 'log_id: bigint' WHEN {d['time']} THEN 'timestamp: timestamp_ntz'
                    WHEN {d['missing']} THEN 'severity: missing' WHEN {d['cut']} THEN 'structure' ELSE '' END AS reason, count(*) AS count
FROM logs, (VALUES ('csv'), ('json')) f(format) GROUP BY 1, 2""",
        "stream_log_volume": stream_volume,
        "stream_alerts": stream_alerts,
        "stream_alert_actions": live_actions,
        "metrics_rollup": "SELECT * FROM api_metrics",
        "metrics_rollup_in_loads": "SELECT * FROM api_metrics",
        "new_location_by_day": new_loc,
        "alert_high_error_rate": error_rate,
        "alert_service_unavailable": unavailable,
        "alert_slow_response": slow,
        "alert_high_cpu": cpu,
        "alert_memory_leak": leak,
        "suspicious_failed_logins": failed,
        "suspicious_access_time": access,
        "suspicious_new_location": new_loc,
        "suspicious_export_volume": exports,
        "suspicious_deletions": deletions,
        "generate_alerts": generated,
        "apply_alert_actions": latest_action,
    }


def statements() -> dict[str, str]:
    """Raw statements per key (before the adapter CTEs are prepended)."""
    p = P
    sev_all = _in(S.SEVERITY_LEVELS)
    crosstab = ", ".join(f"count(*) FILTER (WHERE severity = {_q(v)}) AS \"{v}\"" for v in sorted(S.SEVERITY_LEVELS))
    search = " OR ".join(f"regexp_matches({c}, {_q(p.SEARCH_TERM)}, 'i')" for c in ("message", "endpoint", "user_id"))
    lo, hi = p.CLASSIFIED["start"], p.CLASSIFIED["end"]
    tp = p.TABLE_PAGE
    out = {
        # adapters
        "logs": "SELECT * FROM logs",
        "api_metrics": "SELECT * FROM api_metrics",
        "infra_metrics": "SELECT * FROM infra_metrics",
        "user_activities": "SELECT * FROM user_activities",
        "alerts": "SELECT * FROM alerts",
        "alert_actions": "SELECT * FROM alert_actions",
        # logs
        "log_volume": f"""
SELECT CAST("timestamp" AS DATE) AS date, severity, count(*) AS count
FROM logs WHERE severity IN {sev_all} AND "timestamp" IS NOT NULL GROUP BY 1, 2""",
        "logs_by_endpoint": "SELECT endpoint, count(*) AS count FROM logs WHERE endpoint IS NOT NULL GROUP BY 1",
        "recent_logs": f'SELECT {_LOG_COLS} FROM logs ORDER BY "timestamp" DESC, log_id DESC LIMIT {p.RECENT_N}',
        "search_logs": f"""
SELECT {_LOG_COLS} FROM logs WHERE {search}
ORDER BY "timestamp" DESC, log_id DESC LIMIT {p.RECENT_N}""",
        "log_class_counts": _share("log_class", "logs"),
        "log_class_by_severity": f"SELECT log_class, {crosstab} FROM logs WHERE log_class IS NOT NULL GROUP BY 1",
        "classified_logs": f"""
SELECT {_LOG_COLS} FROM logs
WHERE log_class IN {_in(p.CLASSIFIED['classes'])} AND severity IN {_in(p.CLASSIFIED['severities'])}
  AND CAST("timestamp" AS DATE) BETWEEN DATE '{lo}' AND DATE '{hi}'""",
        "error_trend": f"""
SELECT CAST("timestamp" AS DATE) AS date, severity, count(*) AS count
FROM logs WHERE severity IN {_ERR} AND "timestamp" IS NOT NULL GROUP BY 1, 2""",
        "errors_by_endpoint": f"""
SELECT endpoint, severity, count(*) AS count FROM logs WHERE severity IN {_ERR} AND endpoint IS NOT NULL
GROUP BY 1, 2""",
        "error_summary": f"""
SELECT count(*) FILTER (WHERE severity = 'ERROR') AS errors,
       count(*) FILTER (WHERE severity = 'CRITICAL') AS critical,
       count(DISTINCT endpoint) + CASE WHEN count(*) > count(endpoint) THEN 1 ELSE 0 END AS affected_endpoints
FROM logs WHERE severity IN {_ERR}""",
        "error_logs": f"""
SELECT {_LOG_COLS} FROM logs
WHERE severity IN {_ERR} AND severity = {_q(p.ERROR_LOGS['severity'])}
  AND endpoint IN {_in(p.ERROR_LOGS['endpoints'])}""",
        # API metrics
        "api_avg_last_day": _means("api_metrics", _LAST_DAY),
        "api_overview": f"""
SELECT {_r('avg(response_time)', 'avg_response_time')}, {_r('avg(error_rate)', 'avg_error_rate')},
       {_r('avg(throughput)', 'avg_throughput')}, {len(S.ENDPOINTS)} AS active_endpoints
FROM (SELECT endpoint, avg(response_time) AS response_time, avg(error_rate) AS error_rate,
             avg(throughput) AS throughput
      FROM api_metrics WHERE {_LAST_DAY} GROUP BY endpoint) m""",
        "api_avg_by_endpoint": _means("api_metrics", _since("api_metrics", p.API_RANGE)),
        "endpoint_response_series": f"""
SELECT "timestamp", response_time FROM api_metrics WHERE endpoint = {_q(p.ENDPOINT)} ORDER BY "timestamp\"""",
        "endpoint_response_range": f"""
SELECT "timestamp", response_time FROM api_metrics
WHERE endpoint = {_q(p.ENDPOINT)} AND {_since('api_metrics', p.API_RANGE)}""",
        # infrastructure
        "cpu_gauges": f"""
SELECT "timestamp", server, cpu_usage,
       {_CPU_BAND} AS band, cpu_usage > {S.CPU_BREACH} AS breach
FROM (SELECT "timestamp", server, max(cpu_usage) AS cpu_usage FROM infra_metrics
      WHERE "timestamp" = (SELECT max("timestamp") FROM infra_metrics) GROUP BY 1, 2) s""",
        "cpu_gauges_per_server": f"""
SELECT "timestamp", server, cpu_usage, {_CPU_BAND} AS band, cpu_usage > {S.CPU_BREACH} AS breach
FROM (SELECT "timestamp", server, cpu_usage,
             row_number() OVER (PARTITION BY server ORDER BY "timestamp" DESC, cpu_usage DESC) AS rn
      FROM infra_metrics) s WHERE rn = 1""",
        "server_trend": f"""
SELECT "timestamp", cpu_usage, memory_usage, disk_usage FROM infra_metrics
WHERE server = {_q(p.SERVER)} AND {_since('infra_metrics', p.SERVER_RANGE)} ORDER BY "timestamp\"""",
        "server_network": f"""
SELECT "timestamp", 'network_in' AS metric, network_in AS value FROM infra_metrics WHERE server = {_q(p.SERVER)}
UNION ALL
SELECT "timestamp", 'network_out' AS metric, network_out AS value FROM infra_metrics WHERE server = {_q(p.SERVER)}""",
        "server_network_range": f"""
SELECT "timestamp", metric, value FROM (
  SELECT "timestamp", 'network_in' AS metric, network_in AS value, server FROM infra_metrics
  UNION ALL SELECT "timestamp", 'network_out' AS metric, network_out AS value, server FROM infra_metrics) n
WHERE server = {_q(p.SERVER)} AND {_since('infra_metrics', p.SERVER_RANGE)}""",
        # user activity
        "action_counts": _share("action", "user_activities"),
        "activity_by_date": """
SELECT CAST("timestamp" AS DATE) AS date, count(*) AS count FROM user_activities WHERE "timestamp" IS NOT NULL
GROUP BY 1""",
        "suspicious_by_reason": """
SELECT reason, count(*) AS count FROM user_activities WHERE is_suspicious AND reason IS NOT NULL GROUP BY 1""",
        "top_users": f"""
SELECT user_id, count(*) AS count FROM user_activities WHERE user_id IS NOT NULL
GROUP BY 1 ORDER BY count DESC, user_id LIMIT {p.TOP_K}""",
        "activity_summary": """
SELECT count(*) AS total_activities,
       count(DISTINCT user_id) + CASE WHEN count(*) > count(user_id) THEN 1 ELSE 0 END AS unique_users,
       count(*) FILTER (WHERE is_suspicious) AS suspicious_activities,
       count(DISTINCT ip_address) + CASE WHEN count(*) > count(ip_address) THEN 1 ELSE 0 END AS unique_ips
FROM user_activities""",
        "activity_summary_of_days": f"""
SELECT count(*) AS total_activities,
       count(DISTINCT user_id) + CASE WHEN count(*) > count(user_id) THEN 1 ELSE 0 END AS unique_users,
       count(*) FILTER (WHERE is_suspicious) AS suspicious_activities,
       count(DISTINCT ip_address) + CASE WHEN count(*) > count(ip_address) THEN 1 ELSE 0 END AS unique_ips
FROM user_activities
WHERE CAST("timestamp" AS DATE) BETWEEN DATE '{p.SUMMARY_RANGE['start']}' AND DATE '{p.SUMMARY_RANGE['end']}'""",
        "suspicious_activities": f"""
SELECT {_ACT_COLS} FROM user_activities WHERE is_suspicious AND reason IN {_in(p.REASONS)}""",
        "suspicious_reasons": """
SELECT DISTINCT reason FROM user_activities WHERE is_suspicious AND reason IS NOT NULL AND reason <> ''""",
        # alerts
        "alerts_by_type": _share("type", "alerts"),
        "alerts_by_priority": f"""
SELECT priority, count(*) AS count, {_rank('priority', S.PRIORITY_ORDER)} AS sort_order
FROM alerts WHERE priority IS NOT NULL GROUP BY 1""",
        "alerts_by_status": "SELECT status, count(*) AS count FROM alerts WHERE status IS NOT NULL GROUP BY 1",
        "active_alerts": f"""SELECT {_ALERT_COLS} FROM alerts WHERE status = 'active'
ORDER BY "timestamp" DESC, alert_id DESC""",
        "alert_summary": """
SELECT count(*) FILTER (WHERE status = 'active') AS active,
       count(*) FILTER (WHERE status = 'acknowledged') AS acknowledged,
       count(*) FILTER (WHERE status = 'resolved') AS resolved,
       count(*) FILTER (WHERE priority = 'critical') AS critical
FROM alerts""",
        "filter_alerts": f"""
SELECT {_ALERT_COLS} FROM alerts WHERE status = {_q(p.ALERT_FILTER['status'])}
  AND priority = {_q(p.ALERT_FILTER['priority'])}""",
        # views
        "table_page": f"""
SELECT {_LOG_COLS} FROM logs WHERE severity = {_q(tp['severity'])}
ORDER BY "timestamp" DESC, log_id DESC LIMIT {tp['size']} OFFSET {tp['page'] * tp['size']}""",
        "row_flags_logs": f"SELECT {_LOG_COLS}, {_flags(_LOG_RULES)} AS flags FROM logs",
        "row_flags_suspicious": f"""
SELECT {_ACT_COLS}, {_flags(_SUSP_RULES)} AS flags FROM user_activities WHERE is_suspicious""",
        "row_flags_alerts": f"SELECT {_ALERT_COLS}, {_flags(_ALERT_RULES)} AS flags FROM alerts",
    }
    pa, tf = p.PAGE_AFTER, p.TYPED_FILTER
    out["page_after"] = f"""
SELECT {_LOG_COLS} FROM logs
WHERE "timestamp" < TIMESTAMP {_q(pa['timestamp'])}
   OR ("timestamp" = TIMESTAMP {_q(pa['timestamp'])} AND log_id < {pa['log_id']})
ORDER BY "timestamp" DESC, log_id DESC LIMIT {pa['size']}"""
    out["table_page_typed"] = f"""
SELECT {_ALERT_COLS} FROM alerts
WHERE contains(description, {_q(tf['description'])}) AND status = {_q(tf['status'])}
  AND starts_with(CAST("timestamp" AS VARCHAR), {_q(tf['timestamp'])})
ORDER BY "timestamp" DESC, alert_id DESC LIMIT {tf['size']}"""
    out["view_logs"] = 'SELECT "timestamp", severity, endpoint, user_id, message FROM logs'
    for view, source, columns in [
            ("view_classified_logs", "classified_logs", '"timestamp", log_class, severity, endpoint, message'),
            ("view_error_logs", "error_logs", '"timestamp", severity, endpoint, user_id, message'),
            ("view_suspicious_activities", "suspicious_activities", '"timestamp", user_id, action, ip_address, reason'),
            ("view_alerts", "filter_alerts", '"timestamp", type, priority, description, status')]:
        out[view] = f"SELECT {columns} FROM ({out[source]})"
    out.update(_rules_sql())
    return out


def oracle_sql() -> dict[str, str]:
    return {k: with_tables(v) for k, v in statements().items()}

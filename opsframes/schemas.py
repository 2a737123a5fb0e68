"""Schemas of the telemetry tables and the fixed dimension lists.

Every query in :mod:`opsframes.operators` takes DataFrames with these
schemas, so real log/metric tables work unchanged; the adapters in
:mod:`opsframes.sources.tables` only exist to derive them from test data.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the dashboard's own lists and templates for
# results to match; they are kept here, verbatim and in their natural order.
# ---------------------------------------------------------------------------
ENDPOINTS = [
    "/api/users",
    "/api/products",
    "/api/orders",
    "/api/auth/login",
    "/api/auth/logout",
    "/api/payments",
    "/api/analytics",
]
SEVERITY_LEVELS = ["INFO", "WARNING", "ERROR", "CRITICAL"]
LOG_CLASSES = ["Authentication", "Database", "Network", "Authorization", "Input Validation"]
SERVERS = ["server-1", "server-2", "server-3", "api-server", "db-server"]
ACTIONS = ["login", "logout", "view_page", "edit_resource", "delete_resource", "create_resource", "export_data"]
SUSPICIOUS_REASONS = [
    "Multiple failed login attempts",
    "Unusual access time",
    "Access from new location",
    "Unusual data export volume",
    "Multiple resource deletions",
]
ALERT_TYPES = [
    "High Error Rate",
    "Service Unavailable",
    "Slow Response Time",
    "High CPU Usage",
    "Memory Leak",
    "Suspicious Activity",
]
PRIORITY_OF_SEVERITY = {"INFO": "low", "WARNING": "medium", "ERROR": "high", "CRITICAL": "critical"}
PRIORITY_ORDER = {"critical": 0, "high": 1, "medium": 2, "low": 3}
ALERT_STATUSES = ["active", "acknowledged", "resolved"]
# Log message templates by severity ("{endpoint}" is substituted).
LOG_MESSAGES = {
    "INFO": "API request to {endpoint}",
    "ERROR": "Failed API request to {endpoint}: Invalid parameters",
    "CRITICAL": "Service unavailable at {endpoint}: Database connection timeout",
    "WARNING": "Slow response from {endpoint}: Took over 1000ms",
}
# Alert description templates by alert type ("{endpoint}", "{server}", "{user}").
ALERT_DESCRIPTIONS = {
    "High Error Rate": "Error rate exceeded threshold for endpoint {endpoint}",
    "Service Unavailable": "Service {endpoint} is not responding",
    "Slow Response Time": "Response time exceeded 1000ms for endpoint {endpoint}",
    "High CPU Usage": "CPU usage above 90% on server {server}",
    "Memory Leak": "Memory usage consistently increasing on server {server}",
    "Suspicious Activity": "Suspicious activity detected for user {user}",
}
# CPU gauge bands [0,60) [60,80) [80,100] and the breach line (strictly above).
CPU_BANDS = [(60.0, "normal"), (80.0, "elevated")]
CPU_BAND_TOP = "high"
CPU_BREACH = 90.0
# Time-range codes of the range selectors; anything else means one week.
RANGE_CODES = {"24h": "1 day", "3d": "3 days"}
RANGE_DEFAULT = "7 days"
# The columns each dashboard table shows, in order.
VIEW_COLUMNS = {
    "logs": ["timestamp", "severity", "endpoint", "user_id", "message"],
    "classified_logs": ["timestamp", "log_class", "severity", "endpoint", "message"],
    "error_logs": ["timestamp", "severity", "endpoint", "user_id", "message"],
    "suspicious_activities": ["timestamp", "user_id", "action", "ip_address", "reason"],
    "alerts": ["timestamp", "type", "priority", "description", "status"],
}
# ---------------------------------------------------------------------------

ERROR_SEVERITIES = ["ERROR", "CRITICAL"]

LOGS = T.StructType([
    T.StructField("log_id", T.LongType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("endpoint", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("message", T.StringType(), False),
    T.StructField("log_class", T.StringType(), False),
])

API_METRICS = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("endpoint", T.StringType(), False),
    T.StructField("response_time", T.DoubleType(), False),
    T.StructField("error_rate", T.DoubleType(), False),
    T.StructField("throughput", T.DoubleType(), False),
])

INFRA_METRICS = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("server", T.StringType(), False),
    T.StructField("cpu_usage", T.DoubleType(), False),
    T.StructField("memory_usage", T.DoubleType(), False),
    T.StructField("disk_usage", T.DoubleType(), False),
    T.StructField("network_in", T.DoubleType(), False),
    T.StructField("network_out", T.DoubleType(), False),
])

USER_ACTIVITIES = T.StructType([
    T.StructField("activity_id", T.LongType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("action", T.StringType(), False),
    T.StructField("ip_address", T.StringType(), False),
    T.StructField("is_suspicious", T.BooleanType(), False),
    T.StructField("reason", T.StringType(), True),
])

ALERTS = T.StructType([
    T.StructField("alert_id", T.LongType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("priority", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
])

ALERT_ACTIONS = T.StructType([
    T.StructField("alert_id", T.LongType(), False),
    T.StructField("new_status", T.StringType(), False),
    T.StructField("acted", T.TimestampNTZType(), False),
])

# Alerts produced by the rules carry a readable natural key instead of an id.
GENERATED_ALERTS = T.StructType([
    T.StructField("alert_key", T.StringType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("priority", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType(), True),
    T.StructField("ts", T.TimestampNTZType(), True),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("event_type", T.StringType(), True),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("props", T.StringType(), True),
])

TABLE_SCHEMAS = {
    "logs": LOGS,
    "api_metrics": API_METRICS,
    "infra_metrics": INFRA_METRICS,
    "user_activities": USER_ACTIVITIES,
    "alerts": ALERTS,
    "alert_actions": ALERT_ACTIONS,
}

"""Parameters of the registered queries (shared by the Spark side and the SQL oracle).

Thresholds below the dashboard's defaults are chosen where the defaults
find nothing in the test data (response times there peak near 560 ms).
"""

from .. import schemas as S

SEARCH_TERM = "TIMEOUT|slow"
RECENT_N = 100
TOP_K = 10
CLASSIFIED = {
    "classes": ["Authentication", "Database"],
    "severities": ["ERROR", "CRITICAL", "WARNING"],
    "start": "2024-01-10",
    "end": "2024-01-12",
}
ERROR_LOGS = {"severity": "ERROR", "endpoints": ["/api/users", "/api/orders"]}
ENDPOINT = S.ENDPOINTS[0]
SERVER = S.SERVERS[0]
API_RANGE = "3d"
SERVER_RANGE = "1w"
REASONS = ["Unusual access time", "Access from new location"]
ALERT_FILTER = {"status": "active", "priority": "high"}
TABLE_PAGE = {"severity": "ERROR", "page": 2, "size": 10}
# Rows after this (time, id), newest first.
PAGE_AFTER = {"timestamp": "2024-01-12 00:00:00", "log_id": 0, "size": 10}
# A filter row as typed: text that the column contains, and the start of a date.
TYPED_FILTER = {"description": "server", "timestamp": "2024-01-1", "status": "active", "size": 20}
# Which log ids (modulo "every") get which damage in the text sources.
DAMAGE = {"every": 50, "id": 3, "time": 11, "missing": 22, "cut": 37}
SUMMARY_RANGE = {"start": "2024-01-05", "end": "2024-01-18"}
RULES = {
    "error_rate": 50.0,
    "critical_logs": 1,
    "response_ms": 100.0,
    "cpu": 90.0,
    "leak_samples": 3,
    "failed_logins": 2,
    "login_gap": 24 * 3600,
    "hours": (6, 22),
    "exports": 2,
    "deletions": 2,
}
STREAM = {"window": "1 day", "watermark": "1 hour", "within": "2 hours"}

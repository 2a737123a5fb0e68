"""Log ingestion, classification and error queries over ``logs``.

Every aggregate here groups on low-cardinality keys (date, severity,
endpoint, class), so Spark's partial hash aggregate collapses each map
task to a handful of rows before the shuffle; a hot key cannot skew it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.exprs import distinct_count, event_date, group_count, value_counts, value_shares
from ..functions.params import date_between, equal_unless_all, one_of, where_all


def newest_first():
    return [F.desc("timestamp"), F.desc("log_id")]


def log_volume(logs: DataFrame, severities: Iterable[str] | None = None) -> DataFrame:
    """Rows per (date, severity); an empty selection means every level."""
    return group_count(where_all(logs, one_of("severity", severities)), ("date", event_date("timestamp")), "severity")


def logs_by_endpoint(logs: DataFrame) -> DataFrame:
    """Rows per endpoint, largest first."""
    return value_counts(logs, "endpoint")


def recent_logs(logs: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` newest rows (top-k: each task keeps n rows, then one merge)."""
    return logs.orderBy(*newest_first()).limit(n)


def search_condition(term: str, columns: Sequence[str] = ("message", "endpoint", "user_id")):
    """Case-insensitive regular-expression match on any of ``columns``."""
    pattern = "(?iu)" + term
    cond = None
    for c in columns:
        hit = F.col(c).rlike(pattern)
        cond = hit if cond is None else cond | hit
    return cond


def search_logs(logs: DataFrame, term: str | None, n: int = 100) -> DataFrame:
    """The ``n`` newest rows whose message, endpoint or user matches ``term``."""
    if term:
        logs = logs.where(search_condition(term))
    return recent_logs(logs, n)


def log_class_counts(logs: DataFrame) -> DataFrame:
    """Rows per log class with its share of all classified rows."""
    return value_shares(logs, "log_class")


def log_class_by_severity(logs: DataFrame, severities: Sequence[str] | None = None) -> DataFrame:
    """Cross-tab log_class x severity, absent cells 0.

    One scan counts (log_class, severity); the cross-tab is made from those few
    rows, which are kept in memory meanwhile when its columns (default: the
    fixed levels and any others that occur, alphabetically) have to be read off
    them.
    """
    counts = logs.where(F.col("log_class").isNotNull()).groupBy("log_class", "severity").agg(F.count(F.lit(1)).alias("n"))
    if severities:
        levels = list(severities)
    else:
        counts = counts.persist()
        levels = sorted({r[0] for r in counts.where("severity is not null").select("severity").distinct().collect()} | set(S.SEVERITY_LEVELS))
    return counts.groupBy("log_class").agg(*[
        F.coalesce(F.sum(F.when(F.col("severity") == F.lit(v), F.col("n"))), F.lit(0)).alias(v) for v in levels])


def classified_logs(logs: DataFrame, classes: Iterable[str] | None = (), severities: Iterable[str] | None = (),
                    start=None, end=None) -> DataFrame:
    """Filter by classes, severities and an inclusive date range (all optional)."""
    return where_all(
        logs,
        one_of("log_class", classes),
        one_of("severity", severities),
        date_between("timestamp", start, end),
    )


def error_logs_only(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("severity").isin(S.ERROR_SEVERITIES))


def error_trend(logs: DataFrame) -> DataFrame:
    """ERROR/CRITICAL rows per (date, severity)."""
    return group_count(error_logs_only(logs), ("date", event_date("timestamp")), "severity")


def errors_by_endpoint(logs: DataFrame) -> DataFrame:
    """ERROR/CRITICAL rows per (endpoint, severity), largest first."""
    return (group_count(error_logs_only(logs), "endpoint", "severity")
            .orderBy(F.desc("count"), "endpoint", "severity"))


def error_summary(logs: DataFrame) -> DataFrame:
    """Error count, critical count and affected endpoints, in one scan."""
    return error_logs_only(logs).agg(
        F.count_if(F.col("severity") == "ERROR").alias("errors"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        distinct_count("endpoint").alias("affected_endpoints"),
    )


def error_logs(logs: DataFrame, severity: str | None = "all", endpoints: Iterable[str] | None = ()) -> DataFrame:
    """ERROR/CRITICAL rows, by one severity (``'all'``) and endpoints (empty = all)."""
    return where_all(
        error_logs_only(logs),
        equal_unless_all("severity", severity),
        one_of("endpoint", endpoints),
    )

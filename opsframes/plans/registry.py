"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each entry takes the telemetry tables derived from ``sf_dir`` (derived and
stored once per application by :func:`opsframes.sources.catalog.catalog`)
and applies one query with the parameters of :mod:`.params`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.exprs import round_doubles
from ..incremental.daysets import DaySets
from ..incremental.rollups import StoredRollup
from ..incremental.sightings import Sightings
from ..operators import activity as A
from ..operators import alerts as AL
from ..operators import logs as L
from ..operators import metrics as M
from ..operators import rules as R
from ..operators import views as V
from ..sources.files import SECONDS_FORMAT, read_checked, read_table, scratch_path, write_table
from ..sources.catalog import catalog
from ..sources.tables import Tables, TableSet, load, requests_from_events
from ..streaming import actions as stream_actions
from ..streaming import alerts as stream_alerts
from ..streaming import log_volume as stream_log_volume
from . import params as P

Query = Callable[[SparkSession, str], DataFrame]


def _t(fn: Callable[[Tables], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(catalog(spark, sf_dir))

    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _flags(df: DataFrame, rules) -> DataFrame:
    flagged = V.row_flags(df, rules)
    return flagged.withColumn("flags", F.array_join("flags", ","))


def _export_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``logs`` as Parquet partitioned by date, then scan the written table."""
    path = scratch_path(spark, "export_logs")
    write_table(catalog(spark, sf_dir).logs, path)
    return spark.read.parquet(path)


def _export_logs_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``logs`` as CSV partitioned by date, then read it back typed."""
    path = scratch_path(spark, "export_logs_csv")
    write_table(catalog(spark, sf_dir).logs, path, fmt="csv")
    return read_table(spark, path, T.StructType([*S.LOGS.fields, T.StructField("date", T.DateType())]), fmt="csv")


def _text_lines(spark: SparkSession, sf_dir: str, fmt: str) -> str:
    """``logs`` as lines of text with times to the second, some of them damaged (by id, see P.DAMAGE); returns the folder."""
    path = scratch_path(spark, f"text_logs_{fmt}")
    logs = catalog(spark, sf_dir).logs
    kind = F.col("log_id") % P.DAMAGE["every"]
    text = {f.name: F.col(f.name).cast("string") for f in S.LOGS.fields} | {"timestamp": F.date_format("timestamp", SECONDS_FORMAT)}
    text["log_id"] = F.when(kind == P.DAMAGE["id"], F.concat(F.lit("x"), "log_id")).otherwise(text["log_id"])
    text["timestamp"] = F.when(kind == P.DAMAGE["time"], F.lit("2024-02-30 25:00:00")).otherwise(text["timestamp"])
    text["severity"] = F.when(kind == P.DAMAGE["missing"], F.lit(None)).otherwise(text["severity"])
    row = F.struct(*[c.alias(n) for n, c in text.items()])
    line = F.to_csv(row) if fmt == "csv" else F.to_json(row)
    cut = F.when(kind == P.DAMAGE["cut"], F.substring(line, 1, 12)).otherwise(line)
    logs.select(cut.alias("value")).write.text(path)
    return path


def _text_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound rows of JSON lines with text times, some lines damaged."""
    return read_checked(spark, _text_lines(spark, sf_dir, "json"), S.LOGS, "json", SECONDS_FORMAT)[0]


def _quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per reason of quarantine ('' for sound rows) of CSV and JSON lines, some damaged."""
    out = None
    for fmt in ("csv", "json"):
        options = {"header": "false"} if fmt == "csv" else {}
        good, bad = read_checked(spark, _text_lines(spark, sf_dir, fmt), S.LOGS, fmt, SECONDS_FORMAT, **options)
        quarantine = scratch_path(spark, f"quarantine_{fmt}")
        bad.write.parquet(quarantine)
        reason = spark.read.parquet(quarantine).select(F.when(F.array_contains("reasons", "structure"), F.lit("structure"))
                                                       .otherwise(F.array_join("reasons", "; ")).alias("reason"))
        told = good.select(F.lit("").alias("reason")).union(reason).groupBy("reason").agg(F.count(F.lit(1)).alias("count"))
        told = told.select(F.lit(fmt).alias("format"), "reason", "count")
        out = told if out is None else out.union(told)
    return out


def _stream_log_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stream_log_volume.run_log_volume(spark, sf_dir, P.STREAM["window"], P.STREAM["watermark"])
    return out.select("date", "severity", "count")


def _stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.RULES
    return stream_alerts.run_alerts(spark, sf_dir, p["error_rate"], p["response_ms"], p["cpu"], p["leak_samples"],
                                    P.STREAM["watermark"])


def _stream_alert_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_actions.run_alert_actions(spark, sf_dir, P.STREAM["within"], P.STREAM["watermark"])


def _days(t: TableSet, name: str) -> list:
    """The dates of a table, in the order a day-by-day load meets them: the second comes last, late."""
    dates = [r[0] for r in getattr(t, name).select(F.to_date("timestamp").alias("d")).where("d is not null").distinct().orderBy("d").collect()]
    return dates[:1] + dates[2:] + dates[1:2]


def _new_location_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads of a third of the days each, the second day last, then the findings of the stored sightings."""
    t = catalog(spark, sf_dir)
    store = Sightings(spark, scratch_path(spark, "sightings"))
    days = _days(t, "user_activities")
    step = max(1, -(-len(days) // 3))
    for i in range(0, len(days), step):
        store.load(t.user_activities.where(F.to_date("timestamp").isin(days[i:i + step])), f"load-{i}")
    return store.findings()


def _rollup_in_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads, the rows of every seventh id late in the second."""
    events = load(spark, sf_dir).events
    store = StoredRollup(spark, scratch_path(spark, "rollup"))
    late = F.coalesce(F.col("event_id") % 7 == 0, F.lit(True))
    for name, part in (("first", events.where(~late)), ("late", events.where(late))):
        store.load(requests_from_events(part), name)
    return store.metrics()


def _summary_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day sets of all activities in two loads, then the summary of a range from the sets alone."""
    t = catalog(spark, sf_dir)
    store = DaySets(spark, scratch_path(spark, "daysets"))
    days = _days(t, "user_activities")
    for part in (days[::2], days[1::2]):
        if part:
            store.load(t.user_activities.where(F.to_date("timestamp").isin(part)))
    return store.summary(**P.SUMMARY_RANGE)


def _rules(t: Tables) -> dict:
    p = P.RULES
    return dict(error_rate=p["error_rate"], critical_logs=p["critical_logs"], response_ms=p["response_ms"],
                cpu=p["cpu"], leak_samples=p["leak_samples"], failed_logins=p["failed_logins"], login_gap=p["login_gap"],
                hours=p["hours"], exports=p["exports"], deletions=p["deletions"])


QUERIES: dict[str, Query] = {
    # adapters (the five telemetry tables and the action log)
    "logs": _t(lambda t: t.logs),
    "api_metrics": _t(lambda t: t.api_metrics),
    "infra_metrics": _t(lambda t: t.infra_metrics),
    "user_activities": _t(lambda t: t.user_activities),
    "alerts": _t(lambda t: t.alerts),
    "alert_actions": _t(lambda t: t.alert_actions),
    # logs
    "log_volume": _t(lambda t: L.log_volume(t.logs)),
    "logs_by_endpoint": _t(lambda t: L.logs_by_endpoint(t.logs)),
    "recent_logs": _t(lambda t: L.recent_logs(t.logs, P.RECENT_N)),
    "search_logs": _t(lambda t: L.search_logs(t.logs, P.SEARCH_TERM, P.RECENT_N)),
    "log_class_counts": _t(lambda t: L.log_class_counts(t.logs)),
    "log_class_by_severity": _t(lambda t: L.log_class_by_severity(t.logs)),
    # the date range is known up front, so only its date partitions are read
    "classified_logs": _t(lambda t: L.classified_logs(
        t.between("logs", P.CLASSIFIED["start"], P.CLASSIFIED["end"]), **P.CLASSIFIED)),
    "error_trend": _t(lambda t: L.error_trend(t.logs)),
    "errors_by_endpoint": _t(lambda t: L.errors_by_endpoint(t.logs)),
    "error_summary": _t(lambda t: L.error_summary(t.logs)),
    "error_logs": _t(lambda t: L.error_logs(t.logs, **P.ERROR_LOGS)),
    # API metrics
    "api_avg_last_day": _t(lambda t: round_doubles(M.api_avg_last_day(t.recent("api_metrics")))),
    "api_overview": _t(lambda t: round_doubles(M.api_overview(t.recent("api_metrics")))),
    "api_avg_by_endpoint": _t(lambda t: round_doubles(M.api_avg_by_endpoint(
        t.recent("api_metrics", P.API_RANGE), range_code=P.API_RANGE))),
    "endpoint_response_series": _t(lambda t: M.endpoint_response_series(t.api_metrics, P.ENDPOINT)),
    "endpoint_response_range": _t(lambda t: M.endpoint_response_series(
        t.recent("api_metrics", P.API_RANGE), P.ENDPOINT, P.API_RANGE)),
    # infrastructure
    "cpu_gauges": _t(lambda t: M.cpu_gauges(t.recent("infra_metrics"))),
    "cpu_gauges_per_server": _t(lambda t: M.cpu_gauges_per_server(t.infra_metrics)),
    "server_trend": _t(lambda t: M.server_trend(
        t.recent("infra_metrics", P.SERVER_RANGE), P.SERVER, P.SERVER_RANGE)),
    "server_network": _t(lambda t: M.server_network(t.infra_metrics, P.SERVER)),
    "server_network_range": _t(lambda t: M.server_network(
        t.recent("infra_metrics", P.SERVER_RANGE), P.SERVER, P.SERVER_RANGE)),
    # user activity
    "action_counts": _t(lambda t: A.action_counts(t.user_activities)),
    "activity_by_date": _t(lambda t: A.activity_by_date(t.user_activities)),
    "suspicious_by_reason": _t(lambda t: A.suspicious_by_reason(t.user_activities)),
    "top_users": _t(lambda t: A.top_users(t.user_activities, P.TOP_K)),
    "activity_summary": _t(lambda t: A.activity_summary(t.user_activities)),
    "suspicious_activities": _t(lambda t: A.suspicious_activities(t.user_activities, P.REASONS)),
    "suspicious_reasons": _t(lambda t: A.suspicious_reasons(t.user_activities)),
    # alerts
    "alerts_by_type": _t(lambda t: AL.alerts_by_type(t.alerts)),
    "alerts_by_priority": _t(lambda t: AL.alerts_by_priority(t.alerts)),
    "alerts_by_status": _t(lambda t: AL.alerts_by_status(t.alerts)),
    "active_alerts": _t(lambda t: AL.active_alerts(t.alerts)),
    "alert_summary": _t(lambda t: AL.alert_summary(t.alerts)),
    "filter_alerts": _t(lambda t: AL.filter_alerts(t.alerts, **P.ALERT_FILTER)),
    # table views
    "table_page": _t(lambda t: V.table_page(
        t.logs, filters={"severity": ("=", P.TABLE_PAGE["severity"])},
        sort=[("timestamp", "desc"), ("log_id", "desc")],
        page=P.TABLE_PAGE["page"], size=P.TABLE_PAGE["size"])),
    "page_after": _t(lambda t: V.page_after(
        t.logs, sort=[("timestamp", "desc"), ("log_id", "desc")],
        after=(F.lit(P.PAGE_AFTER["timestamp"]).cast("timestamp_ntz"), P.PAGE_AFTER["log_id"]),
        size=P.PAGE_AFTER["size"])),
    "table_page_typed": _t(lambda t: V.table_page(
        t.alerts, filters={"description": P.TYPED_FILTER["description"],
                           "timestamp": ("datestartswith", P.TYPED_FILTER["timestamp"]),
                           "status": ("=", P.TYPED_FILTER["status"])},
        sort=[("timestamp", "desc"), ("alert_id", "desc")], size=P.TYPED_FILTER["size"])),
    "view_logs": _t(lambda t: V.table_view(t.logs, "logs")),
    "view_classified_logs": _t(lambda t: V.table_view(L.classified_logs(
        t.between("logs", P.CLASSIFIED["start"], P.CLASSIFIED["end"]), **P.CLASSIFIED), "classified_logs")),
    "view_error_logs": _t(lambda t: V.table_view(L.error_logs(t.logs, **P.ERROR_LOGS), "error_logs")),
    "view_suspicious_activities": _t(lambda t: V.table_view(
        A.suspicious_activities(t.user_activities, P.REASONS), "suspicious_activities")),
    "view_alerts": _t(lambda t: V.table_view(AL.filter_alerts(t.alerts, **P.ALERT_FILTER), "alerts")),
    "row_flags_logs": _t(lambda t: _flags(t.logs, V.LOG_ROW_RULES)),
    "row_flags_suspicious": _t(lambda t: _flags(A.suspicious_activities(t.user_activities), V.SUSPICIOUS_ROW_RULES)),
    "row_flags_alerts": _t(lambda t: _flags(t.alerts, V.ALERT_ROW_RULES)),
    # rules
    "metrics_rollup": lambda spark, sf_dir: load(spark, sf_dir).api_metrics,
    "alert_high_error_rate": _t(lambda t: R.alert_high_error_rate(t.api_metrics, P.RULES["error_rate"])),
    "alert_service_unavailable": _t(lambda t: R.alert_service_unavailable(t.logs, P.RULES["critical_logs"])),
    "alert_slow_response": _t(lambda t: R.alert_slow_response(t.api_metrics, P.RULES["response_ms"])),
    "alert_high_cpu": _t(lambda t: R.alert_high_cpu(t.infra_metrics, P.RULES["cpu"])),
    "alert_memory_leak": _t(lambda t: R.alert_memory_leak(t.infra_metrics, P.RULES["leak_samples"])),
    "suspicious_failed_logins": _t(lambda t: R.suspicious_failed_logins(
        t.logs, P.RULES["failed_logins"], P.RULES["login_gap"])),
    "suspicious_access_time": _t(lambda t: R.suspicious_access_time(t.user_activities, *P.RULES["hours"])),
    "suspicious_new_location": _t(lambda t: R.suspicious_new_location(t.user_activities)),
    "suspicious_export_volume": _t(lambda t: R.suspicious_export_volume(t.user_activities, P.RULES["exports"])),
    "suspicious_deletions": _t(lambda t: R.suspicious_deletions(t.user_activities, P.RULES["deletions"])),
    "generate_alerts": _t(lambda t: R.generate_alerts(t.logs, t.api_metrics, t.infra_metrics, t.user_activities,
                                                      **_rules(t))),
    "apply_alert_actions": _t(lambda t: AL.apply_alert_actions(t.alerts, t.alert_actions)),
    # stored results brought up to date load by load, with late days or rows
    "new_location_by_day": _new_location_by_day,
    "metrics_rollup_in_loads": _rollup_in_loads,
    "activity_summary_of_days": _summary_of_days,
    # sinks and streams (run when called; the result is read back from the written output)
    "export_table": _export_logs,
    "export_table_csv": _export_logs_csv,
    "text_logs": _text_logs,
    "text_logs_quarantine": _quarantined,
    "stream_log_volume": _stream_log_volume,
    "stream_alerts": _stream_alerts,
    "stream_alert_actions": _stream_alert_actions,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)

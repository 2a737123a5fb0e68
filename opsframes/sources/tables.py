"""Loading the telemetry tables.

Queries take any DataFrame with the schemas of :mod:`opsframes.schemas`.
:func:`load` derives those tables from the driver's ``events`` table so the
test data can drive them; every expression is deterministic and mirrored
by the CTEs in :mod:`opsframes.plans.oracle`.

Scale notes: ``logs``, ``user_activities``, ``alerts`` and ``alert_actions``
are narrow projections of ``events`` (no shuffle, scan pruned to the
columns a query uses). ``api_metrics`` and ``infra_metrics`` are hourly
rollups: a partial (map-side) hash aggregate, then a shuffle of at most
``hours x keys`` rows per task, so a hot endpoint or server costs nothing
extra. In production these rollups would be written once, partitioned by
date (see :func:`opsframes.sources.files.write_table`).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.exprs import by_key, pick, priority_of
from ..operators import metrics
from .files import read_table


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/events.parquet", S.EVENTS)


def _user(c) -> F.Column:
    return F.concat(F.lit("user_"), F.col(c).cast("string"))


def event_base(events: DataFrame) -> DataFrame:
    """Columns shared by all adapters: exact value, JSON key ``k``, endpoint, severity."""
    value = F.col("value").cast(T.DecimalType(18, 2))
    severity = (F.when((F.col("event_type") == "error") & (value >= 100), F.lit("CRITICAL"))
                .when(F.col("event_type") == "error", F.lit("ERROR"))
                .when(F.col("event_type") == "signup", F.lit("WARNING"))
                .otherwise(F.lit("INFO")))
    return events.select(
        "event_id", "ts", "user_id", "event_type",
        value.alias("value"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        pick(S.ENDPOINTS, F.col("event_id") % len(S.ENDPOINTS)).alias("endpoint"),
        severity.alias("severity"),
    )


def logs_from_events(events: DataFrame) -> DataFrame:
    ev = event_base(events)
    return ev.select(
        F.col("event_id").alias("log_id"),
        F.col("ts").alias("timestamp"),
        "severity",
        "endpoint",
        _user("user_id").alias("user_id"),
        by_key("severity", S.LOG_MESSAGES, endpoint=F.col("endpoint")).alias("message"),
        pick(S.LOG_CLASSES, F.col("k") % len(S.LOG_CLASSES)).alias("log_class"),
    )


def requests_from_events(events: DataFrame) -> DataFrame:
    """API request rows (timestamp, endpoint, severity, latency_ms); the event value is the latency."""
    ev = event_base(events)
    return ev.select(F.col("ts").alias("timestamp"), "endpoint", "severity", F.col("value").alias("latency_ms"))


def api_metrics_from_events(events: DataFrame) -> DataFrame:
    return metrics.metrics_rollup(requests_from_events(events))


def samples_from_events(events: DataFrame) -> DataFrame:
    """Server samples (timestamp, server, load, level): the event value is the load, the JSON key the memory level."""
    ev = event_base(events)
    return ev.select(
        F.col("ts").alias("timestamp"),
        pick(S.SERVERS, F.col("event_id") % len(S.SERVERS)).alias("server"),
        F.col("value").alias("load"),
        F.col("k").alias("level"),
    )


def infra_metrics_from_events(events: DataFrame) -> DataFrame:
    return metrics.infra_rollup(samples_from_events(events))


def user_activities_from_events(events: DataFrame) -> DataFrame:
    ev = event_base(events)
    slot = F.col("event_id") % 38
    ip = (F.when(slot < 19, F.concat(F.lit("192.168.1."), (slot + 1).cast("string")))
          .otherwise(F.concat(F.lit("10.0.0."), (slot - 18).cast("string"))))
    suspicious = (F.col("k") % 10) == 0
    return ev.select(
        F.col("event_id").alias("activity_id"),
        F.col("ts").alias("timestamp"),
        _user("user_id").alias("user_id"),
        pick(S.ACTIONS, F.col("k") % len(S.ACTIONS)).alias("action"),
        ip.alias("ip_address"),
        suspicious.alias("is_suspicious"),
        F.when(suspicious, pick(S.SUSPICIOUS_REASONS, F.col("event_id") % len(S.SUSPICIOUS_REASONS))).alias("reason"),
    )


def alerts_from_events(events: DataFrame) -> DataFrame:
    ev = event_base(events).where((F.col("event_type") == "error") & (F.col("value") >= 50))
    alert_type = pick(S.ALERT_TYPES, F.col("event_id") % len(S.ALERT_TYPES))
    severity = pick(S.SEVERITY_LEVELS, F.col("k") % len(S.SEVERITY_LEVELS))
    return ev.select(
        F.col("event_id").alias("alert_id"),
        F.col("ts").alias("timestamp"),
        alert_type.alias("type"),
        severity.alias("severity"),
        priority_of(severity).alias("priority"),
        by_key(alert_type, S.ALERT_DESCRIPTIONS,
               endpoint=F.col("endpoint"),
               server=pick(S.SERVERS, F.col("event_id") % len(S.SERVERS)),
               user=_user("user_id")).alias("description"),
        pick(S.ALERT_STATUSES, F.col("k") % len(S.ALERT_STATUSES)).alias("status"),
    )


def alert_actions_from_events(events: DataFrame) -> DataFrame:
    """Operator actions: every event acts on alert ``event_id - event_id % 3``;
    even ids acknowledge, odd ids resolve."""
    return events.select(
        (F.col("event_id") - F.col("event_id") % 3).alias("alert_id"),
        F.when(F.col("event_id") % 2 == 0, F.lit("acknowledged")).otherwise(F.lit("resolved")).alias("new_status"),
        F.col("ts").alias("acted"),
    )


class TableSet:
    """What every table catalog offers besides its six table attributes."""

    TIME_COLUMN = {
        "logs": "timestamp",
        "api_metrics": "timestamp",
        "infra_metrics": "timestamp",
        "user_activities": "timestamp",
        "alerts": "timestamp",
        "alert_actions": "acted",
    }

    def between(self, name: str, start=None, end=None) -> DataFrame:
        """Table ``name`` limited to the calendar dates [start, end] (either bound optional)."""
        df = getattr(self, name)
        t = F.col(self.TIME_COLUMN[name])
        if start:
            df = df.where(t >= F.lit(str(start)[:10]).cast("date").cast(T.TimestampNTZType()))
        if end:
            df = df.where(t < F.date_add(F.lit(str(end)[:10]).cast("date"), 1).cast(T.TimestampNTZType()))
        return df

    def recent(self, name: str, range_code: str | None = None) -> DataFrame:
        """What a query over a time range up to the table's latest row needs: all of it, where there are no dates to prune by."""
        return getattr(self, name)

    def register(self, prefix: str = "") -> None:
        """Expose every table as a temp view for ``spark.sql``."""
        for name in S.TABLE_SCHEMAS:
            getattr(self, name).createOrReplaceTempView(prefix + name)


@dataclass
class Tables(TableSet):
    """The telemetry catalog, each table built lazily from one ``events`` frame."""

    events: DataFrame

    @cached_property
    def logs(self) -> DataFrame:
        return logs_from_events(self.events)

    @cached_property
    def api_metrics(self) -> DataFrame:
        return api_metrics_from_events(self.events)

    @cached_property
    def infra_metrics(self) -> DataFrame:
        return infra_metrics_from_events(self.events)

    @cached_property
    def user_activities(self) -> DataFrame:
        return user_activities_from_events(self.events)

    @cached_property
    def alerts(self) -> DataFrame:
        return alerts_from_events(self.events)

    @cached_property
    def alert_actions(self) -> DataFrame:
        return alert_actions_from_events(self.events)


def load(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(read_events(spark, sf_dir))

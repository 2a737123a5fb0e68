"""Alert queries over ``alerts`` and operator actions over ``alert_actions``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import priority_rank, value_counts, value_shares
from ..functions.params import equal_unless_all, where_all


def alerts_by_type(alerts: DataFrame) -> DataFrame:
    """Rows per alert type with share."""
    return value_shares(alerts, "type")


def alerts_by_priority(alerts: DataFrame) -> DataFrame:
    """Rows per priority in the order critical, high, medium, low."""
    counts = value_counts(alerts, "priority").withColumn("sort_order", priority_rank("priority"))
    return counts.orderBy(F.asc_nulls_last("sort_order"), "priority")


def alerts_by_status(alerts: DataFrame) -> DataFrame:
    return value_counts(alerts, "status")


def active_alerts(alerts: DataFrame) -> DataFrame:
    """Active alerts, newest first."""
    return alerts.where(F.col("status") == "active").orderBy(F.desc("timestamp"), F.desc("alert_id"))


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Active, acknowledged, resolved and critical-priority counts in one scan."""
    return alerts.agg(
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "acknowledged").alias("acknowledged"),
        F.count_if(F.col("status") == "resolved").alias("resolved"),
        F.count_if(F.col("priority") == "critical").alias("critical"),
    )


def filter_alerts(alerts: DataFrame, status: str | None = "all", priority: str | None = "all") -> DataFrame:
    return where_all(alerts, equal_unless_all("status", status), equal_unless_all("priority", priority))


def latest_actions(actions: DataFrame) -> DataFrame:
    """The latest action per alert (ties on time: the later status name wins).

    Two fixed-width aggregates, so both hash: the latest time per alert and
    status, then per alert. A hot alert with millions of actions collapses
    map-side to a row per task and status.
    """
    per_status = actions.groupBy("alert_id", "new_status").agg(F.max("acted").alias("acted"))
    latest = per_status.groupBy("alert_id").agg(F.max("acted").alias("acted"))
    # an alert has few statuses, so the names at the latest time are few
    return (per_status.join(latest, ["alert_id", "acted"])
            .groupBy("alert_id", "acted").agg(F.array_max(F.collect_list("new_status")).alias("new_status"))
            .select("alert_id", "new_status", "acted"))


def actions_within(alerts: DataFrame, actions: DataFrame, within: str) -> DataFrame:
    """The actions that come within ``within`` after their alert; an action on no alert goes."""
    raised = alerts.select("alert_id", F.col("timestamp").alias("_raised"))
    return (actions.join(raised, "alert_id")
            .where((F.col("acted") >= F.col("_raised")) & (F.col("acted") <= F.col("_raised") + F.expr(f"INTERVAL {within}")))
            .drop("_raised"))


def with_last_action(joined: DataFrame) -> DataFrame:
    """Alert rows beside their last action (``new_status``, ``acted``; null if none) as alerts with their present status."""
    return joined.select(
        "alert_id", "timestamp", "type", "severity", "priority", "description",
        F.coalesce(F.col("new_status"), F.col("status")).alias("status"),
        F.col("acted").alias("status_changed"),
    )


def apply_alert_actions(alerts: DataFrame, actions: DataFrame, within: str | None = None) -> DataFrame:
    """Alerts with the status set by their latest action; alerts without one keep theirs.

    With ``within`` (an interval such as ``"2 hours"``) only actions from the
    alert's time to so much later count, as on a stream. Both join sides are
    keyed by alert_id after aggregation, so the join is skew-free. The planner
    broadcasts a side only if its static size estimate is under the threshold.
    """
    counted = actions_within(alerts, actions, within) if within else actions
    return with_last_action(alerts.join(latest_actions(counted), "alert_id", "left"))

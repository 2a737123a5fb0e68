"""User-activity queries over ``user_activities``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import distinct_count, event_date, group_count, value_shares
from ..functions.params import one_of, where_all


def action_counts(activities: DataFrame) -> DataFrame:
    """Rows per action with its share."""
    return value_shares(activities, "action")


def activity_by_date(activities: DataFrame) -> DataFrame:
    """Rows per calendar date."""
    return group_count(activities, ("date", event_date("timestamp"))).orderBy("date")


def suspicious_only(activities: DataFrame) -> DataFrame:
    return activities.where(F.col("is_suspicious"))


def suspicious_by_reason(activities: DataFrame) -> DataFrame:
    """Suspicious rows per reason; rows without a reason are not grouped."""
    return group_count(suspicious_only(activities), "reason").orderBy("reason")


def top_users(activities: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` users with most rows; ties broken by user_id.

    Partial aggregation per user, then a per-task top-k and one merge of
    ``tasks x k`` rows (TakeOrderedAndProject): no global sort.
    """
    return group_count(activities, "user_id").orderBy(F.desc("count"), F.asc("user_id")).limit(k)


def activity_summary(activities: DataFrame) -> DataFrame:
    """Total rows, distinct users, suspicious rows and distinct IPs in one scan.

    Rows are first counted per (user, ip), map-side, so the two distinct counts
    work on those pairs; over raw rows they would double every row. For
    ranges of days that are asked for again, see
    :class:`~opsframes.incremental.daysets.DaySets`.
    """
    pairs = activities.groupBy("user_id", "ip_address").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_suspicious")).alias("suspicious"))
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_activities"),
        distinct_count("user_id").alias("unique_users"),
        F.coalesce(F.sum("suspicious"), F.lit(0)).alias("suspicious_activities"),
        distinct_count("ip_address").alias("unique_ips"),
    )


def suspicious_activities(activities: DataFrame, reasons: Iterable[str] | None = ()) -> DataFrame:
    """Suspicious rows, optionally limited to some reasons."""
    return where_all(suspicious_only(activities), one_of("reason", reasons))


def suspicious_reasons(activities: DataFrame) -> DataFrame:
    """Distinct non-empty reasons of suspicious rows (the filter's options)."""
    return (suspicious_only(activities)
            .where(F.col("reason").isNotNull() & (F.col("reason") != ""))
            .select("reason").distinct())

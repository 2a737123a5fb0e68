"""Alerts on live streams of API requests and server samples.

Two rollups run in one query, each with its own watermark (state holds only
open hours): requests per (hour, endpoint) and samples per (hour, server).
Each closed hour then goes through the stateless threshold rules in the same
plan: one ``explode`` of the array of alerts the row raises. Server hours
first pass a keyed state that marks runs of rising memory
(:mod:`.rising`), so the infrastructure rollup is read once for both rules.

The query's watermark is the least of the two (:data:`POLICY`): a stream that
lags or stands still holds the other one's hours open rather than have its own
rows dropped as late.

No per-batch Python callback; append mode into the Parquet file sink makes the
output exactly-once across restarts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.exprs import event_time, wall_clock
from ..operators.metrics import api_measures, infra_measures
from ..operators.rules import server_alerts, threshold_alerts
from ..sources.tables import requests_from_events, samples_from_events
from . import sinks
from .rising import STATE_STORE, rising_stream

POLICY = {"spark.sql.streaming.multipleWatermarkPolicy": "min"}


def metrics_stream(requests: DataFrame, watermark: str = "1 hour", period: str = "1 hour") -> DataFrame:
    """Streaming hourly API metrics, same columns as ``api_metrics``."""
    rolled = (requests
              .withColumn("event_time", event_time("timestamp"))
              .withWatermark("event_time", watermark)
              .groupBy(F.window("event_time", period).alias("w"), "endpoint")
              .agg(*api_measures()))
    return rolled.select(wall_clock(F.col("w.start")).alias("timestamp"), "endpoint",
                         "response_time", "error_rate", "throughput")


def infra_stream(samples: DataFrame, watermark: str = "1 hour", period: str = "1 hour") -> DataFrame:
    """Streaming hourly server metrics: the columns of ``infra_metrics`` and the closed window's ``event_time``,
    which carries the watermark on."""
    rolled = (samples
              .withColumn("event_time", event_time("timestamp"))
              .withWatermark("event_time", watermark)
              .groupBy(F.window("event_time", period).alias("w"), "server")
              .agg(*infra_measures()))
    return rolled.select(F.window_time("w").alias("event_time"), wall_clock(F.col("w.start")).alias("timestamp"), "server",
                         "cpu_usage", "memory_usage", "disk_usage", "network_in", "network_out")


def server_hours(samples: DataFrame, leak_samples: int = 3, watermark: str = "1 hour", period: str = "1 hour") -> DataFrame:
    """Closed hours of every server as (server, timestamp, memory_usage, rising, cpu_usage)."""
    hours = infra_stream(samples, watermark, period)
    flagged = rising_stream(hours, "server", "memory_usage", leak_samples, passed=("cpu_usage",))
    # window_time is the window's last microsecond
    start = F.col("event_time") + F.expr("INTERVAL 1 MICROSECOND") - F.expr(f"INTERVAL {period}")
    return flagged.withColumn("timestamp", wall_clock(start)).drop("event_time")


def alert_stream(requests: DataFrame, samples: DataFrame, error_rate: float = 50.0, response_ms: float = 1000.0,
                 cpu: float = S.CPU_BREACH, leak_samples: int = 3, watermark: str = "1 hour") -> DataFrame:
    """All four metric rules on two streams, as one streaming frame of generated alerts."""
    of_endpoints = threshold_alerts(metrics_stream(requests, watermark), error_rate, response_ms)
    return of_endpoints.union(server_alerts(server_hours(samples, leak_samples, watermark), cpu))


def run_alerts(spark: SparkSession, source_dir: str, error_rate: float = 50.0, response_ms: float = 1000.0,
               cpu: float = S.CPU_BREACH, leak_samples: int = 3, watermark: str = "1 hour",
               files_per_trigger: int | None = None, trigger: dict | None = None, glob: str = "events*.parquet",
               paths: tuple[str, str] | None = None) -> DataFrame:
    """Run the alert stream over the event files in ``source_dir`` and read all alerts raised.

    ``paths`` (output, checkpoint) of an earlier run resume it.
    """
    def events() -> DataFrame:
        return sinks.read_event_stream(spark, source_dir, glob, files_per_trigger)

    out, checkpoint = paths or sinks.fresh_paths(spark, "stream_alerts")
    with sinks.settings(spark, STATE_STORE | POLICY):
        alerts = alert_stream(requests_from_events(events()), samples_from_events(events()), error_rate, response_ms, cpu,
                              leak_samples, watermark)
        sinks.run_to_completion(sinks.to_files(alerts, out, checkpoint, trigger))
    return spark.read.parquet(out)

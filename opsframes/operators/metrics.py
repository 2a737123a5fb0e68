"""API and infrastructure metric queries.

``metrics_rollup`` / ``infra_rollup`` build the hourly metric tables from
raw request/sample rows. The snapshot queries anchor on the table's latest
timestamp through a scalar subquery (one extra scan of one column) rather
than the wall clock, so results are reproducible.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.exprs import col, cpu_band, event_date, hour_start
from ..functions.params import latest, since, where_all

_MEASURES = ("response_time", "error_rate", "throughput")


def measures_of_sums(latency, errors, n) -> list:
    """Mean latency, error percentage and requests a minute of one endpoint-hour from its exact sums."""
    n = col(n)
    return [
        (col(latency).cast("double") / n).alias("response_time"),
        (F.lit(100.0) * col(errors).cast("double") / n).alias("error_rate"),
        (n.cast("double") / F.lit(60)).alias("throughput"),
    ]


def api_measures() -> list:
    """Aggregates of one endpoint-period: mean latency, error percentage, requests/minute.

    Sums stay exact (decimal/integer) and are divided once, so the result
    does not depend on summation order.
    """
    return measures_of_sums(F.sum("latency_ms"), F.count_if(F.col("severity").isin(S.ERROR_SEVERITIES)), F.count(F.lit(1)))


def metrics_rollup(requests: DataFrame) -> DataFrame:
    """Hourly per-endpoint metrics from request rows (timestamp, endpoint, severity, latency_ms)."""
    return (requests
            .groupBy(hour_start("timestamp").alias("timestamp"), "endpoint")
            .agg(*api_measures()))


def infra_measures() -> list:
    """Aggregates of one server-period from (load, level) samples; exact sums, divided once."""
    n = F.count(F.lit(1))
    return [
        F.least(F.lit(100.0), F.sum("load").cast("double") / n).alias("cpu_usage"),
        (F.sum("level").cast("double") / n).alias("memory_usage"),
        F.max("level").cast("double").alias("disk_usage"),
        F.sum("load").cast("double").alias("network_in"),
        F.sum("level").cast("double").alias("network_out"),
    ]


def infra_rollup(samples: DataFrame) -> DataFrame:
    """Hourly per-server metrics from (timestamp, server, load, level) samples."""
    return samples.groupBy(hour_start("timestamp").alias("timestamp"), "server").agg(*infra_measures())


def _means(df: DataFrame, key: str = "endpoint") -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.avg(m).alias(m) for m in _MEASURES])


def api_avg_last_day(api: DataFrame) -> DataFrame:
    """Per-endpoint means on the calendar day of the latest timestamp."""
    last_day = api.select(F.max(event_date("timestamp"))).scalar()
    return _means(api.where(event_date("timestamp") == last_day))


def api_overview(api: DataFrame, endpoints: Sequence[str] = S.ENDPOINTS) -> DataFrame:
    """Unweighted mean of the per-endpoint last-day means, and the endpoint count."""
    per_endpoint = api_avg_last_day(api)
    return per_endpoint.agg(
        F.avg("response_time").alias("avg_response_time"),
        F.avg("error_rate").alias("avg_error_rate"),
        F.avg("throughput").alias("avg_throughput"),
        F.lit(len(endpoints)).alias("active_endpoints"),
    )


def api_avg_by_endpoint(api: DataFrame, as_of=None, range_code: str | None = "24h") -> DataFrame:
    """Per-endpoint means over the last 24h / 3d / week before ``as_of``."""
    return _means(api.where(since("timestamp", api, range_code, as_of)))


def endpoint_response_series(api: DataFrame, endpoint: str = S.ENDPOINTS[0], range_code: str | None = None,
                             as_of=None) -> DataFrame:
    """(timestamp, response_time) of one endpoint; whole history without a range."""
    in_range = since("timestamp", api, range_code, as_of) if range_code else None
    return (where_all(api, F.col("endpoint") == endpoint, in_range)
            .select("timestamp", "response_time")
            .orderBy("timestamp"))


def _gauges(snapshot: DataFrame, servers: Sequence[str]) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(s) for s in servers]), F.col("server"))
    return (snapshot
            .select("timestamp", "server", "cpu_usage",
                    cpu_band("cpu_usage").alias("band"),
                    (F.col("cpu_usage") > S.CPU_BREACH).alias("breach"))
            .orderBy(order, "server"))


def cpu_gauges(infra: DataFrame, servers: Sequence[str] = S.SERVERS) -> DataFrame:
    """CPU of each server at the globally latest timestamp, with band and breach.

    Servers without a sample at that instant are left out; duplicate samples
    keep the highest reading.
    """
    snapshot = (infra.where(F.col("timestamp") == latest(infra))
                .groupBy("timestamp", "server")
                .agg(F.max("cpu_usage").alias("cpu_usage")))
    return _gauges(snapshot, servers)


def cpu_gauges_per_server(infra: DataFrame, servers: Sequence[str] = S.SERVERS) -> DataFrame:
    """Each server's own latest CPU sample (servers silent at the global latest
    instant keep their last reading). ``max(struct(timestamp, cpu))`` combines
    map-side, so a server with most of the samples is no hot spot."""
    last = F.max(F.struct("timestamp", "cpu_usage")).alias("last")
    snapshot = infra.groupBy("server").agg(last).select(
        F.col("last.timestamp").alias("timestamp"), "server", F.col("last.cpu_usage").alias("cpu_usage"))
    return _gauges(snapshot, servers)


def _server_rows(infra: DataFrame, server: str, range_code: str | None, as_of) -> DataFrame:
    in_range = since("timestamp", infra, range_code, as_of) if range_code else None
    return where_all(infra, F.col("server") == server, in_range)


def server_trend(infra: DataFrame, server: str = S.SERVERS[0], range_code: str | None = None,
                 as_of=None) -> DataFrame:
    """CPU, memory and disk of one server over time."""
    return (_server_rows(infra, server, range_code, as_of)
            .select("timestamp", "cpu_usage", "memory_usage", "disk_usage")
            .orderBy("timestamp"))


def server_network(infra: DataFrame, server: str = S.SERVERS[0], range_code: str | None = None,
                   as_of=None) -> DataFrame:
    """network_in / network_out of one server as two series (timestamp, metric, value)."""
    rows = _server_rows(infra, server, range_code, as_of).select("timestamp", "network_in", "network_out")
    return (rows.unpivot("timestamp", ["network_in", "network_out"], "metric", "value")
            .orderBy("timestamp", "metric"))

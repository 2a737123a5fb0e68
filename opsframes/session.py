"""Session settings the queries are designed for.

On a cluster, pass the cluster's master and keep its ``spark.checkpoint.dir``;
locally this builds a ``local[n]`` session with the same SQL settings.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SQL_CONF = {
    # Timestamps are timestamp_ntz wall-clock values; hour truncation and
    # the streaming cast to event time go through the session zone.
    "spark.sql.session.timeZone": "UTC",
    # AQE: coalesce small shuffle partitions and split skewed ones. Broadcast
    # joins are chosen from size estimates; file-based estimates are scaled
    # by 3 (Parquet expands when decoded) so only sides whose in-memory size
    # is likely under 32 MB are broadcast, everything else sort-merge joins.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.sources.fileCompressionFactor": "3.0",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Batch jobs, not notebooks: skip capturing the Python call site for every
    # Column built (used only to point error messages at user code).
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "opsframes", master: str | None = None, shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.appName(app).master(master or f"local[{cpus}]")
    conf = dict(SQL_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf["spark.driver.memory"] = os.environ.get("SPARK_DRIVER_MEMORY", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

"""Hourly API metrics brought up to date by loads, late rows included.

Means can't be merged, their sums can: the store keeps per load the number of
requests, of errors and the sum of latencies by (hour, endpoint), partitioned by
date and load. A load adds its sums, and then only the dates it touched are
computed anew from the sums (a few rows an hour) and overwritten in the
metrics table; all other dates' files stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.exprs import event_date, hour_start
from ..operators.metrics import measures_of_sums
from ..sources.files import exists

SUMS = "timestamp timestamp_ntz, endpoint string, n long, errors long, latency decimal(38,2), date date, load string"


class StoredRollup:
    """Sums and metrics under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.sums_path, self.metrics_path = spark, f"{path}/sums", f"{path}/api_metrics"

    def _sums(self) -> DataFrame:
        return self.spark.read.schema(SUMS).parquet(self.sums_path)

    def load(self, requests: DataFrame, name: str) -> list:
        """Add request rows (timestamp, endpoint, severity, latency_ms) under a load name; returns the dates touched.

        A repeated load replaces what the name stored for its dates.
        """
        errors = F.count_if(F.col("severity").isin(S.ERROR_SEVERITIES))
        sums = requests.where(F.col("timestamp").isNotNull()).groupBy(hour_start("timestamp").alias("timestamp"), "endpoint").agg(
            F.count(F.lit(1)).alias("n"), errors.alias("errors"), F.sum("latency_ms").cast("decimal(38,2)").alias("latency"))
        self._write(sums.withColumns({"date": event_date("timestamp"), "load": F.lit(name)}), self.sums_path, "date", "load")
        if not exists(self.spark, self.sums_path):
            return []
        dates = [r["date"] for r in self._sums().where(F.col("load") == name).select("date").distinct().collect()]  # one row a date
        if dates:
            touched = self._sums().where(F.col("date").isin(dates)).groupBy("date", "timestamp", "endpoint").agg(
                *[F.sum(c).alias(c) for c in ("n", "errors", "latency")])
            self._write(touched.select("timestamp", "endpoint", *measures_of_sums("latency", "errors", "n"), "date"), self.metrics_path, "date")
        return sorted(dates)

    @staticmethod
    def _write(df: DataFrame, path: str, *by: str) -> None:
        # the rows of a date are at most 24 x endpoints (x loads): one file each
        (df.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))

    def metrics(self) -> DataFrame:
        """The ``api_metrics`` rows of all that was loaded."""
        if not exists(self.spark, self.metrics_path):
            return self.spark.createDataFrame([], S.API_METRICS)
        return self.spark.read.schema(S.API_METRICS).parquet(self.metrics_path).select(*S.API_METRICS.fieldNames())

"""Log volume by (day, severity) over a stream of log rows.

Event time is the log's wall-clock timestamp; the watermark bounds state
to the open windows, and rows older than the watermark are dropped (the
batch query keeps them). As in Spark 4, a micro-batch drops rows against
the watermark of the batch before it, so a row is late once its window
closed at least one batch earlier. In append mode a window is emitted once
it closes, so the newest day appears only after later data or the final
no-data batch moves the watermark past it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import event_time, wall_clock
from ..functions.params import one_of, where_all
from ..sources.tables import logs_from_events
from . import sinks


def log_volume_stream(logs: DataFrame, window: str = "1 day", watermark: str = "1 hour",
                      severities: Iterable[str] | None = None) -> DataFrame:
    """Streaming counts per (window, severity); output (date, window_start, severity, count)."""
    counted = (where_all(logs, one_of("severity", severities)).where(F.col("severity").isNotNull())
               .withColumn("event_time", event_time("timestamp"))
               .withWatermark("event_time", watermark)
               .groupBy(F.window("event_time", window).alias("w"), "severity")
               .agg(F.count(F.lit(1)).alias("count")))
    start = wall_clock(F.col("w.start"))
    return counted.select(F.to_date(start).alias("date"), start.alias("window_start"), "severity", "count")


def run_log_volume(spark: SparkSession, source_dir: str, window: str = "1 day", watermark: str = "1 hour",
                   files_per_trigger: int | None = None, trigger: dict | None = None,
                   glob: str = "events*.parquet") -> DataFrame:
    """Run the append-mode stream over the event files in ``source_dir`` and read the result."""
    logs = logs_from_events(sinks.read_event_stream(spark, source_dir, glob, files_per_trigger))
    out, checkpoint = sinks.fresh_paths(spark, "stream_log_volume")
    sinks.run_to_completion(sinks.to_files(log_volume_stream(logs, window, watermark), out, checkpoint, trigger))
    return spark.read.parquet(out)

"""Fault-tolerant sinks and sources for the streaming jobs.

* Append-mode results go to the Parquet file sink: its ``_spark_metadata``
  log makes output exactly-once across restarts, and readers of the folder
  only see committed files.
* Other modes go through ``foreachBatch``; each micro-batch overwrites its
  own ``epoch=<id>`` folder, so a batch replayed after a failure replaces
  (never duplicates) its output.

Checkpoints live under the cluster's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from ..sources.files import scratch_path


def read_event_stream(spark: SparkSession, source_dir: str, glob: str = "events*.parquet",
                      files_per_trigger: int | None = None) -> DataFrame:
    """Stream the event tables of a folder (schema declared, no inference).

    ``glob`` names tables, each a single file or a folder of part files.
    """
    reader = spark.readStream.schema(S.EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{source_dir}/{glob}")


def _trigger(writer, trigger: dict | None):
    return writer.trigger(**(trigger or {"availableNow": True}))


def to_files(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
             name: str | None = None) -> StreamingQuery:
    """Append-mode stream into a Parquet folder (exactly-once file sink)."""
    writer = (stream.writeStream.outputMode("append").format("parquet")
              .option("path", path).option("checkpointLocation", checkpoint))
    if name:
        writer = writer.queryName(name)
    return _trigger(writer, trigger).start()


def to_epochs(stream: DataFrame, path: str, checkpoint: str, output_mode: str = "update",
              transform=None, trigger: dict | None = None) -> StreamingQuery:
    """Write each micro-batch (optionally transformed) to ``path/epoch=<id>``, idempotently."""

    def write(batch: DataFrame, epoch_id: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{path}/epoch={epoch_id}")

    writer = (stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
              .foreachBatch(write))
    return _trigger(writer, trigger).start()


def read_epochs(spark: SparkSession, path: str, latest_only: bool = False) -> DataFrame:
    """Read ``epoch=<id>`` output back; ``latest_only`` keeps the last epoch (complete mode)."""
    df = spark.read.option("basePath", path).parquet(f"{path}/epoch=*")
    if latest_only:
        df = df.where(F.col("epoch") == df.select(F.max("epoch")).scalar())
    return df.drop("epoch")


@contextmanager
def settings(spark: SparkSession, conf: Mapping[str, str]) -> Iterator[None]:
    """Session settings for the queries started inside (a query keeps what held when it started)."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def run_to_completion(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def fresh_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """(output folder, checkpoint folder) for one run, under the shared folder."""
    base = scratch_path(spark, name)
    return f"{base}/out", f"{base}/checkpoint"

"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframes.sources.files import scratch_path

BATCH_BYTES = 16 << 20
_sent: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package.

    They do if it is installed or PYTHONPATH names its folder; else it is sent
    with the job, as ``--py-files`` would."""
    package = Path(__file__).resolve().parents[1]
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    context = spark.sparkContext
    if _sent.get("to") != context.applicationId:
        shared = f"{scratch_path(spark, 'package')}/{package.name}.zip"
        to = spark._jvm.org.apache.hadoop.fs.Path(shared)
        system = to.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        with tempfile.TemporaryDirectory() as folder:
            made = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
            system.copyFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path(f"file://{made}"), to)
        delete_at_exit(spark, os.path.dirname(shared))
        context.addPyFile(shared)
        _sent["to"] = context.applicationId


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts lineage: a lost executor re-reads files and never repeats the work
    behind them. The folder is removed when the application ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    delete_at_exit(spark, path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def forget(*frames: DataFrame) -> None:
    """Remove the files of frames that ``keep`` gave and nothing reads any more, as all that used them has been written."""
    for df in frames:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(p)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named input columns, under the operator's own names, so that any
    further columns of the caller cannot clash with those added on the way."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()])


def utf8(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, nulls kept."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def in_slices(batches: Iterable[pa.RecordBatch], text: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``most`` text bytes, or one row."""
    for batch in batches:
        sizes = np.asarray(pa.compute.binary_length(batch.column(text)).fill_null(0), dtype=np.int64)
        begin, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < batch.num_rows:
            yield batch.slice(begin)

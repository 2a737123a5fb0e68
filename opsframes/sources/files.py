"""Typed file sources and sinks.

Reads always declare the schema (no inference pass over the data), and
string timestamps are parsed once at load so queries see ``timestamp_ntz``.
Writes partition by calendar date so date filters prune whole folders.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import wall_clock

# Text timestamps: the dashboard's "%Y-%m-%d %H:%M:%S", with an optional
# fraction of 1-6 digits when parsing; written back with microseconds.
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
TIMESTAMP_WRITE_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SECONDS_FORMAT = "yyyy-MM-dd HH:mm:ss"
CORRUPT = "_corrupt_record"


def _as_text(schema: T.StructType) -> T.StructType:
    """The same schema with timestamp columns read as strings."""
    return T.StructType([
        T.StructField(f.name, T.StringType(), f.nullable)
        if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType, T.DateType)) else f
        for f in schema.fields
    ])


def parse_timestamps(df: DataFrame, schema: T.StructType, fmt: str = TIMESTAMP_FORMAT) -> DataFrame:
    """Cast string timestamp/date columns of ``df`` to the types in ``schema``."""
    out = []
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampNTZType):
            c = F.to_timestamp_ntz(c, F.lit(fmt))
        elif isinstance(f.dataType, T.DateType):
            c = F.to_date(c)
        elif isinstance(f.dataType, T.TimestampType):
            c = F.to_timestamp(c, fmt)
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
               timestamp_format: str = TIMESTAMP_FORMAT, **options) -> DataFrame:
    """Scan a table with a declared schema.

    Parquet/ORC carry typed timestamps; CSV and JSON sources hold them as
    text in ``timestamp_format`` and are parsed here.
    """
    if fmt in ("parquet", "orc"):
        return spark.read.schema(schema).options(**options).format(fmt).load(path)
    reader = spark.read.schema(_as_text(schema)).options(**options)
    if fmt == "csv":
        reader = reader.option("header", options.get("header", "true"))
    return parse_timestamps(reader.format(fmt).load(path), schema, timestamp_format)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder (``spark.checkpoint.dir``).

    Only a local-mode session without one (tests) gets a folder under the
    system temp directory; on a cluster a machine-local folder would not be
    shared, so a missing setting is an error. Reads session settings only,
    so it also works over Spark Connect.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        d = spark.sparkContext.getCheckpointDir()
        if not d:
            import tempfile

            d = tempfile.mkdtemp(prefix="opsframes-ckpt-")
            spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def read_checked(spark: SparkSession, path: str, schema: T.StructType, fmt: str, timestamp_format: str = TIMESTAMP_FORMAT,
                 **options) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)`` rows of a CSV or JSON table that may hold malformed ones; nothing fails and nothing is lost.

    ``good`` has the columns of ``schema``. ``bad`` has ``record`` (the line as
    read if it has no right structure, else its fields as JSON) and ``reasons``:
    ``structure``, ``<column>: missing`` (null or empty where the schema says not
    null) or ``<column>: <type>`` (text that is no such value). Every field is
    read as text and cast on its own; timestamps must have ``timestamp_format``
    and don't depend on the session's zone. One scan yields both: write ``bad``
    away as the quarantine, or read it for counts.
    """
    text = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    reader = (spark.read.schema(text.add(CORRUPT, T.StringType(), True)).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT).options(**options))
    if fmt == "csv":
        reader = reader.option("header", options.get("header", "true")).option("enforceSchema", "true")
    rows = reader.format(fmt).load(path)
    typed, reasons = [], [F.when(F.col(CORRUPT).isNotNull(), F.lit("structure"))]
    for f in schema.fields:
        given = F.col(f.name)
        value = _cast(given, f.dataType, timestamp_format)
        present = given.isNotNull() & ((given != "") | F.lit(isinstance(f.dataType, T.StringType) and f.nullable))
        typed.append(value.alias(f.name))
        reasons.append(F.when(F.col(CORRUPT).isNull() & present & value.isNull(), F.lit(f"{f.name}: {f.dataType.simpleString()}")))
        if not f.nullable:
            reasons.append(F.when(F.col(CORRUPT).isNull() & ~present, F.lit(f"{f.name}: missing")))
    told = rows.select(F.array_compact(F.array(*reasons)).alias("reasons"), F.struct(*typed).alias("row"),
                       F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*text.fieldNames()[:-1]))).alias("record"))
    return told.where(F.size("reasons") == 0).select("row.*"), told.where(F.size("reasons") > 0).select("record", "reasons")


def _cast(text: Column, kind: T.DataType, timestamp_format: str) -> Column:
    """A text field as a value of its type, null if it isn't one."""
    if isinstance(kind, T.TimestampNTZType):
        # read as an instant of UTC and taken back to the wall clock, so that no zone's gaps take part
        return wall_clock(F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit(timestamp_format + "X")))
    if isinstance(kind, T.TimestampType):
        return F.try_to_timestamp(text, F.lit(timestamp_format))
    return text.try_cast(kind)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever file system it names."""
    system, p = _file_system(spark, path)
    return system.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    system, p = _file_system(spark, path)
    system.delete(p, True)


def folder_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """The values of a partition column from its ``column=value`` folders, sorted; no file is opened."""
    system, p = _file_system(spark, path)
    if not system.exists(p):
        return []
    names = (str(s.getPath().getName()) for s in system.listStatus(p) if s.isDirectory())
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{column}=") and not n.endswith("__HIVE_DEFAULT_PARTITION__"))


def listing(spark: SparkSession, path: str) -> tuple:
    """(name, length, modification time) of every file under ``path``, in whatever file system: tells whether a source changed."""
    system, p = _file_system(spark, path)
    if not system.exists(p):
        return ()
    files, out = system.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        out.append((str(f.getPath()), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for ``name`` under the shared scratch folder."""
    return f"{shared_dir(spark)}/opsframes/{name}-{uuid.uuid4().hex[:12]}"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "date",
                date_from: str = "timestamp", mode: str = "overwrite") -> None:
    """Write a query result, partitioned by calendar date when it has a timestamp.

    Each task writes its own files (no coalesce to one writer) after a
    per-task sort on (date, time), so every file covers a contiguous time
    range and timestamp filters skip files by their min/max statistics. The
    output commit protocol makes retried tasks safe.
    """
    if partition_by and partition_by not in df.columns and date_from in df.columns:
        df = df.withColumn(partition_by, F.to_date(F.col(date_from)))
    if partition_by and partition_by in df.columns:
        order = [partition_by] + ([date_from] if date_from in df.columns else [])
        df = df.sortWithinPartitions(*order)
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if fmt in ("csv", "json"):
        writer = (writer.option("timestampNTZFormat", TIMESTAMP_WRITE_FORMAT)
                  .option("timestampFormat", TIMESTAMP_WRITE_FORMAT))
    if partition_by and partition_by in df.columns:
        # an overwrite replaces the dates it writes and leaves all others
        writer = writer.partitionBy(partition_by).option("partitionOverwriteMode", "dynamic")
    writer.save(path)

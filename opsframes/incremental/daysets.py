"""Exact distinct counts over any range of days, from one set per day.

Counts of distinct users can't be added up over days; sets can be united. Each
value gets a dense number once (a dictionary per column, appended to by loads),
and a day's set is a bitmap over those numbers, in buckets of 32,768. A range
is answered by an OR of its days' bitmaps and a count of bits, exactly, and the
activities aren't read. A day costs an eighth of a byte per value of a bucket
that it touches.

Loads are whole days: loading a day again replaces its sets and counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import event_date
from ..sources.files import exists, remove

COLUMNS = ("user_id", "ip_address")
SETS = "name string, bucket long, bits binary, date date"
COUNTS = "total long, suspicious long, no_user_id boolean, no_ip_address boolean, date date"


class DaySets:
    """Dictionaries, day sets and day counts of activities under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _numbers(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/numbers"):
            return self.spark.createDataFrame([], "name string, value string, number long")
        return self.spark.read.schema("name string, value string, number long, load string").parquet(f"{self.path}/numbers").drop("load")

    def _values(self, activities: DataFrame) -> DataFrame:
        """Distinct (date, column name, value) of the activities: a hot user is one row a day and task."""
        pair = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in COLUMNS])).alias("p")
        return (activities.where(F.col("timestamp").isNotNull()).select(event_date("timestamp").alias("date"), pair)
                .select("date", "p.name", "p.value").where("value is not null").distinct())

    def _add_numbers(self, values: DataFrame) -> None:
        """Dense numbers for values without one: numbered within partitions, shifted by the counts of those before.

        Each call appends a folder of its own and none is ever overwritten, so a number once given stays."""
        known, name = self._numbers(), uuid.uuid4().hex
        fresh = values.select("name", "value").distinct().join(known, ["name", "value"], "left_anti")
        at = f"{self.path}/fresh-{name}"
        (fresh.withColumn("part", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id())
         .write.parquet(at))
        placed = self.spark.read.schema("name string, value string, part int, n long").parquet(at)
        parts = placed.groupBy("part").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("rows")).orderBy("part").collect()
        most = known.agg(F.max("number")).first()[0] or 0
        shift = []
        for r in parts:  # one row a partition
            shift.append((r["part"], most + 1 - r["first"]))
            most += r["rows"]
        shifts = self.spark.createDataFrame(shift, "part int, shift long")
        (placed.join(F.broadcast(shifts), "part").select("name", "value", (F.col("n") + F.col("shift")).alias("number"))
         .write.parquet(f"{self.path}/numbers/load={name}"))
        remove(self.spark, at)

    def load(self, activities: DataFrame) -> None:
        """Add whole days of activities; a day loaded again is replaced. One load at a time, as it gives out numbers."""
        values = self._values(activities)
        self._add_numbers(values)
        sets = (values.join(self._numbers(), ["name", "value"])
                .groupBy("date", "name", F.bitmap_bucket_number("number").alias("bucket"))
                .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")))
        counts = activities.where(F.col("timestamp").isNotNull()).groupBy(event_date("timestamp").alias("date")).agg(
            F.count(F.lit(1)).alias("total"), F.count_if("is_suspicious").alias("suspicious"),
            *[F.max(F.col(c).isNull()).alias(f"no_{c}") for c in COLUMNS])
        for df, what in ((sets, "sets"), (counts, "counts")):
            (df.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("date").parquet(f"{self.path}/{what}"))

    def _between(self, what: str, schema: str, start, end) -> DataFrame:
        if not exists(self.spark, f"{self.path}/{what}"):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(f"{self.path}/{what}")
        for bound, cond in ((start, F.col("date") >= F.lit(str(start)[:10]).cast("date")), (end, F.col("date") <= F.lit(str(end)[:10]).cast("date"))):
            df = df.where(cond) if bound else df
        return df

    def summary(self, start=None, end=None) -> DataFrame:
        """:func:`~opsframes.operators.activity.activity_summary` over the days [start, end] (either bound optional)."""
        nothing = {"total": F.lit(0), "suspicious": F.lit(0)} | {f"no_{c}": F.lit(False) for c in COLUMNS} | {c: F.lit(0) for c in COLUMNS}

        def rows(df: DataFrame, given: dict) -> DataFrame:
            return df.select(*[(nothing | given)[c].cast("boolean" if c.startswith("no_") else "long").alias(c) for c in nothing])

        counts = rows(self._between("counts", COUNTS, start, end),
                      {c: F.col(c) for c in ("total", "suspicious", *(f"no_{c}" for c in COLUMNS))})
        united = rows(self._between("sets", SETS, start, end).groupBy("name", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n")),
                      {c: F.when(F.col("name") == c, F.col("n")).otherwise(0) for c in COLUMNS})

        def distinct(c: str):
            return F.coalesce(F.sum(c) + F.max(f"no_{c}").cast("long"), F.lit(0))

        return counts.union(united).agg(
            F.coalesce(F.sum("total"), F.lit(0)).alias("total_activities"), distinct("user_id").alias("unique_users"),
            F.coalesce(F.sum("suspicious"), F.lit(0)).alias("suspicious_activities"), distinct("ip_address").alias("unique_ips"))

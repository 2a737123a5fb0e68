"""First sightings of (user, location), kept day by day, for the new-location rule.

The store holds, per load, the sightings that were new or earlier than any
known before: the table of pairs grows with distinct pairs, not with
activities. A load reads its own activities and the stored pairs only. Late
days just load later: an earlier sighting takes the place of a later one, for
the pair and for the user's very first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import time_and_id
from ..operators.rules import first_sightings, new_locations
from ..sources.files import exists

SCHEMA = "user_id string, ip_address string, activity_id long, timestamp timestamp_ntz, action string"


class Sightings:
    """First sightings under ``path``: ``load=<name>`` folders of improvements."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _loads(self, but: str | None = None) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], SCHEMA)
        loads = self.spark.read.schema(SCHEMA + ", load string").parquet(self.path)
        return (loads if but is None else loads.where(F.col("load") != but)).drop("load")

    def table(self, but: str | None = None) -> DataFrame:
        """The first sighting of every pair over all loads (``but`` one)."""
        return first_sightings(self._loads(but))

    def load(self, activities: DataFrame, name: str) -> None:
        """Merge the pairs of ``activities``; a load of a name known replaces what it stored."""
        known = self.table(but=name).select("user_id", "ip_address", time_and_id("timestamp", "activity_id").alias("known"))
        new = (first_sightings(activities).join(known, ["user_id", "ip_address"], "left")
               .where(F.col("known").isNull() | (time_and_id("timestamp", "activity_id") < F.col("known"))).drop("known"))
        new.write.mode("overwrite").parquet(f"{self.path}/load={name}")

    def compact(self, path: str) -> Sightings:
        """The same table as one load of a new store at ``path``."""
        self.table().write.mode("overwrite").parquet(f"{path}/load=base")
        return Sightings(self.spark, path)

    def findings(self) -> DataFrame:
        """The rows of :func:`~opsframes.operators.rules.suspicious_new_location` over all that was loaded."""
        return new_locations(self.table())

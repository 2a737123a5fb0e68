"""Stores brought up to date load by load equal one pass over everything."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from opsframes.functions.exprs import id_of, time_and_id, time_of
from opsframes.incremental.daysets import DaySets
from opsframes.incremental.rollups import StoredRollup
from opsframes.incremental.sightings import Sightings
from opsframes.operators.activity import activity_summary
from opsframes.operators.metrics import metrics_rollup
from opsframes.operators.rules import suspicious_new_location
from opsframes.sources.files import scratch_path

START = dt.datetime(2024, 1, 1)
ACTIVITY = "activity_id long, timestamp timestamp_ntz, user_id string, action string, ip_address string, is_suspicious boolean, reason string"


@pytest.fixture(scope="module")
def activities(spark):
    """A hot user, nulls, ties on time, ids out of the order of time."""
    rnd = random.Random(4)
    rows = []
    for i in range(3000):
        user = "hot" if i % 3 == 0 else None if i % 97 == 0 else f"u{rnd.randrange(80)}"
        ip = None if i % 101 == 0 else f"10.0.0.{rnd.randrange(30)}"
        rows.append((3000 - i, START + dt.timedelta(minutes=rnd.randrange(10 * 1440)), user, rnd.choice(["login", "logout"]), ip, i % 5 == 0, None))
    rows += [(9001, START, "tie", "b", "1", False, None), (9000, START, "tie", "a", "2", False, None), (9002, START, "tie", "a", "1", False, None)]
    return spark.createDataFrame(rows, ACTIVITY).cache()


def _days(activities, *days):
    return activities.where(F.to_date("timestamp").isin([START.date() + dt.timedelta(days=d) for d in days]))


def _rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols or df.columns).collect()), key=str)


def test_time_and_id_sorts_and_comes_back(spark):
    rows = [(t, i) for t in (dt.datetime(1, 1, 1), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(1970, 1, 1), dt.datetime(2024, 5, 6, 7, 8, 9, 10),
                             dt.datetime(9999, 12, 31, 23, 59, 59, 999999)) for i in (-2 ** 63, -1, 0, 7, 2 ** 63 - 1)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, i long").withColumn("p", time_and_id("t", "i"))
    got = df.orderBy("p").select(time_of("p"), id_of("p")).collect()
    assert [tuple(r) for r in got] == sorted(rows)


def test_new_locations_day_by_day_with_late_days(spark, activities):
    want = _rows(suspicious_new_location(activities))
    store = Sightings(spark, scratch_path(spark, "test-sightings"))
    assert not store.findings().count()
    for d in (5, 0, 9, 3, 1, 2, 8, 7, 6, 4):  # late days after later ones
        store.load(_days(activities, d), f"day-{d}")
    assert _rows(store.findings(), *suspicious_new_location(activities).columns) == want
    store.load(_days(activities, 3), "day-3")  # a repeated load
    assert _rows(store.findings()) == want
    compact = store.compact(scratch_path(spark, "test-compact"))
    assert _rows(compact.findings()) == want
    stored = spark.read.parquet(compact.path)
    assert stored.count() == activities.where("user_id is not null and ip_address is not null").select("user_id", "ip_address").distinct().count()


def test_first_sightings_hash_aggregate_the_raw_rows(spark, activities):
    p = suspicious_new_location(activities)._jdf.queryExecution().executedPlan().toString()
    lowest = p[:p.index("InMemoryTableScan")].rsplit("Aggregate", 1)[0].splitlines()[-1]
    assert lowest.strip().endswith("Hash"), lowest


def test_rollup_with_late_rows_equals_one_pass(spark):
    rnd = random.Random(8)
    rows = [(START + dt.timedelta(minutes=rnd.randrange(4 * 1440)), rnd.choice(["/a", "/b"]), rnd.choice(["ERROR", "INFO"]), rnd.randrange(1, 9999))
            for _ in range(2000)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, endpoint string, severity string, cents int").select(
        "timestamp", "endpoint", "severity", (F.col("cents") / 100).cast("decimal(18,2)").alias("latency_ms")).cache()
    late = F.minute("timestamp") % 11 == 0
    on = F.to_date("timestamp") < F.lit(START.date() + dt.timedelta(days=2))
    store = StoredRollup(spark, scratch_path(spark, "test-rollup"))
    assert store.load(df.where(~late), "first") == [START.date() + dt.timedelta(days=d) for d in range(4)]
    files = lambda: {f for f in spark.read.parquet(store.metrics_path).inputFiles() if "date=2024-01-03" in f or "date=2024-01-04" in f}
    before = files()
    assert store.load(df.where(late & on), "late") == [START.date(), START.date() + dt.timedelta(days=1)]
    assert len(before) == 2 and files() == before  # dates without late rows were not written again
    assert _rows(store.metrics()) == _rows(metrics_rollup(df.where(~late | on)))
    store.load(df.where(late & on), "late")  # a repeated load adds nothing
    store.load(df.where(late & ~on), "later")
    assert _rows(store.metrics()) == _rows(metrics_rollup(df))
    assert store.load(df.limit(0), "none") == [] and _rows(store.metrics()) == _rows(metrics_rollup(df))


def test_ranges_from_day_sets(spark, activities):
    store = DaySets(spark, scratch_path(spark, "test-daysets"))
    assert [tuple(r) for r in store.summary().collect()] == [(0, 0, 0, 0)]
    store.load(_days(activities, 0, 1, 2, 7))
    store.load(_days(activities, 3, 4, 5, 6, 8, 9))
    for lo, hi in [(0, 9), (2, 3), (4, 4), (8, 9), (20, 21)]:
        start, end = START.date() + dt.timedelta(days=lo), START.date() + dt.timedelta(days=hi)
        want = activity_summary(_days(activities, *range(lo, hi + 1)))
        assert _rows(store.summary(start, end)) == _rows(want), (lo, hi)
    assert _rows(store.summary()) == _rows(activity_summary(activities))
    few = _days(activities, 3).where("user_id <> 'hot'").withColumn("user_id", F.concat(F.lit("other-"), "user_id"))
    for again in (few, few, _days(activities, 3), _days(activities, 3)):  # a day loaded again replaces itself, also with values never seen
        store.load(again)
    assert _rows(store.summary()) == _rows(activity_summary(activities))
    numbers = store._numbers()
    assert numbers.groupBy("name", "value").count().where("count > 1").count() == 0
    assert numbers.agg(F.max("number")).first()[0] == numbers.count()  # dense
    p = store.summary("2024-01-02", "2024-01-03")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in p and "activity_id" not in p


def test_many_values_fill_several_buckets(spark):
    n = 70_000
    rows = spark.range(n).select(F.col("id").alias("activity_id"), F.lit(START).cast("timestamp_ntz").alias("timestamp"),
                                 F.concat(F.lit("u"), "id").alias("user_id"), F.lit("a").alias("action"), F.lit("1").alias("ip_address"),
                                 F.lit(False).alias("is_suspicious"), F.lit(None).cast("string").alias("reason"))
    store = DaySets(spark, scratch_path(spark, "test-many"))
    store.load(rows)
    store.load(rows.where("activity_id % 2 = 0").withColumn("timestamp", F.lit(START + dt.timedelta(days=1)).cast("timestamp_ntz")))
    assert [r.unique_users for r in store.summary().collect()] == [n]
    assert [r.unique_users for r in store.summary(START.date() + dt.timedelta(days=1)).collect()] == [n // 2]

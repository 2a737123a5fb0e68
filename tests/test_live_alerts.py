"""Keyed state, two watermarks and the stream-stream join against the batch rules on the same files."""

from __future__ import annotations

import datetime as dt
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from opsframes.functions.exprs import event_time, wall_clock
from opsframes.functions.windows import run_lengths
from opsframes.operators import rules
from opsframes.operators.alerts import apply_alert_actions
from opsframes.sources.tables import load
from opsframes.streaming import sinks
from opsframes.streaming.actions import run_alert_actions
from opsframes.streaming.alerts import POLICY, alert_stream, run_alerts
from opsframes.streaming.rising import STATE_STORE, rising_stream

from conftest import SF_SMALL

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def split_events(tmp_path_factory):
    """The small events in five files in order of time, but for neighbours swapped within minutes; the last arrives later."""
    d = tmp_path_factory.mktemp("events")
    t = pq.read_table(f"{SF_SMALL}/events.parquet")
    rows = list(range(t.num_rows))
    rnd = random.Random(1)
    for i in range(0, len(rows) - 3, 3):
        rows[i:i + 3] = rnd.sample(rows[i:i + 3], 3)
    t = t.take(rows)
    step = -(-t.num_rows // 5)
    for i in range(5):
        name = f"{d}/events-{i}.parquet" if i < 4 else f"{d}/later-4.parquet"
        pq.write_table(t.slice(i * step, step), name)
        os.utime(name, (1_000_000 * (i + 1),) * 2)
    return str(d)


def _arrive(d):
    if os.path.exists(f"{d}/later-4.parquet"):
        os.rename(f"{d}/later-4.parquet", f"{d}/events-4.parquet")


def _closed(tables, hours=1):
    last = tables.events.agg(F.max("ts")).first()[0]
    return lambda df: sorted(map(tuple, df.where(F.col("timestamp") + F.expr("INTERVAL 1 HOUR")
                                                 <= F.lit(last - dt.timedelta(hours=hours)).cast("timestamp_ntz")).collect()))


def test_alert_stream_equals_batch_rules_after_a_restart(spark, split_events):
    t = load(spark, SF_SMALL)
    p = dict(error_rate=50.0, response_ms=100.0, cpu=90.0, leak_samples=3)
    paths = sinks.fresh_paths(spark, "test_live")
    first = run_alerts(spark, split_events, **p, files_per_trigger=1, watermark="12 hours", paths=paths).count()
    _arrive(split_events)
    got = run_alerts(spark, split_events, **p, files_per_trigger=1, watermark="12 hours", paths=paths)
    ts, ep, srv = F.col("timestamp"), F.col("endpoint"), F.col("server")
    batch = (rules.as_alerts(rules.alert_high_error_rate(t.api_metrics, 50.0), "High Error Rate", "error_rate", ts, "endpoint", ep)
             .union(rules.as_alerts(rules.alert_slow_response(t.api_metrics, 100.0), "Slow Response Time", "slow_response", ts, "endpoint", ep))
             .union(rules.as_alerts(rules.alert_high_cpu(t.infra_metrics, 90.0), "High CPU Usage", "high_cpu", ts, "server", srv))
             .union(rules.as_alerts(rules.alert_memory_leak(t.infra_metrics, 3), "Memory Leak", "memory_leak", ts, "server", srv)))
    want = _closed(t, 12)(batch)
    assert {r[2] for r in want} == {"High Error Rate", "Slow Response Time", "High CPU Usage", "Memory Leak"}
    assert sorted(map(tuple, got.select(batch.columns).collect())) == want
    assert 0 < first < len(want)


def _samples(spark, folder, batches):
    for i, b in enumerate(batches):
        name = f"{folder}/s-{i}.parquet"
        pq.write_table(pa.table({"server": pa.array([r[0] for r in b]), "timestamp": pa.array([r[1] for r in b], pa.timestamp("us")),
                                 "v": pa.array([r[2] for r in b], pa.float64()), "w": pa.array([1.5] * len(b))}), name)
        os.utime(name, (1_000_000 * (i + 1),) * 2)


def test_rising_state_takes_samples_in_time_order(spark, tmp_path):
    """Out of order inside the watermark, ties, nulls, a silent server: the flags of the batch function."""
    rnd = random.Random(2)
    rows = [(s, START + dt.timedelta(minutes=7 * i + k), None if i % 31 == 5 else float(rnd.randint(0, 6)))
            for i in range(60) for k, s in enumerate(["a", "b"])]
    rows += [("a", START + dt.timedelta(minutes=70), 3.0), ("quiet", START, 1.0), ("quiet", START + dt.timedelta(minutes=400), 2.0)]
    rows.sort(key=lambda r: r[1] + dt.timedelta(minutes=rnd.uniform(0, 50)))  # at most 50 minutes late
    rows.append(("b", START + dt.timedelta(days=2), 1.0))
    _samples(spark, tmp_path, [rows[i:i + 25] for i in range(0, len(rows), 25)])
    schema = "server string, timestamp timestamp_ntz, v double, w double"
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
              .withColumn("event_time", event_time("timestamp")).withWatermark("event_time", "2 hours"))
    out, checkpoint = sinks.fresh_paths(spark, "test_rising")
    with sinks.settings(spark, STATE_STORE):
        sinks.run_to_completion(sinks.to_files(rising_stream(stream, "server", "v", 3, ("w",)), out, checkpoint))
    got = spark.read.parquet(out).withColumn("timestamp", wall_clock("event_time"))
    batch = run_lengths(spark.read.schema(schema).parquet(str(tmp_path)), "server", "timestamp", "v").withColumn("rising", F.col("run") >= 3)
    final = batch.where(F.col("timestamp") < F.lit(START + dt.timedelta(days=1)).cast("timestamp_ntz"))
    cols = ["server", "timestamp", "v", "rising", "w"]
    key = lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[3])
    assert sorted(map(tuple, got.select(cols).collect()), key=key) == sorted(map(tuple, final.select(cols).collect()), key=key)


def test_a_lagging_stream_holds_the_other_open(spark, tmp_path):
    """With the least watermark the samples that lag behind the requests are not dropped."""
    def write(sub, i, hours):
        os.makedirs(f"{tmp_path}/{sub}", exist_ok=True)
        name = f"{tmp_path}/{sub}/part-{i}.parquet"
        pq.write_table(pa.table({"ts": pa.array([START + dt.timedelta(hours=h) for h in hours], pa.timestamp("us"))}), name)
        os.utime(name, (1_000_000 * (i + 1),) * 2)
    for i in range(3):
        write("requests", i, [24 * i + h for h in range(24)])  # a day a batch
        write("samples", i, [6 * i + h for h in range(6)])  # six hours a batch
    read = lambda sub: spark.readStream.schema("ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{sub}")
    requests = read("requests").select(F.col("ts").alias("timestamp"), F.lit("/e").alias("endpoint"), F.lit("ERROR").alias("severity"),
                                       F.lit(5).cast("decimal(18,2)").alias("latency_ms"))
    samples = read("samples").select(F.col("ts").alias("timestamp"), F.lit("s").alias("server"), F.lit(99).cast("decimal(18,2)").alias("load"),
                                     F.lit(1).alias("level"))
    out, checkpoint = sinks.fresh_paths(spark, "test_policy")
    with sinks.settings(spark, STATE_STORE | POLICY):
        sinks.run_to_completion(sinks.to_files(alert_stream(requests, samples), out, checkpoint))
    got = spark.read.parquet(out).groupBy("type").agg(F.count("*").alias("n"), F.max("timestamp").alias("last"))
    # samples reach 17:00, so all hours that end by 16:00 are closed, on either side
    assert {r.type: (r.n, r.last.hour) for r in got.collect()} == {"High CPU Usage": (16, 15), "High Error Rate": (16, 15)}


def test_live_actions_equal_the_batch_result(spark, split_events):
    t = load(spark, SF_SMALL)
    paths = sinks.fresh_paths(spark, "test_actions")
    first = run_alert_actions(spark, split_events, "6 hours", "12 hours", files_per_trigger=1, paths=paths).count()
    _arrive(split_events)
    got = run_alert_actions(spark, split_events, "6 hours", "12 hours", files_per_trigger=1, paths=paths)
    last = t.alerts.agg(F.max("timestamp")).first()[0]
    want = apply_alert_actions(t.alerts, t.alert_actions, "6 hours").where(
        F.col("timestamp") <= F.lit(last - dt.timedelta(hours=18)).cast("timestamp_ntz"))
    rows_ = sorted(map(tuple, want.collect()), key=str)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == rows_
    assert 0 <= first <= len(rows_) and {r[-1] is None for r in rows_} == {True, False}  # acted on and not


def test_actions_outside_the_bound_do_not_count(spark):
    from conftest import make_actions, make_alerts
    alerts = make_alerts(spark, [(1, "2024-01-01 10:00:00", "t", "ERROR", "high", "d", "active"), (2, "2024-01-01 10:00:00", "t", "ERROR", "high", "d", "active"),
                                 (3, "2024-01-01 10:00:00", "t", "ERROR", "high", "d", "active")])
    actions = make_actions(spark, [(1, "resolved", "2024-01-01 09:59:59"), (1, "acknowledged", "2024-01-01 12:00:00"), (1, "resolved", "2024-01-01 12:00:01"),
                                   (2, "resolved", "2024-01-01 10:00:00"), (2, "acknowledged", "2024-01-01 10:00:00"), (9, "resolved", "2024-01-01 10:00:00")])
    got = {r.alert_id: r.status for r in apply_alert_actions(alerts, actions, "2 hours").collect()}
    assert got == {1: "acknowledged", 2: "resolved", 3: "active"}
    assert {r.alert_id: r.status for r in apply_alert_actions(alerts, actions).collect()} == {1: "resolved", 2: "resolved", 3: "active"}

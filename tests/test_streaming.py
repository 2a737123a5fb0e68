"""Stream/batch parity for log volume, watermark drops, and the alert stream."""

from __future__ import annotations

import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq

from opsframes.operators.logs import log_volume
from opsframes import schemas as S
from opsframes.sources.tables import Tables, load, logs_from_events
from opsframes.streaming import sinks
from opsframes.streaming.alerts import run_alerts
from opsframes.streaming.log_volume import log_volume_stream, run_log_volume

from conftest import SF_SMALL, rows


def _counts(df):
    return sorted(rows(df, "date", "severity", "count"))


def test_complete_mode_equals_batch(spark):
    logs = logs_from_events(sinks.read_event_stream(spark, SF_SMALL))
    out, ckpt = sinks.fresh_paths(spark, "test_complete")
    q = sinks.to_epochs(log_volume_stream(logs), out, ckpt, output_mode="complete")
    sinks.run_to_completion(q)
    streamed = sinks.read_epochs(spark, out, latest_only=True)
    assert _counts(streamed) == _counts(log_volume(load(spark, SF_SMALL).logs))


def test_append_mode_emits_closed_days_only(spark):
    batch = _counts(log_volume(load(spark, SF_SMALL).logs))
    streamed = _counts(run_log_volume(spark, SF_SMALL))
    last_day = max(r[0] for r in batch)
    assert streamed == [r for r in batch if r[0] < last_day]


def _event_file(path, rows_):
    table = pa.table({
        "event_id": pa.array([r[0] for r in rows_], pa.int64()),
        "ts": pa.array([r[1] for r in rows_], pa.timestamp("us")),
        "user_id": pa.array([1] * len(rows_), pa.int64()),
        "event_type": pa.array(["view"] * len(rows_), pa.string()),
        "value": pa.array([1.0] * len(rows_), pa.float64()),
        "props": pa.array(['{"k": 1}'] * len(rows_), pa.string()),
    })
    pq.write_table(table, path)


def test_row_older_than_watermark_is_dropped(spark):
    import datetime as dt

    d = tempfile.mkdtemp(prefix="late-", dir=os.environ.get("TMPDIR", "/tmp"))
    day = dt.datetime(2024, 1, 1)
    files = [
        [(1, day + dt.timedelta(hours=1)), (2, day + dt.timedelta(days=3))],
        [(3, day + dt.timedelta(days=4))],
        # arrives two micro-batches after the watermark passed the end of Jan 1
        [(4, day + dt.timedelta(hours=2)), (5, day + dt.timedelta(days=6))],
    ]
    for i, f in enumerate(files):
        _event_file(f"{d}/events-{i}.parquet", f)
        os.utime(f"{d}/events-{i}.parquet", (1_000_000 * (i + 1), 1_000_000 * (i + 1)))
    streamed = run_log_volume(spark, d, files_per_trigger=1)
    got = {(str(r[0]), r[2]) for r in rows(streamed, "date", "severity", "count")}
    assert ("2024-01-01", 1) in got  # the late row (event 4) is dropped
    all_events = Tables(spark.read.schema(S.EVENTS).parquet(d))
    batch = {(str(r[0]), r[2]) for r in rows(log_volume(all_events.logs), "date", "severity", "count")}
    assert ("2024-01-01", 2) in batch


def test_alert_stream_only_closed_hours(spark):
    alerts = run_alerts(spark, SF_SMALL, error_rate=50.0, response_ms=100.0)
    assert set(alerts.columns) == {"alert_key", "timestamp", "type", "severity", "priority", "description",
                                   "status"}
    last = load(spark, SF_SMALL).events.agg({"ts": "max"}).collect()[0][0]
    import datetime as dt

    for r in alerts.select("timestamp").collect():
        assert r[0] + dt.timedelta(hours=1) <= last - dt.timedelta(hours=1)


def test_rocksdb_state_store_gives_same_result(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rocks = _counts(run_log_volume(spark, SF_SMALL))
    finally:
        spark.conf.set(key, before)
    assert rocks == _counts(run_log_volume(spark, SF_SMALL))


def test_restart_from_checkpoint_adds_without_duplicates(spark):
    import datetime as dt

    d = tempfile.mkdtemp(prefix="restart-", dir=os.environ.get("TMPDIR", "/tmp"))
    day = dt.datetime(2024, 1, 1)
    _event_file(f"{d}/events-0.parquet", [(1, day + dt.timedelta(hours=1)), (2, day + dt.timedelta(days=1, hours=2))])
    out, ckpt = sinks.fresh_paths(spark, "test_restart")

    def run():
        logs = logs_from_events(sinks.read_event_stream(spark, d))
        sinks.run_to_completion(sinks.to_files(log_volume_stream(logs), out, ckpt))
        return sorted((str(r[0]), r[1], r[2]) for r in rows(spark.read.parquet(out), "date", "severity", "count"))

    first = run()
    assert first == [("2024-01-01", "INFO", 1)]
    # new data arrives; the restarted query resumes from its checkpoint
    _event_file(f"{d}/events-1.parquet", [(3, day + dt.timedelta(days=1, hours=5)), (4, day + dt.timedelta(days=3))])
    second = run()
    assert second == [("2024-01-01", "INFO", 1), ("2024-01-02", "INFO", 2)]

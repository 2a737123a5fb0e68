"""Inputs the shared test tables don't hold: nothing may be lost or moved."""

from __future__ import annotations

import datetime as dt

import pytest

from opsframes import schemas as S
from opsframes.functions.exprs import hour_start
from opsframes.functions.windows import rising_run
from opsframes.operators import logs as L
from opsframes.sources.files import write_table
from opsframes.streaming.log_volume import run_log_volume

from conftest import SF_SMALL, make_logs


def test_stream_reads_a_table_of_part_files(spark, tmp_path):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/one/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/many/events.parquet")
    want = sorted(map(tuple, run_log_volume(spark, SF_SMALL).collect()))
    for name in ("one", "many"):
        assert sorted(map(tuple, run_log_volume(spark, f"{tmp_path}/{name}").collect())) == want and want


def test_unlisted_severities_count(spark):
    logs = make_logs(spark, [("1", "2024-01-01", "DEBUG", "/a", "u", "CAFÉ down", "c"), ("2", "2024-01-01", "INFO", "/a", "u", "m", "c")]
                     if S.LOGS["log_id"].dataType.simpleString() == "string" else
                     [(1, "2024-01-01", "DEBUG", "/a", "u", "CAFÉ down", "c"), (2, "2024-01-01", "INFO", "/a", "u", "m", "c")])
    assert {r.severity for r in L.log_volume(logs).collect()} == {"DEBUG", "INFO"}
    assert L.log_class_by_severity(logs).first()["DEBUG"] == 1
    assert L.search_logs(logs, "café").count() == 1


@pytest.mark.parametrize("block", [1, 2, 3, 8])
def test_block_size_never_changes_rising_runs(spark, block):
    rows = [(dt.datetime(2024, 1, 1, 0, i), "s", float(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, server string, v double")
    assert rising_run(df, "server", "timestamp", "v", 4, block=block).where("rising").count() == 5


def test_hours_ignore_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = [(dt.datetime(2024, 3, 10, h, 10),) for h in (1, 2, 3)]
        df = spark.createDataFrame(rows, "timestamp timestamp_ntz").select(hour_start("timestamp").cast("string").alias("h"))
        assert sorted(r.h for r in df.collect()) == [f"2024-03-10 0{h}:00:00" for h in (1, 2, 3)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_rewriting_a_date_leaves_the_others(spark, tmp_path):
    two = spark.createDataFrame([(dt.datetime(2024, 1, d), d) for d in (1, 2)], "timestamp timestamp_ntz, v int")
    write_table(two, f"{tmp_path}/t")
    write_table(two.where("v = 2").selectExpr("timestamp", "v + 10 AS v"), f"{tmp_path}/t")
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [1, 12]

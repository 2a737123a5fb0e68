"""Typed sources (CSV/JSON with string timestamps) and the date-partitioned sink."""

from __future__ import annotations

import os
import tempfile

from opsframes import schemas as S
from opsframes.sources.files import read_checked, read_table, write_table
from opsframes.sources.tables import load

from conftest import SF_SMALL, rows


def test_text_sources_parse_timestamps(spark):
    d = tempfile.mkdtemp(prefix="src-")
    with open(f"{d}/logs.csv", "w") as f:
        f.write("log_id,timestamp,severity,endpoint,user_id,message,log_class\n")
        f.write("1,2024-01-02 03:04:05,ERROR,/api/users,user_1,boom,Network\n")
    with open(f"{d}/logs.json", "w") as f:
        f.write('{"log_id": 2, "timestamp": "2024-01-02 03:04:06", "severity": "INFO", "endpoint": "/api/orders",'
                ' "user_id": "user_2", "message": "ok", "log_class": "Database"}\n')
    csv = read_table(spark, f"{d}/logs.csv", S.LOGS, fmt="csv")
    js = read_table(spark, f"{d}/logs.json", S.LOGS, fmt="json")
    assert csv.schema == js.schema
    assert [f.dataType.typeName() for f in csv.schema][:2] == ["long", "timestamp_ntz"]
    assert str(rows(csv, "timestamp")[0][0]) == "2024-01-02 03:04:05"
    assert rows(js, "log_id", "severity") == [(2, "INFO")]


def test_write_table_partitions_by_date(spark):
    logs = load(spark, SF_SMALL).logs
    out = tempfile.mkdtemp(prefix="export-") + "/logs"
    write_table(logs, out)
    parts = sorted(p for p in os.listdir(out) if p.startswith("date="))
    assert len(parts) == logs.selectExpr("count(distinct to_date(timestamp))").collect()[0][0]
    back = spark.read.parquet(out)
    assert back.count() == logs.count()
    one_day = back.where("date = date'2024-01-05'")
    assert "PartitionFilters: [isnotnull(date" in one_day._jdf.queryExecution().executedPlan().toString()


def test_orc_and_csv_round_trip(spark):
    logs = load(spark, SF_SMALL).logs
    base = tempfile.mkdtemp(prefix="fmt-")
    for fmt in ("orc", "csv", "json"):
        out = f"{base}/{fmt}"
        write_table(logs, out, fmt=fmt)
        back = read_table(spark, out, S.LOGS, fmt=fmt)
        assert back.columns[:len(S.LOGS.fieldNames())] == S.LOGS.fieldNames()
        assert sorted(rows(back.select(*S.LOGS.fieldNames()))) == sorted(rows(logs)), fmt


BAD_CSV = """log_id,timestamp,severity,endpoint,user_id,message,log_class
1,2024-01-02 03:04:05,ERROR,/api/users,user_1,"a, quoted 'one'",Network
x2,2024-01-02 03:04:05,ERROR,/api/users,user_1,boom,Network
3,2024-02-30 03:04:05,ERROR,/api/users,user_1,boom,Network
4,yesterday,,/api/users,user_1,boom,Network
5,2024-01-02
6,2024-03-10 02:30:00,INFO,/api/users,user_1,in a zone's gap,Network
7,2024-01-02 03:04:05,ERROR,/api/users,user_1,boom,Network,one,more
99999999999999999999,2024-01-02 03:04:05,ERROR,/api/users,user_1,boom,Network
"""
BAD_JSON = """{"log_id": 1, "timestamp": "2024-01-02 03:04:05", "severity": "ERROR", "endpoint": "e", "user_id": "u", "message": "m", "log_class": "c", "extra": 1}
{"log_id": 2, "timestamp": "2024-01-02 03:04:05", "severity": null, "endpoint": "e", "user_id": "u", "message": "m", "log_class": "c"}
{"log_id": 3, "timestamp": "2024-01-02
not json
{"timestamp": 5, "severity": "ERROR", "endpoint": "e", "user_id": "u", "message": "m", "log_class": "c"}
[]
"""


def test_malformed_rows_go_to_quarantine(spark, tmp_path):
    (tmp_path / "a.csv").write_text(BAD_CSV)
    (tmp_path / "a.json").write_text(BAD_JSON)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        good, bad = read_checked(spark, str(tmp_path / "a.csv"), S.LOGS, "csv")
        assert [f.dataType for f in good.schema] == [f.dataType for f in S.LOGS]
        assert sorted((r.log_id, str(r.timestamp), r.message) for r in good.collect()) == [
            (1, "2024-01-02 03:04:05", "a, quoted 'one'"), (6, "2024-03-10 02:30:00", "in a zone's gap")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    told = {tuple(r.reasons): r.record for r in bad.collect()}
    assert bad.count() == 6 and len(told) == 4
    assert set(told) == {("log_id: bigint",), ("timestamp: timestamp_ntz",), ("timestamp: timestamp_ntz", "severity: missing"), ("structure",)}
    assert told[("timestamp: timestamp_ntz", "severity: missing")] == (
        '{"log_id":"4","timestamp":"yesterday","endpoint":"/api/users","user_id":"user_1","message":"boom","log_class":"Network"}')
    good, bad = read_checked(spark, str(tmp_path / "a.json"), S.LOGS, "json")
    assert rows(good, "log_id", "severity") == [(1, "ERROR")]
    told = sorted((tuple(r.reasons), r.record) for r in bad.collect())
    assert [t[0] for t in told].count(("structure",)) >= 2 and "not json" in [t[1] for t in told]
    assert ("severity: missing",) in [t[0] for t in told] and ("log_id: missing", "timestamp: timestamp_ntz") in [t[0] for t in told]


def test_checked_read_of_sound_and_empty_files(spark, tmp_path):
    logs = load(spark, SF_SMALL).logs
    for fmt in ("csv", "json"):
        write_table(logs, f"{tmp_path}/{fmt}", fmt=fmt, partition_by=None)
        good, bad = read_checked(spark, f"{tmp_path}/{fmt}", S.LOGS, fmt)
        assert good.exceptAll(logs).count() == 0 and good.count() == logs.count() and bad.count() == 0
        (tmp_path / f"none.{fmt}").write_text("")
        good, bad = read_checked(spark, str(tmp_path / f"none.{fmt}"), S.LOGS, fmt)
        assert good.count() == bad.count() == 0

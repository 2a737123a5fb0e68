from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from opsframes import schemas as S  # noqa: E402
from opsframes.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("opsframes-tests", master="local[*]", shuffle_partitions=8)
    yield s
    s.stop()


def ts(s: str) -> dt.datetime:
    return dt.datetime.strptime(s, "%Y-%m-%d %H:%M:%S" if len(s) > 10 else "%Y-%m-%d")


def make_logs(spark, rows):
    """rows: (log_id, timestamp, severity, endpoint, user_id, message, log_class)."""
    return spark.createDataFrame([(r[0], ts(r[1]), *r[2:]) for r in rows], S.LOGS)


def make_api(spark, rows):
    """rows: (timestamp, endpoint, response_time, error_rate, throughput)."""
    return spark.createDataFrame([(ts(r[0]), *r[1:]) for r in rows], S.API_METRICS)


def make_infra(spark, rows):
    """rows: (timestamp, server, cpu, memory, disk, net_in, net_out)."""
    return spark.createDataFrame([(ts(r[0]), *r[1:]) for r in rows], S.INFRA_METRICS)


def make_activities(spark, rows):
    """rows: (activity_id, timestamp, user_id, action, ip, is_suspicious, reason)."""
    schema = S.USER_ACTIVITIES
    nullable_user = type(schema)([f if f.name != "user_id" else type(f)(f.name, f.dataType, True) for f in schema])
    return spark.createDataFrame([(r[0], ts(r[1]), *r[2:]) for r in rows], nullable_user)


def make_alerts(spark, rows):
    """rows: (alert_id, timestamp, type, severity, priority, description, status)."""
    return spark.createDataFrame([(r[0], ts(r[1]), *r[2:]) for r in rows], S.ALERTS)


def make_actions(spark, rows):
    """rows: (alert_id, new_status, acted)."""
    return spark.createDataFrame([(r[0], r[1], ts(r[2])) for r in rows], S.ALERT_ACTIONS)


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]

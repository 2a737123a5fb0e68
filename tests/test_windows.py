"""The bounded sequential window equals a brute-force per-key scan."""

from __future__ import annotations

import datetime as dt
import random

from opsframes.functions.windows import bursts, positions, rising_run, run_lengths
from opsframes.operators.rules import alert_memory_leak, suspicious_failed_logins

from conftest import make_infra, make_logs


def _brute_rising(series, length):
    out = {}
    for key, pts in series.items():
        pts = sorted(pts)
        for i, (t, v) in enumerate(pts):
            ok = i >= length - 1 and all(pts[j][1] > pts[j - 1][1] for j in range(i - length + 2, i + 1))
            out[(key, t)] = ok
    return out


def _data(seed=7):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    series = {}
    rows = []
    # "hot" holds most rows; gaps of several days between samples cross day buckets
    for key, n in [("hot", 400), ("b", 37), ("c", 5), ("d", 1)]:
        t = base
        for _ in range(n):
            t += dt.timedelta(hours=rnd.choice([1, 1, 2, 30, 75]))
            v = float(rnd.randint(0, 9))
            series.setdefault(key, []).append((t, v))
            rows.append((t.strftime("%Y-%m-%d %H:%M:%S"), key, 1.0, v, 1.0, 1.0, 1.0))
    return series, rows


def test_positions_are_dense_per_key(spark):
    series, rows = _data()
    infra = make_infra(spark, rows)
    got = positions(infra, "server", "timestamp").groupBy("server").agg(
        {"_pos": "max", "*": "count"}).collect()
    for r in got:
        assert r["max(_pos)"] == r["count(1)"] - 1 == len(series[r["server"]]) - 1
    firsts = {r["server"]: r["timestamp"] for r in positions(infra, "server", "timestamp")
              .where("_pos = 0").collect()}
    assert firsts == {k: min(t for t, _ in v) for k, v in series.items()}


def test_rising_run_matches_brute_force_with_tiny_blocks(spark):
    series, rows = _data()
    infra = make_infra(spark, rows).select("timestamp", "server", "memory_usage")
    for length, block, bucket in [(3, 4, "day"), (3, 1 << 16, "day"), (2, 3, "hour"), (4, 5, "day"),
                                  (1, 2, "day"), (3, 7, "minute")]:
        got = {(r["server"], r["timestamp"]): r["rising"]
               for r in rising_run(infra, "server", "timestamp", "memory_usage", length, block=block,
                                   bucket=bucket).collect()}
        assert got == _brute_rising(series, length), (length, block, bucket)


def test_memory_leak_rule_rows(spark):
    series, rows = _data(11)
    infra = make_infra(spark, rows)
    want = {k for k, ok in _brute_rising(series, 3).items() if ok}
    got = {(r["server"], r["timestamp"]) for r in alert_memory_leak(infra, 3).collect()}
    assert got == want


def _runs(pts):
    out, prev, run = [], None, 0
    for t, v in sorted(pts, key=lambda p: (p[0], p[1] is not None, p[1] or 0.0)):
        run = run + 1 if prev is not None and v is not None and v > prev else 1
        out.append((t, v, run))
        prev = v
    return out


def test_run_lengths_merge_over_slices(spark):
    """Any slice width gives the lengths of one scan: rows of one time, nulls, silent slices, long runs over many slices."""
    series, rows = _data(3)
    start = dt.datetime(2024, 3, 1)
    series["up"] = [(start + dt.timedelta(minutes=13 * i), float(i)) for i in range(200)] \
        + [(start + dt.timedelta(days=9, minutes=i), 500.0 + i) for i in range(5)]
    series["ties"] = [(start + dt.timedelta(hours=i // 2), float(i % 5)) for i in range(40)]
    series["nulls"] = [(start + dt.timedelta(hours=i), None if i % 7 == 3 else float(i)) for i in range(40)]
    df = spark.createDataFrame([(k, t, v, "x") for k, p in series.items() for t, v in p] + [(None, start, 1.0, "x"), ("up", None, 9.0, "x")],
                               "server string, timestamp timestamp_ntz, v double, other string").repartition(7)
    want = sorted((k, t, -1.0 if v is None else v, n) for k, p in series.items() for t, v, n in _runs(p))
    for seconds in (600, 3600, 86400, 10 ** 9):
        got = run_lengths(df, "server", "timestamp", "v", seconds)
        assert got.columns == ["server", "timestamp", "v", "other", "run"]
        assert sorted((r.server, r.timestamp, -1.0 if r.v is None else r.v, r.run) for r in got.collect()) == want


def test_run_lengths_order_rows_within_slices_only(spark):
    _, rows = _data()
    infra = make_infra(spark, rows)
    p = alert_memory_leak(infra, 3)._jdf.queryExecution().executedPlan().toString()
    # the raw rows are dealt by (server, slice); what is dealt by server alone are the summaries
    for exchange in (line for line in p.splitlines() if "Exchange hashpartitioning(server" in line):
        assert "_slice" in exchange or "first" in p[p.index(exchange):][:600], exchange


def test_bursts_equal_a_scan(spark):
    rnd = random.Random(5)
    gap = 1800
    pts = {}
    for user, n in [("hot", 3000), ("b", 60), ("c", 1)]:
        t = dt.datetime(2024, 1, 1, 23, 0)
        for _ in range(n):
            t += dt.timedelta(seconds=rnd.choice([0, 1, 60, 1799, 1800, 1801, 7200]) if user != "hot" else rnd.choice([0, 1, 2, 1800]))
            pts.setdefault(user, []).append(t)
    df = spark.createDataFrame([(u, t) for u, p in pts.items() for t in p] + [(None, t), ("b", None)],
                               "user_id string, timestamp timestamp_ntz").repartition(5)
    want = []
    for u, p in pts.items():
        groups = [[p[0]]]
        for a, b in zip(p, p[1:]):
            if (b - a).total_seconds() < gap:
                groups[-1].append(b)
            else:
                groups.append([b])
        want += [(u, g[0], g[-1], len(g)) for g in groups]
    assert sorted(map(tuple, bursts(df, "user_id", "timestamp", gap).collect())) == sorted(want)


def test_failed_logins_over_midnight_are_one_finding(spark):
    logs = make_logs(spark, [
        (1, "2024-01-01 23:50:00", "ERROR", "/api/auth/login", "u", "m", "c"), (2, "2024-01-02 00:10:00", "CRITICAL", "/api/auth/login", "u", "m", "c"),
        (3, "2024-01-02 00:39:59", "ERROR", "/api/auth/login", "u", "m", "c"), (4, "2024-01-02 01:10:00", "ERROR", "/api/auth/login", "u", "m", "c"),
        (5, "2024-01-02 00:12:00", "INFO", "/api/auth/login", "v", "m", "c"), (6, "2024-01-02 00:13:00", "ERROR", "/api/users", "v", "m", "c")])
    got = [tuple(r) for r in suspicious_failed_logins(logs, 2, 1800).collect()]
    assert got == [("u", dt.datetime(2024, 1, 1, 23, 50), dt.datetime(2024, 1, 2, 0, 39, 59), 3)]

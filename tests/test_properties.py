"""Property tests: the Spark queries against a plain-Python model on random small tables."""

from __future__ import annotations

import datetime as dt
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from opsframes import schemas as S
from opsframes.operators import logs as L
from opsframes.operators import views as V

BASE = dt.datetime(2024, 1, 1)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

log_rows = st.lists(
    st.tuples(
        st.integers(0, 5 * 24 * 60 - 1),          # minutes from BASE (5 days)
        st.sampled_from(S.SEVERITY_LEVELS + ["DEBUG"]),
        st.sampled_from(S.ENDPOINTS[:3]),
        st.sampled_from(S.LOG_CLASSES[:3]),
    ),
    min_size=1, max_size=60,
)


def _frame(spark, data):
    rows = [(i, BASE + dt.timedelta(minutes=m), sev, ep, f"user_{i % 4}", f"msg {i}", cls)
            for i, (m, sev, ep, cls) in enumerate(data)]
    return spark.createDataFrame(rows, S.LOGS), rows


@SETTINGS
@given(data=log_rows, chosen=st.lists(st.sampled_from(S.SEVERITY_LEVELS), max_size=3))
def test_log_volume_matches_model(spark, data, chosen):
    df, rows = _frame(spark, data)
    levels = set(chosen) or set(S.SEVERITY_LEVELS) | {"DEBUG"}
    want = Counter((r[1].date(), r[2]) for r in rows if r[2] in levels)
    got = {(r["date"], r["severity"]): r["count"] for r in L.log_volume(df, chosen).collect()}
    assert got == dict(want)


@SETTINGS
@given(data=log_rows, lo=st.integers(0, 4), span=st.integers(0, 3))
def test_classified_date_range_matches_model(spark, data, lo, span):
    df, rows = _frame(spark, data)
    start, end = (BASE + dt.timedelta(days=lo)).date(), (BASE + dt.timedelta(days=lo + span)).date()
    want = sorted(r[0] for r in rows if start <= r[1].date() <= end and r[2] in ("ERROR", "CRITICAL"))
    got = sorted(r[0] for r in L.classified_logs(df, severities=["ERROR", "CRITICAL"], start=str(start),
                                                 end=str(end)).select("log_id").collect())
    assert got == want


@SETTINGS
@given(data=log_rows, size=st.integers(1, 7), desc=st.booleans())
def test_pages_match_model_and_keyset(spark, data, size, desc):
    df, rows = _frame(spark, data)
    direction = "desc" if desc else "asc"
    model = sorted(rows, key=lambda r: (r[1], r[0]), reverse=desc)
    sort = [("timestamp", direction), ("log_id", direction)]
    after = None
    for p in range((len(model) + size - 1) // size + 1):
        want = [r[0] for r in model[p * size:(p + 1) * size]]
        got = [r[0] for r in V.table_page(df, sort=sort, page=p, size=size).select("log_id").collect()]
        assert got == want
        keyset = V.page_after(df, sort, after, size=size).select("timestamp", "log_id").collect()
        assert [r[1] for r in keyset] == want
        if keyset:
            after = (keyset[-1][0], keyset[-1][1])


@SETTINGS
@given(data=log_rows)
def test_crosstab_matches_model(spark, data):
    df, rows = _frame(spark, data)
    want = Counter((r[6], r[2]) for r in rows)
    for r in L.log_class_by_severity(df).collect():
        for sev in sorted(S.SEVERITY_LEVELS):
            assert r[sev] == want.get((r["log_class"], sev), 0)


@SETTINGS
@given(data=log_rows, size=st.integers(1, 5))
def test_keyset_paging_with_mixed_directions(spark, data, size):
    df, rows = _frame(spark, data)
    sort = [("severity", "asc"), ("timestamp", "desc"), ("log_id", "asc")]
    model = sorted(rows, key=lambda r: (r[2], -r[1].timestamp(), r[0]))
    after, seen = None, []
    while True:
        page = V.page_after(df, sort, after, size=size).select("severity", "timestamp", "log_id").collect()
        if not page:
            break
        seen.extend(r[2] for r in page)
        after = tuple(page[-1])
    assert seen == [r[0] for r in model]
    offset_pages = []
    for p in range((len(model) + size - 1) // size):
        offset_pages.extend(r[0] for r in V.table_page(df, sort=sort, page=p, size=size).select("log_id").collect())
    assert offset_pages == seen


series_rows = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 3 * 24 * 60), st.integers(0, 5)),
    min_size=1, max_size=50, unique_by=lambda r: (r[0], r[1]),
)


@SETTINGS
@given(data=series_rows, length=st.integers(1, 4), block=st.integers(1, 6),
       bucket=st.sampled_from(["day", "hour", "minute"]))
def test_rising_run_matches_model(spark, data, length, block, bucket):
    from pyspark.sql import types as T

    from opsframes.functions.windows import rising_run

    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("t", T.TimestampNTZType()),
                           T.StructField("v", T.DoubleType())])
    df = spark.createDataFrame([(k, BASE + dt.timedelta(minutes=m), float(v)) for k, m, v in data], schema)
    want = {}
    for key in {r[0] for r in data}:
        pts = sorted((m, v) for k, m, v in data if k == key)
        for i, (m, v) in enumerate(pts):
            want[(key, BASE + dt.timedelta(minutes=m))] = i >= length - 1 and all(
                pts[j][1] > pts[j - 1][1] for j in range(i - length + 2, i + 1))
    got = {(r["k"], r["t"]): r["rising"]
           for r in rising_run(df, "k", "t", "v", length, block=block, bucket=bucket).collect()}
    assert got == want

"""A hot key holding a third of all rows: results stay exact, work is combined map-side."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from opsframes.operators import activity as A
from opsframes.operators import rules as R
from opsframes.sources.catalog import catalog

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def hot(spark):
    acts = catalog(spark, SF_SMALL).user_activities
    return acts.withColumn(
        "user_id", F.when(F.col("activity_id") % 3 == 0, F.lit("user_hot")).otherwise(F.col("user_id")))


@pytest.fixture(scope="module")
def pdf(hot):
    return hot.toPandas()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_user_top_users_exact(hot, pdf):
    want = (pdf.groupby("user_id").size().reset_index(name="count")
            .sort_values(["count", "user_id"], ascending=[False, True]).head(10))
    got = [tuple(r) for r in A.top_users(hot).collect()]
    assert got == list(want.itertuples(index=False, name=None))
    assert got[0][0] == "user_hot"


def test_hot_user_new_location_exact(hot, pdf):
    p = pdf.sort_values(["timestamp", "activity_id"])
    firsts = p.drop_duplicates(["user_id", "ip_address"])
    user_first = p.drop_duplicates(["user_id"])["activity_id"]
    want = set(firsts[~firsts["activity_id"].isin(user_first)]["activity_id"])
    got = {r[0] for r in R.suspicious_new_location(hot).select("activity_id").collect()}
    assert got == want


def test_hot_user_export_bursts_exact(hot, pdf):
    e = pdf[pdf["action"] == "export_data"].copy()
    e["date"] = e["timestamp"].dt.date
    counts = e.groupby(["user_id", "date"]).size()
    want = {(u, d, int(n)) for (u, d), n in counts.items() if n >= 2}
    got = {tuple(r) for r in R.suspicious_export_volume(hot, 2).collect()}
    assert got == want


def test_aggregates_combine_before_the_shuffle(hot):
    for df in (A.top_users(hot), R.suspicious_new_location(hot), R.suspicious_export_volume(hot, 2),
               A.activity_summary(hot)):
        p = _plan(df)
        first_exchange = p.find("Exchange")
        assert first_exchange > 0
        # the partial (map-side) aggregate sits below the first exchange
        assert p.find("partial_", first_exchange) > first_exchange, p

"""Turning optional UI-style parameters into one pushed-down predicate.

Conventions (kept from the dashboard): an empty multi-select means "no
filter"; ``'all'`` means "no filter"; a date range filters only when both
ends are given and is inclusive at both ends; range codes ``'24h'`` and
``'3d'`` mean one and three days, anything else one week, with an inclusive
lower bound and no upper bound. ``None`` for a single-value filter is treated
as ``'all'`` (the dashboard would match nothing).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from .exprs import col

ALL = "all"


def conjunction(conds: Iterable[Column | None]) -> Column | None:
    out = None
    for c in conds:
        if c is not None:
            out = c if out is None else out & c
    return out


def where_all(df: DataFrame, *conds: Column | None) -> DataFrame:
    """Apply the AND of the given predicates (skipping ``None``) in one filter."""
    cond = conjunction(conds)
    return df if cond is None else df.where(cond)


def one_of(c: str | Column, values: Iterable | None) -> Column | None:
    """``c IN values``, or no filter for an empty/None selection."""
    vals = list(values) if values else []
    return col(c).isin(vals) if vals else None


def equal_unless_all(c: str | Column, value) -> Column | None:
    if value is None or value == ALL:
        return None
    return col(c) == F.lit(value)


def _as_date(d) -> dt.date:
    if isinstance(d, dt.datetime):
        return d.date()
    if isinstance(d, dt.date):
        return d
    return dt.datetime.strptime(str(d)[:10], "%Y-%m-%d").date()


def date_between(ts: str | Column, start, end) -> Column | None:
    """Inclusive calendar-date range on a timestamp, only when both ends exist.

    Written as a half-open timestamp range so the bounds reach the Parquet
    scan (and date partitions) as plain comparisons.
    """
    if not start or not end:
        return None
    lo = dt.datetime.combine(_as_date(start), dt.time())
    hi = dt.datetime.combine(_as_date(end) + dt.timedelta(days=1), dt.time())
    t = col(ts)
    return (t >= F.lit(lo).cast(T.TimestampNTZType())) & (t < F.lit(hi).cast(T.TimestampNTZType()))


def range_interval(range_code: str | None) -> str:
    return S.RANGE_CODES.get(range_code, S.RANGE_DEFAULT)


def range_start(as_of: Column | dt.datetime, range_code: str | None) -> Column:
    """Lower bound ``as_of - interval`` of a range code."""
    anchor = as_of if isinstance(as_of, Column) else F.lit(as_of).cast(T.TimestampNTZType())
    return anchor - F.expr(f"INTERVAL {range_interval(range_code)}")


def latest(df: DataFrame, c: str = "timestamp") -> Column:
    """Scalar subquery ``(SELECT max(c) FROM df)`` as a column."""
    return df.select(F.max(c)).scalar()


def since(ts: str | Column, df: DataFrame, range_code: str | None, as_of=None) -> Column:
    """``ts >= as_of - range``; ``as_of`` defaults to the table's latest timestamp."""
    anchor = latest(df) if as_of is None else as_of
    return col(ts) >= range_start(anchor, range_code)

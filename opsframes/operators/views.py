"""Table views: per-column filters, sorting, paging, and row highlight flags.

``table_page`` pages with offset/limit (a per-task top-(offset+size) plus
one merge), fine for the first pages. For deep pages on large tables use
``page_after``: key-set paging on the sort columns plus a unique key turns
every page into a pushed-down range filter and a small top-k.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.params import conjunction, where_all

_OPS = {
    "=": lambda c, v: c == F.lit(v),
    "!=": lambda c, v: c != F.lit(v),
    "<": lambda c, v: c < F.lit(v),
    "<=": lambda c, v: c <= F.lit(v),
    ">": lambda c, v: c > F.lit(v),
    ">=": lambda c, v: c >= F.lit(v),
    "contains": lambda c, v: c.cast("string").contains(F.lit(v)),
    "datestartswith": lambda c, v: c.cast("string").startswith(F.lit(v)),
    "in": lambda c, v: c.isin(list(v)),
}

Sort = Sequence[tuple[str, str]]


def column_filter(name: str, spec) -> Column:
    """``"text"`` (contains, as typed into a table's filter row), ``[values]`` (membership),
    ``(op, value)`` with ``op`` of :data:`_OPS`, or any other bare value (equality).

    ``datestartswith`` takes the leading part of an ISO date or time, e.g. ``2024-01-1``."""
    c = F.col(name)
    if isinstance(spec, tuple) and len(spec) == 2 and spec[0] in _OPS:
        return _OPS[spec[0]](c, spec[1])
    if isinstance(spec, (list, set, frozenset)):
        return c.isin(list(spec))
    if isinstance(spec, str):
        return _OPS["contains"](c, spec)
    return c == F.lit(spec)


def table_view(df: DataFrame, name: str) -> DataFrame:
    """The columns that the dashboard's table ``name`` shows, so a scan reads only those."""
    return df.select(*S.VIEW_COLUMNS[name])


def _order(sort: Sort, key: str | None) -> list[Column]:
    cols = [F.desc(c) if d.lower().startswith("desc") else F.asc(c) for c, d in sort]
    if key and key not in [c for c, _ in sort]:
        cols.append(F.asc(key))
    return cols


def table_page(df: DataFrame, filters: Mapping | None = None, sort: Sort = (), page: int = 0, size: int = 10,
               key: str | None = None) -> DataFrame:
    """Page ``page`` (0-based) of ``size`` rows after filtering and sorting.

    ``key`` (a unique column) is appended to the sort so pages are disjoint
    and cover the table; with neither sort nor key the row order is unspecified.
    """
    filtered = where_all(df, *[column_filter(n, s) for n, s in (filters or {}).items()])
    order = _order(sort, key)
    ordered = filtered.orderBy(*order) if order else filtered
    return ordered.offset(page * size).limit(size)


def _after(sort: Sort, last: Sequence) -> Column:
    """Rows strictly after ``last`` in the lexicographic order ``sort``."""
    ors = []
    for i, (c, d) in enumerate(sort):
        desc = d.lower().startswith("desc")
        beyond = F.col(c) < F.lit(last[i]) if desc else F.col(c) > F.lit(last[i])
        ties = [F.col(p) == F.lit(last[j]) for j, (p, _) in enumerate(sort[:i])]
        ors.append(conjunction(ties + [beyond]))
    out = ors[0]
    for o in ors[1:]:
        out = out | o
    return out


def page_after(df: DataFrame, sort: Sort, after: Sequence | None = None, size: int = 10,
               filters: Mapping | None = None) -> DataFrame:
    """Key-set page: the ``size`` rows following the row whose sort values are ``after``.

    ``sort`` must end with a unique column. Null sort values are not supported.
    """
    filtered = where_all(df, *[column_filter(n, s) for n, s in (filters or {}).items()])
    if after is not None:
        filtered = filtered.where(_after(sort, after))
    return filtered.orderBy(*_order(sort, None)).limit(size)


# Highlight rules of the dashboard tables, in rule order: (flag, column, op, value).
LOG_ROW_RULES = [
    ("error", "severity", "=", "ERROR"),
    ("critical", "severity", "=", "CRITICAL"),
    ("warning", "severity", "=", "WARNING"),
]
SUSPICIOUS_ROW_RULES = [
    ("failed_logins", "reason", "contains", "Multiple failed"),
    ("unusual", "reason", "contains", "Unusual"),
]
ALERT_ROW_RULES = [
    ("critical", "priority", "=", "critical"),
    ("high", "priority", "=", "high"),
    ("medium", "priority", "=", "medium"),
    ("active", "status", "=", "active"),
]


def row_flags(df: DataFrame, rules: Sequence[tuple], name: str = "flags") -> DataFrame:
    """Append the array of flags whose rule matches the row, in rule order.

    A rule is ``(flag, column, op, value)`` or ``(flag, Column)``.
    """
    conds = [(r[0], r[1]) if len(r) == 2 else (r[0], column_filter(r[1], (r[2], r[3]))) for r in rules]
    hits = F.array(*[F.when(cond, F.lit(flag)) for flag, cond in conds])
    return df.withColumn(name, F.array_compact(hits))

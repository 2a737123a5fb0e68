"""Column expressions shared by the queries (all JVM-side ``pyspark.sql.functions``)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pick(values: Sequence[str], index: Column) -> Column:
    """``values[index]`` for a 0-based integer column (null when out of range)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def lookup(mapping: Mapping, key: str | Column) -> Column:
    """Constant dictionary lookup; unmatched keys give null (like ``Series.map``)."""
    k = col(key)
    out = None
    for src, dst in mapping.items():
        out = F.when(k == F.lit(src), F.lit(dst)) if out is None else out.when(k == F.lit(src), F.lit(dst))
    return out


def fill_template(template: str, **values: str | Column) -> Column:
    """Substitute ``{name}`` placeholders of a fixed template with columns."""
    parts: list[Column] = []
    pos = 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(col(values[m.group(1)]))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def by_key(key: str | Column, templates: Mapping[str, str], **values: str | Column) -> Column:
    """Pick a template by the value of ``key`` and fill it."""
    k = col(key)
    out = None
    for name, tpl in templates.items():
        filled = fill_template(tpl, **values)
        out = F.when(k == F.lit(name), filled) if out is None else out.when(k == F.lit(name), filled)
    return out


def event_date(ts: str | Column = "timestamp") -> Column:
    """Calendar date of a ``timestamp_ntz`` (time-zone independent)."""
    return F.to_date(col(ts))


def hour_start(ts: str | Column = "timestamp") -> Column:
    """Start of the hour of a ``timestamp_ntz``, kept as ``timestamp_ntz``; no session zone takes part."""
    ts = col(ts)
    return F.to_date(ts).cast(T.TimestampNTZType()) + F.make_dt_interval(F.lit(0), F.hour(ts))


def priority_of(severity: str | Column = "severity") -> Column:
    return lookup(S.PRIORITY_OF_SEVERITY, severity)


def priority_rank(priority: str | Column = "priority") -> Column:
    return lookup(S.PRIORITY_ORDER, priority).cast("int")


def cpu_band(cpu: str | Column = "cpu_usage") -> Column:
    """Half-open gauge bands: [0,60) normal, [60,80) elevated, [80,..] high."""
    c = col(cpu)
    out = None
    for upper, label in S.CPU_BANDS:
        out = F.when(c < upper, F.lit(label)) if out is None else out.when(c < upper, F.lit(label))
    return out.otherwise(F.lit(S.CPU_BAND_TOP))


def distinct_count(c: str | Column) -> Column:
    """Distinct values counting null as one value (pandas ``len(unique())``)."""
    c = col(c)
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))


def with_share(counts: DataFrame, count_col: str = "count", name: str = "share") -> DataFrame:
    """Append ``count / total``; runs on an already aggregated (small) frame."""
    total = F.sum(count_col).over(Window.partitionBy())
    return counts.withColumn(name, F.col(count_col).cast("double") / total.cast("double"))


def group_count(df: DataFrame, *keys: str | tuple[str, Column], name: str = "count") -> DataFrame:
    """Rows per group, leaving out rows with a null key (pandas ``groupby`` semantics).

    A key is a column name or a ``(name, expression)`` pair.
    """
    exprs = [(k, F.col(k)) if isinstance(k, str) else k for k in keys]
    not_null = None
    for _, e in exprs:
        not_null = e.isNotNull() if not_null is None else not_null & e.isNotNull()
    return (df.where(not_null)
            .groupBy(*[e.alias(n) for n, e in exprs])
            .agg(F.count(F.lit(1)).alias(name)))


def value_counts(df: DataFrame, key: str, name: str = "count") -> DataFrame:
    """Rows per non-null ``key`` value, largest first (ties by key)."""
    return group_count(df, key, name=name).orderBy(F.desc(name), F.asc(key))


def value_shares(df: DataFrame, key: str) -> DataFrame:
    """``value_counts`` with shares; the sort comes last, so it orders the result."""
    return with_share(group_count(df, key)).orderBy(F.desc("count"), F.asc(key))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; used to compare averages across engines."""
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def event_time(ts: str | Column = "timestamp") -> Column:
    """A ``timestamp_ntz`` wall-clock value as an event-time instant (wall clock read as UTC).

    Watermarks need ``timestamp``; going through epoch microseconds keeps
    window boundaries on wall-clock days/hours whatever the session zone.
    """
    micros = F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), col(ts))
    return F.timestamp_micros(micros)


def wall_clock(instant: str | Column) -> Column:
    """Inverse of :func:`event_time`: back to ``timestamp_ntz``."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(col(instant)), F.expr(_EPOCH_NTZ))


# Keeps times from year 1 on positive, and room for any 64-bit id below each microsecond.
_YEAR_ONE = 62_135_596_800_000_000
_ID_ROOM = "20000000000000000000"
_LEAST_ID = "9223372036854775808"


def _whole(digits: str) -> Column:
    return F.lit(digits).cast("decimal(20,0)")


def time_and_id(ts: str | Column, ident: str | Column) -> Column:
    """A time and a 64-bit id as one number that sorts by both: a fixed-width value, so its min and max hash-aggregate."""
    micros = F.unix_micros(event_time(ts)).cast("decimal(20,0)") + _whole(str(_YEAR_ONE))
    low = col(ident).cast("decimal(20,0)") + _whole(_LEAST_ID)
    return (micros.cast("decimal(18,0)") * _whole(_ID_ROOM) + low).cast("decimal(38,0)")


def time_of(packed: str | Column) -> Column:
    """The time of a :func:`time_and_id` number."""
    return wall_clock(F.timestamp_micros(F.call_function("div", col(packed), _whole(_ID_ROOM)) - F.lit(_YEAR_ONE)))


def id_of(packed: str | Column) -> Column:
    """The id of a :func:`time_and_id` number."""
    low = col(packed) % _whole(_ID_ROOM)
    return (low.cast("decimal(21,0)") - _whole(_LEAST_ID)).cast("long")

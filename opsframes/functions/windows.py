"""Sequential (lag-style) logic over per-key ordered series, with bounded tasks.

A plain ``Window.partitionBy(key).orderBy(ts)`` puts a key's whole history
into one task; with a handful of servers or a hot key that caps parallelism
and memory. Here the series is cut into fixed-size blocks of consecutive
positions, and each block also receives the last ``length - 1`` rows of the
block before it (a halo), so a window partitioned by (key, block) sees every
row it needs and never more than ``block + length - 1`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import event_time, wall_clock

BLOCK_ROWS = 1 << 16


def positions(df: DataFrame, key: str, order: str, tiebreak: Sequence[str] = (), name: str = "_pos",
              bucket: str = "day") -> DataFrame:
    """0-based position of each row within its key, in (order, *tiebreak) order.

    Positions are computed per (key, time bucket): the bucket sizes (a small
    table of keys x buckets) give each bucket's starting offset through a
    running sum, and a row_number inside the bucket adds the rest. Only the
    row_number sees whole buckets, so ``bucket`` ('day', 'hour', 'minute')
    bounds the largest task: use a finer unit for dense raw series.
    """
    dated = df.withColumn("_bucket", F.date_trunc(bucket, F.col(order)))
    starts = (dated.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_start", F.coalesce(
                  F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket")
                                   .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .drop("_n"))
    within = Window.partitionBy(key, "_bucket").orderBy(order, *tiebreak)
    return (dated.join(starts, [key, "_bucket"])
            .withColumn(name, F.col("_start") + F.row_number().over(within) - 1)
            .drop("_bucket", "_start"))


def with_lags(df: DataFrame, key: str, order: str, value: str, lags: int, tiebreak: Sequence[str] = (),
              block: int = BLOCK_ROWS, bucket: str = "day") -> DataFrame:
    """Append ``{value}_lag1 .. {value}_lag{lags}``: the value 1..lags rows earlier in the key's series."""
    pos = positions(df, key, order, tiebreak, bucket=bucket)
    block = max(block, lags, 1)  # a row's lags reach back one block at most
    blk = F.floor(F.col("_pos") / block)
    in_halo = (F.col("_pos") % block) >= (block - lags) if lags > 0 else F.lit(False)
    copies = pos.select("*", F.posexplode(F.when(in_halo, F.array(blk, blk + 1)).otherwise(F.array(blk)))
                        .alias("_copy", "_blk"))
    w = Window.partitionBy(key, "_blk").orderBy("_pos")
    lagged = copies.select("*", *[F.lag(value, i).over(w).alias(f"{value}_lag{i}") for i in range(1, lags + 1)])
    return lagged.where(F.col("_copy") == 0).drop("_copy", "_blk", "_pos")


def strictly_rising(value: str, length: int) -> Column:
    """``value`` > lag1 > lag2 > ... over ``length`` samples (false without enough history)."""
    chain = [F.col(value)] + [F.col(f"{value}_lag{i}") for i in range(1, length)]
    cond = F.lit(True)
    for newer, older in zip(chain, chain[1:]):
        cond = cond & F.coalesce(newer > older, F.lit(False))
    return cond


def rising_run(df: DataFrame, key: str, order: str, value: str, length: int,
               block: int = BLOCK_ROWS, bucket: str = "day") -> DataFrame:
    """``df`` plus boolean ``rising``: the row ends ``length`` strictly rising samples of its key."""
    lags = max(length - 1, 0)
    lagged = with_lags(df, key, order, value, lags, tiebreak=(value,), block=block, bucket=bucket)
    return lagged.withColumn("rising", strictly_rising(value, length)) \
        .drop(*[f"{value}_lag{i}" for i in range(1, lags + 1)])


def _slice(ts: str, seconds: int) -> Column:
    """Number of the time slice of so many seconds that a ``timestamp_ntz`` lies in."""
    return F.floor(F.unix_micros(event_time(ts)) / F.lit(seconds * 1_000_000))


def run_lengths(df: DataFrame, key: str, order: str, value: str, slice_seconds: int = 3600, name: str = "run") -> DataFrame:
    """``df`` plus the length of the run of strictly rising values that ends in each row of its key's series.

    Runs are associative: a slice of the series is summed up by its first and
    last value, its number of rows, and the length of the run at its end; a run
    goes on into the next slice if that begins higher. So rows are only put in
    order within (key, time slice), the summaries (one row a key and slice) are
    merged per key, and what a slice takes over from those before it is added to
    the rows that rise since its start. No task holds more of a key's rows than a
    slice. Rows of one time are taken in order of their value (nulls first); a
    null value breaks a run. Rows without key or time are left out.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(order).isNotNull()).withColumn("_slice", _slice(order, slice_seconds))
    within = Window.partitionBy(key, "_slice").orderBy(order, value)
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"_n": F.row_number().over(within), "_rises": F.coalesce(F.col(value) > F.lag(value).over(within), F.lit(False)),
                             "_last": F.lead(F.lit(True)).over(within).isNull()})
    rows = rows.withColumn("_local", F.col("_n") - F.max(F.when(~F.col("_rises"), F.col("_n"))).over(so_far) + 1).drop("_rises")

    at_end = F.col("_last")
    summary = rows.groupBy(key, "_slice").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("_n") == 1, F.col(value))).alias("first"),
        F.max(F.when(at_end, F.col(value))).alias("last"), F.max(F.when(at_end, F.col("_local"))).alias("suffix"))
    slices = Window.partitionBy(key).orderBy("_slice")
    chain = Window.partitionBy(key, "_chain").orderBy("_slice")
    goes_on = F.coalesce(F.col("first") > F.lag("last").over(slices), F.lit(False))
    summary = summary.withColumn("goes_on", goes_on)
    # slices that rise throughout and go on from the one before belong to one chain; its runs add up
    summary = summary.withColumn("_chain", F.sum(F.when(F.col("goes_on") & (F.col("suffix") == F.col("n")), 0).otherwise(1)).over(slices))
    summary = summary.withColumn("_run", F.sum("suffix").over(chain))
    before = (summary.withColumn("_before", F.when(F.col("goes_on"), F.lag("_run").over(slices)))
              .where("_before is not null").select(key, "_slice", "_before"))
    joined = rows.join(before, [key, "_slice"], "left")
    more = F.when(F.col("_local") == F.col("_n"), F.coalesce("_before", F.lit(0))).otherwise(0)
    return joined.withColumn(name, (F.col("_local") + more).cast("long")).select(*df.columns, name)


def bursts(df: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """(key, first, last, count) of each burst: rows of a key of which each comes less than the gap after the one before.

    Rows in one time bucket as wide as the gap are in one burst whatever their
    number, so they are first summed up per (key, bucket) with a map-side
    combine; bursts are then chains of buckets. A key with millions of rows
    costs a row a bucket and task. Rows without key or time are left out.
    """
    buckets = (df.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
               .select(key, F.unix_micros(event_time(ts)).alias("at")).withColumn("_bucket", F.floor(F.col("at") / F.lit(gap_seconds * 1_000_000)))
               .groupBy(key, "_bucket").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("count")))
    order = Window.partitionBy(key).orderBy("_bucket")
    starts = F.coalesce(F.col("first") - F.lag("last").over(order) >= F.lit(gap_seconds * 1_000_000), F.lit(True))
    chained = buckets.withColumn("_starts", starts).withColumn("_burst", F.sum(F.col("_starts").cast("int")).over(order))
    return (chained.groupBy(key, "_burst").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("count").alias("count"))
            .select(key, *[wall_clock(F.timestamp_micros(c)).alias(c) for c in ("first", "last")], "count"))

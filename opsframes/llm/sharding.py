"""Sharding by a minimax contiguous partition of atomic groups.

Rows with equal texts are one atomic group, which never splits. Groups are
ordered by a 64-bit hash of the text; shards are contiguous runs of that
order. The capacity is the smallest for which a greedy walk needs no more
than the given number of shards; the cuts then lie where shards come closest
to their fair share within that capacity.

The binary search needs group sizes in order, of which there can be
billions. It runs on a summary. Groups of more than 1/64 of a fair share (at
most 64 a shard) come first, one by one, largest first. The others follow in
hash order, summed up in blocks by leading hash bits. The least capacity lies
between that of blocks split anywhere and that of whole blocks; only the
blocks in which a cut can fall between these are opened to further bits,
level by level, down to single groups if need be. Each level is one
aggregate over those blocks, and the driver sees some thousand sums.
All of it is DataFrame functions.

Edge cases: a null text counts as empty (size 8, checksum 0) and shares the
empty texts' group. Texts whose hashes collide are one group, which only
keeps them together. Shards stay empty if there are fewer groups. Rows with
null or equal ids are numbered like any other.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsframes.llm._common import keep, only

SHARDS = 24
ROW_BYTES = 8
FIRST_BITS, STEP_BITS = 12, 6
PARTS_OF_SHARE = 64
ROWS_PER_BUCKET = 50_000


def walk(ends: list[int], whole: list[bool], capacity: int, shards: int, loss: int = 0) -> list[int] | None:
    """Places (bytes before each cut) of a greedy walk that fills each shard up to
    ``capacity``. Blocks that aren't ``whole`` may be cut anywhere, ``loss`` before
    the limit. None if ``shards`` runs don't reach the end, or a block exceeds the capacity."""
    at, out = 0, []
    for _ in range(shards):
        limit = at + capacity
        if not ends or limit >= ends[-1]:
            return out
        i = bisect_right(ends, limit)
        before = ends[i - 1] if i else 0
        step = before if whole[i] else max(before, limit - loss)
        if step <= at:
            return None
        out.append(step)
        at = step
    return None


def least_capacity(ends: list[int], whole: list[bool], shards: int, low: int) -> int:
    """The smallest capacity, ``low`` or more, with which a walk succeeds."""
    high = ends[-1] if ends else 0
    while low < high:
        mid = (low + high) // 2
        if walk(ends, whole, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def touched(sizes: list[int], whole: list[bool], shards: int, low: int, largest: int) -> list[int]:
    """Blocks to open: those, not whole, in which a cut can fall for some capacity that
    may still be the least. ``largest``: no group within an open block is larger."""
    ends, n = list(accumulate(sizes)), len(sizes)
    high = least_capacity(ends, [True] * n, shards, low)
    low = least_capacity(ends, whole, shards, low)
    if low == high:
        return []
    early, late = [], walk(ends, whole, high, shards) or []
    late += [ends[-1]] * (shards - 1 - len(late))
    at = 0
    for _ in late:  # as `walk`, but losing up to `largest` at each cut
        i = min(bisect_right(ends, at + low), n - 1)
        before = ends[i - 1] if i else 0
        at = max(before if whole[i] else max(before, at + low - largest), at)
        early.append(at)
    out: set[int] = set()
    for a, b in zip(early, late):
        out.update(i for i in range(max(0, bisect_left(ends, a)), min(n, bisect_right(ends, b) + 1)) if not whole[i])
    return sorted(out)


def cut(sizes: list[int], shards: int, low: int) -> list[int]:
    """Numbers of blocks before each cut: within the least capacity, each shard
    ends as near as can be to a fair share of what is left."""
    n = len(sizes)
    ends, whole = list(accumulate(sizes)), [True] * n
    back_ends = list(accumulate(reversed(sizes)))
    capacity = least_capacity(ends, whole, shards, low)
    total = ends[-1] if ends else 0
    # bytes that must lie before each cut, so that the shards after it hold the rest
    back = walk(back_ends, whole, capacity, shards) or []
    needed = [0] * (shards - 1 - len(back)) + [total - b for b in reversed(back)]
    cuts, before, done = [], 0, 0
    for k in range(shards - 1):
        fair = done + (total - done) / (shards - k)
        most = bisect_right(ends, done + capacity)
        least = max(before, bisect_left(ends, needed[k]) + 1 if needed[k] else 0)
        i = bisect_right(ends, fair)
        near = min((x for x in (i, i + 1) if x <= n), key=lambda x: abs((ends[x - 1] if x else 0) - fair))
        before = max(before, min(max(near, least), most))
        done = ends[before - 1] if before else 0
        cuts.append(before)
    return cuts


def blocks(groups: DataFrame, shards: int) -> tuple[list[tuple[int, int, int]], list[int], int]:
    """(blocks in order as (first hash, last hash, bytes), the large groups' hashes, the least possible capacity)."""
    seen = groups.agg(F.sum("bytes").alias("total"), F.max("bytes").alias("most")).first()
    if seen["total"] is None:
        return [], [], 0
    total, most = int(seen["total"]), int(seen["most"])
    low = max(-(-total // shards), most)
    share = total / (shards * PARTS_OF_SHARE)
    large = sorted(((r["h"], r["h"], int(r["bytes"])) for r in groups.where(F.col("bytes") > share).collect()), key=lambda b: (-b[2], b[0]))
    small = groups.where(F.col("bytes") <= share)
    largest = int(small.agg(F.max("bytes")).first()[0] or 0)

    def opened(rows: DataFrame, shift: int) -> list[tuple[int, int, int]]:
        found = (rows.groupBy(F.shiftright("h", shift).alias("block"))
                 .agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.sum("bytes").alias("bytes")).collect())
        return [(r["lo"], r["hi"], int(r["bytes"])) for r in found]

    shift = 64 - FIRST_BITS
    rest = sorted(opened(small, shift))
    while True:
        both = large + rest
        sizes, whole = [b[2] for b in both], [b[0] == b[1] for b in both]
        go = touched(sizes, whole, shards, low, largest)
        if not go or not shift:
            return both, [b[0] for b in large], low
        shift = max(0, shift - STEP_BITS)
        ranges = [both[i][:2] for i in go]
        near = F.lit(False)
        for lo, hi in _runs(ranges, rest):
            near = near | F.col("h").between(lo, hi)
        gone = set(ranges)
        rest = sorted([b for b in rest if b[:2] not in gone] + opened(small.where(near), shift))


def _runs(ranges: list[tuple[int, int]], rest: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Ranges of neighbouring blocks as one range each."""
    place = {b[:2]: i for i, b in enumerate(rest)}
    out: list[list[int]] = []
    last = None
    for r in sorted(ranges):
        if last is not None and place[r] == last + 1:
            out[-1][1] = r[1]
        else:
            out.append(list(r))
        last = place[r]
    return [tuple(r) for r in out]


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, size, text_crc32, shard, slot (gapless from 0 within the shard)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = keep(only(docs, id=id_col, text=text_col).select(
        "id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("at")), "sharding")
    groups = keep(rows.groupBy("h").agg(F.sum("size").alias("bytes")), "sharding-groups")
    order, large, low = blocks(groups, shards)
    cuts = cut([b[2] for b in order], shards, low)
    n = len(large)
    owner = [bisect_right(cuts, i) for i in range(n)]
    # the first hash of each later shard among the small groups; cuts within the large ones lie before all of them
    small_shard = F.lit(sum(c <= n for c in cuts))
    for c in cuts:
        if n < c < len(order):
            small_shard = small_shard + (F.col("h") >= F.lit(order[c][0])).cast("int")
    if large:  # at most PARTS_OF_SHARE per shard
        of = spark.createDataFrame(list(zip(large, owner)), "h long, own int")
        rows = rows.join(F.broadcast(of), "h", "left").withColumn("shard", F.coalesce("own", small_shard)).drop("own")
    else:
        rows = rows.withColumn("shard", small_shard)
    count = rows.count()
    buckets = max(1, -(-count // ROWS_PER_BUCKET))
    # by the row's own number, so that repeated rows are spread
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("at"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = (dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
             .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    inside = Window.partitionBy("shard", "bucket").orderBy("h", "id", "at")
    return (dealt.withColumn("n", F.row_number().over(inside) - 1).join(shift, ["shard", "bucket"])
            .select(F.col("id").alias(id_col), "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
                    (F.col("n") + F.col("before")).alias("slot")))

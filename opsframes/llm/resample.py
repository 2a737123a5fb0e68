"""Importance resampling of documents towards a target text.

The bytes of a text go through one 256-byte table that lower-cases A-Z and
blanks separators; ``bytes.split`` then yields the words. Features are the runs
of one and two consecutive words; the bucket of a run is the CRC-32 of its
bytes, taken on from the CRC of what stands before (``zlib.crc32`` with a
seed). Counters gather bucket counts task by task and Spark sums them, so no
more than ``BUCKETS`` rows a task are shuffled. A bucket's gain is the
thousandfold logarithm of its smoothed frequency in the target over that in the
corpus; a document's weight is the floored mean of its features' gains.

The draw is Gumbel top-k: weight plus noise from a hash of the id, the highest
scores win. Scores are whole numbers from a bounded range, so the cut is read
off a histogram; only rows at or above it are sorted, in ranges over all
partitions, and numbered by the counts of the partitions before. No task sees
all rows or all rows of one score.

Edge cases: a null or empty text has no words: no features, weight 0. A null id
takes its noise from the empty string and comes after others in ties. Repeated
rows are rows of their own, and take ranks next to each other. Without
documents there are no rows; with an empty target every gain falls on
smoothing alone.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframes.llm._common import in_slices, keep, only, utf8

BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
PERCENT = 25
ROWS_PER_PART = 200_000
#: Words of which the CRC is remembered; the memory is emptied when their bytes reach this.
MEMO_BYTES = 32 << 20

_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))


class Seeds(dict):
    """word -> (CRC-32 of the word, CRC-32 of the word and a space)."""

    def __init__(self):
        self.bytes = 0

    def __missing__(self, word: bytes) -> tuple[int, int]:
        c = crc32(word)
        both = c, crc32(b" ", c)
        self.bytes += len(word) + 200
        if self.bytes > MEMO_BYTES:
            self.clear()
            self.bytes = 0
        self[word] = both
        return both


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def features(tokens: list[bytes], seeds: Seeds, buckets: int = BUCKETS) -> list[int]:
    """Buckets of all runs of one and two words."""
    known = [seeds[w] for w in tokens]
    return [c % buckets for c, _ in known] + [crc32(w, seed) % buckets for (_, seed), w in zip(known, tokens[1:])]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, text_col: str = "text") -> list[int]:
    """Features in each bucket over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, held = Seeds(), Counter()
        for batch in in_slices(batches, "text"):
            for text in utf8(batch.column("text")):
                if text:
                    held.update(features(words(text), seeds, buckets))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.int64())], names=["bucket", "n"])

    out = [0] * buckets
    summed = only(texts, text=text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in summed.collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """Floored thousandfold logarithm of each bucket's smoothed odds, target over source."""
    n, s_all, t_all = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source, target)]


def noise(seed: int, doc_id) -> int:
    """Gumbel noise in thousandths, from the first 8 hex digits of SHA-256."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS,
             seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Per row: id, n_features, weight, score, rank (null if not drawn).

    Of the rows with ``least_words`` words, ``percent`` percent (floored) are drawn.
    """
    rows = only(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    gain = gains(bucket_counts(docs, buckets, text_col), bucket_counts(target, buckets, target_text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds()
        for batch in in_slices(batches, "text"):
            n_words, n_features, weight = [], [], []
            for text in utf8(batch.column("text")):
                tokens = words(text or b"")
                found = features(tokens, seeds, buckets)
                n_words.append(len(tokens))
                n_features.append(len(found))
                weight.append(sum(map(gain.__getitem__, found)) // len(found) if found else 0)
            drawn = np.array([noise(seed, i) for i in batch.column("id").to_pylist()], dtype=np.int64)
            weights = np.array(weight, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()),
                                              pa.array(weights), pa.array(weights + drawn)],
                                             names=["id", "n_words", "n_features", "weight", "score"])

    scored = keep(rows.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long, score long"), "resample-scores")
    able = F.col("n_words") >= least_words
    # gains and noise are bounded (by the logarithm of the corpus size and by 32 bits), so are the distinct scores
    histogram = sorted(((r["score"], r["count"]) for r in scored.where(able).groupBy("score").count().collect()), reverse=True)
    wanted = percent * sum(n for _, n in histogram) // 100
    cut, held = None, 0
    for score, n in histogram:
        if held >= wanted:
            break
        cut, held = score, held + n
    names = ["id", "n_features", "weight", "score"]
    if cut is None:
        return scored.select(F.col("id").alias(id_col), *names[1:], F.lit(None).cast("long").alias("rank"))
    inside = able & (F.col("score") >= cut)
    by = [F.desc("score"), F.asc_nulls_last("id")]
    ordered = keep(scored.where(inside).select(*names).repartitionByRange(max(1, -(-held // ROWS_PER_PART)), *by).sortWithinPartitions(*by)
                   .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "resample-order")
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).orderBy("part").collect()  # one row a partition
    shift, before = [], 0
    for r in parts:
        shift.append((r["part"], before - r["first"] + 1))
        before += r["n"]
    shifts = ordered.sparkSession.createDataFrame(shift, "part int, shift long")
    rank = F.col("at") + F.col("shift")
    ranked = ordered.join(F.broadcast(shifts), "part").select(*names, F.when(rank <= wanted, rank).alias("rank"))
    rest = scored.where(~inside).select(*names, F.lit(None).cast("long").alias("rank"))
    return ranked.unionAll(rest).withColumnRenamed("id", id_col)

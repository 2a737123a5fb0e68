"""Substring dedup: Rabin-Karp hashes of every 50-word window, counted in Spark.

A window is ``width`` consecutive words of one document. A word goes if some
window that covers it also starts in a document with a smaller id. Windows
are judged on the input, not on what is left.

How the count stays small without losing a window:

1. Documents that are word-for-word copies are settled by a digest of their
   words: each but the one with the smallest id goes whole if it has a window
   at all. One document stands for each class in what follows.
2. Two equal windows contain the same ``width // 2``-word sub-window of least
   hash (their minimiser). So a window can repeat only if its minimiser does.
   Minimisers (about one word in thirteen) are counted over all documents.
3. Every window whose minimiser repeats is counted by a 128-bit Rabin-Karp
   hash: the least document id per hash decides.
4. Covered positions merge into maximal removal intervals per document.

Edge cases: a null or empty text has no words. A null id compares with
nothing: such a row keeps all words and takes none from others. Rows that
share an id never remove each other's words. Repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframes.llm._common import in_slices, keep, only, utf8

WIDTH = 50
#: Odd bases of the rolling hashes, modulo 2**64: of bytes in words, of words in windows.
BASES = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Rabin-Karp hashes modulo 2**64 of byte words and of word windows."""

    def __init__(self, of_bytes: int, of_words: int):
        rng = np.random.default_rng(of_bytes)
        self.letters = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.bases = of_bytes, of_words
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _table(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = self.tables.get(base)
        if have is None or len(have[0]) <= n:
            size = max(n, 1 << 16)
            have = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)
            if size <= 1 << 20:  # larger ones are for one text only
                self.tables[base] = have
        return have

    def _spans(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
        up, down = self._table(base, len(values))
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[:len(values)], dtype=np.uint64, out=sums[1:])
        h = (sums[end] - sums[begin]) * down[begin]
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(29))

    def words(self, text: bytes) -> np.ndarray:
        """A hash of each word (maximal run without white space)."""
        out, at, step = [], 0, 1 << 20
        while at < len(text):
            end = min(len(text), at + step)
            while end < len(text) and not _SPACE[text[end]]:
                end += 1
            raw = np.frombuffer(text, dtype=np.uint8, count=end - at, offset=at)
            edge = np.diff(np.concatenate(([True], _SPACE[raw], [True])).astype(np.int8))
            begin, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
            out.append(self._spans(self.letters[raw], begin, stop, self.bases[0]))
            at = end
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)

    def windows(self, words: np.ndarray, width: int) -> np.ndarray:
        """A hash of every ``width`` consecutive words."""
        n = len(words) - width + 1
        if n < 1:
            return np.zeros(0, dtype=np.uint64)
        begin = np.arange(n)
        return self._spans(words, begin, begin + width, self.bases[1])


def _minimisers(words: np.ndarray, width: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width // 2``-word sub-windows; for each window the place of its least."""
    part = max(1, width // 2)
    h = rolling.windows(words, part)
    if len(words) < width:
        return h, np.zeros(0, dtype=np.int64)
    return h, sliding_window_view(h, width - part + 1).argmin(axis=1) + np.arange(len(words) - width + 1)


def _profile(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    rolling = Rolling(*BASES[0])
    for batch in in_slices(batches, "text"):
        n_words, digest, anchors = [], [], []
        for text in utf8(batch.column("text")):
            words = (text or b"").split()
            n_words.append(len(words))
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            h, least = _minimisers(rolling.words(text), width, rolling) if len(words) >= width else (None, ())
            anchors.append(np.unique(h[np.unique(least)]).view(np.int64) if len(least) else np.zeros(0, np.int64))
        ends = np.cumsum([0, *map(len, anchors)]).astype(np.int32)
        flat = np.concatenate(anchors) if anchors else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(digest, pa.string()),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))],
            names=["id", "n_words", "sha", "anchors"])


def _counted(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Both hashes of each window whose minimiser repeats."""
    first, second = Rolling(*BASES[0]), Rolling(*BASES[1])
    for batch in in_slices(batches, "text", 4 << 20):
        for i, text in enumerate(utf8(batch.column("text"))):
            words = first.words(text)
            h, least = _minimisers(words, width, first)
            repeated = np.array(batch.column("anchors")[i].as_py(), dtype=np.int64).view(np.uint64)
            at = np.flatnonzero(np.isin(h[least], repeated))
            h1 = first.windows(words, width)[at].view(np.int64)
            h2 = second.windows(second.words(text), width)[at].view(np.int64)
            n = len(at)
            for k in range(0, n, 100_000):
                m = min(100_000, n - k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[k:k + m]), pa.array(h2[k:k + m]), pa.array([batch.column("id")[i].as_py()] * m, batch.column("id").type),
                     pa.array([batch.column("tag")[i].as_py()] * m, pa.int64()), pa.array(at[k:k + m].astype(np.int32))],
                    names=["h1", "h2", "id", "tag", "pos"])


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, "text", 4 << 20):
        kept_text, removed, spans = [], [], []
        for text, starts in zip(utf8(batch.column("text")), batch.column("starts").to_pylist()):
            words = text.split()
            merged: list[list[int]] = []
            for s in sorted(starts):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s + width)
                else:
                    merged.append([s, s + width])
            left, at = [], 0
            for s, e in merged:
                left += words[at:s]
                at = e
            left += words[at:]
            kept_text.append(b" ".join(left).decode())
            removed.append(len(words) - len(left))
            spans.append([{"start": s, "end": e} for s, e in merged])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("tag"), pa.array(kept_text, pa.string()), pa.array(removed, pa.int64()),
             pa.array([hashlib.sha256(t.encode()).hexdigest() for t in kept_text], pa.string()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
            names=["id", "tag", "kept_text", "n_removed", "kept_sha", "removed"])


def repeated_passages(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id",
                      text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(profile, cut)``.

    ``profile``: one row per input row: id, n_words, sha (SHA-256 of the words
    joined by one space), tag (tells rows of equal id but other words apart),
    copy (all its words go, as a copy has a smaller id).
    ``cut``: one row per (id, tag) that loses words otherwise: kept_text,
    n_removed, kept_sha, removed (array of maximal word intervals).
    """
    rows = only(docs, id=id_col, text=text_col)
    id_type = rows.schema["id"].dataType.simpleString()
    tag = F.xxhash64("sha")
    profile = keep(rows.mapInArrow(lambda it: _profile(it, width),
                                   f"id {id_type}, n_words long, sha string, anchors array<long>")
                   .withColumn("tag", tag), "substrings-profile")
    first = profile.groupBy("sha").agg(F.min("id").alias("first_id"))
    # one document per class of equal word sequences stands for it
    anchors = (profile.where("n_words >= {} and id is not null".format(width))
               .join(first.select("sha", F.col("first_id").alias("id")), ["sha", "id"], "left_semi")
               .dropDuplicates(["id", "sha"])
               .select("id", "tag", F.explode("anchors").alias("anchor")))
    shared = keep(anchors.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi"), "substrings-shared")
    suspects = (anchors.join(shared.select("anchor"), "anchor", "left_semi")
                .groupBy("id", "tag").agg(F.collect_set("anchor").alias("anchors")))
    suspects = keep(_with_text(rows, suspects), "substrings-suspects")
    windows = keep(suspects.mapInArrow(lambda it: _counted(it, width),
                                       f"h1 long, h2 long, id {id_type}, tag long, pos int"), "substrings-windows")
    # written, so that the join has an exchange of its own on either side, which splits hot passages
    least = keep(windows.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
                 .where("lo < hi").select("h1", "h2", "lo"), "substrings-least")
    hits = (windows.join(least, ["h1", "h2"]).where("id > lo")
            .groupBy("id", "tag").agg(F.collect_set("pos").alias("starts")))
    cut = suspects.select("id", "tag", "text").join(hits, ["id", "tag"]).mapInArrow(
        lambda it: _cut(it, width),
        f"id {id_type}, tag long, kept_text string, n_removed long, kept_sha string, "
        "removed array<struct<start:int,end:int>>").dropDuplicates(["id", "tag"])
    profile = (profile.drop("anchors").join(first.where("first_id is not null"), "sha", "left")
               .withColumn("copy", F.coalesce((F.col("n_words") >= width) & (F.col("id") > F.col("first_id")),
                                              F.lit(False))).drop("first_id"))
    return profile, cut


def _with_text(rows: DataFrame, suspects: DataFrame) -> DataFrame:
    """Suspects with their text, told from rows of equal id by the words' digest."""
    id_type = rows.schema["id"].dataType.simpleString()

    def tagged(batches):
        for batch in in_slices(batches, "text"):
            sha = [hashlib.sha256(b" ".join((t or b"").split())).hexdigest() for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), batch.column("anchors"),
                                              batch.column("tag"), pa.array(sha, pa.string())],
                                             names=["id", "text", "anchors", "tag", "sha"])

    return (rows.join(suspects, "id").select("id", "text", "anchors", "tag")
            .mapInArrow(tagged, f"id {id_type}, text string, anchors array<long>, tag long, sha string")
            .where(F.col("tag") == F.xxhash64("sha")).drop("sha"))


def removal_report(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, n_words, n_removed, kept_sha256, removed (word intervals)."""
    profile, cut = repeated_passages(docs, width, id_col, text_col)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    out = profile.join(cut.drop("kept_text"), ["id", "tag"], "left")
    return out.select(
        F.col("id").alias(id_col), "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        F.when(F.col("copy"), whole).otherwise(F.col("removed")).alias("removed"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages taken out of ``text_col``, other columns as they are.

    Texts that lose nothing stay byte for byte; from others the kept words
    remain, joined by one space. No row goes, not even one left empty.
    """
    profile, cut = repeated_passages(docs, width, id_col, text_col)
    change = (profile.where("copy").select("id", "tag", F.lit("").alias("kept_text")).dropDuplicates(["id", "tag"])
              .unionByName(cut.select("id", "tag", "kept_text")))
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{id_col}`").alias("id"),
                        words_tag(F.col(f"`{text_col}`")).alias("tag"))
    done = keyed.join(change, ["id", "tag"], "left")
    return done.select(*[F.coalesce("kept_text", F.col(f"row.`{c}`")).alias(c) if c == text_col
                         else F.col(f"row.`{c}`").alias(c) for c in names])


def words_tag(text):
    """The tag of a text: hash of the SHA-256 of its words joined by one space."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.xxhash64(F.sha2(F.trim(squeezed), 256))

"""SimHash near-dedup by multi-index hashing.

``fingerprints`` gives each text a 64-bit majority vote over the XXH64 hashes
of its word shingles. ``links`` finds all pairs of distinct fingerprints at
``max_bits`` or fewer differing bits: the 64 bits are cut into segments, each
fingerprint looks up the small Hamming balls around its own segment values in
the segments' tables, and full distances are verified. ``components`` joins
linked fingerprints into groups.

Which radius per segment suffices: distance d over m segments. If segments
1..j-1 each differ in more than r bits, they use up (j-1)(r+1) of d, so the
j-th needs at most (d - (j-1)(r+1)) / (m-j+1) rounded down. With d=4 and three
segments that is 1, 1, 0: 45 look-ups a fingerprint find every pair.

Edge cases: a text of fewer words than a shingle is one shingle; a null or
empty text has fingerprint zero and links like any other. A null id takes no
part in the choice of component id, but its row gets its group's. Repeated
rows and copies share one fingerprint; they are grouped before any look-up,
so copies never meet as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframes.llm._common import in_slices, keep, only, utf8

SHINGLE = 4
MAX_BITS = 4
SEED = 42


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one text."""
    norm = b" ".join((text or b"").lower().split())
    if not norm:
        return 0
    spaces = np.flatnonzero(np.frombuffer(norm, dtype=np.uint8) == 0x20)
    begin = np.concatenate(([0], spaces + 1))
    end = np.concatenate((spaces, [len(norm)]))
    n = max(1, len(begin) - shingle + 1)
    digest, view = xxhash.xxh64_intdigest, memoryview(norm)
    ends = end[-n:] if len(begin) >= shingle else end[-1:]
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        hashes = np.fromiter((digest(view[b:e], SEED) for b, e in zip(begin[at:at + (1 << 16)].tolist(), ends[at:at + (1 << 16)].tolist())),
                             dtype=np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, fp) per input row; tag: a hash of the text; fp as a signed long with the same 64 bits."""
    rows = only(docs, id=id_col, text=text_col).withColumn("tag", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in utf8(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), pa.array(fps.view(np.int64))], names=["id", "tag", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, tag long, fp long")


def radii(max_bits: int, segments: int) -> list[int]:
    """A look-up radius per segment with which no pair is missed; -1: none needed."""
    out: list[int] = []
    for j in range(segments):
        out.append((max_bits - sum(r + 1 for r in out)) // (segments - j))
    return out


def segment_count(distinct: int, max_bits: int) -> int:
    """Segments of about log2(distinct) bits keep a table's buckets near one entry.

    Every choice finds the same pairs; this one only balances look-ups
    against candidates per look-up."""
    bits = max(16, distinct.bit_length() + 3)
    return max(1, min(max_bits + 1, -(-64 // bits)))


def _key(segment: int, value: Column) -> Column:
    return F.struct(F.lit(segment).alias("s"), value.alias("v"))


def links(fps: DataFrame, max_bits: int = MAX_BITS, segments: int | None = None) -> DataFrame:
    """All pairs (a, b), a < b, of distinct fingerprints within ``max_bits``."""
    distinct = fps.select("fp").distinct()
    m = segments or segment_count(distinct.count(), max_bits)
    cuts = [64 * i // m for i in range(m + 1)]
    entries, probes = [], []
    for s, radius in enumerate(radii(max_bits, m)):
        low, width = cuts[s], cuts[s + 1] - cuts[s]
        if radius < 0:
            continue
        mask = ((1 << width) - 1) << low
        value = F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        ball = [sum(1 << (low + b) for b in flip) for r in range(radius + 1) for flip in combinations(range(width), r)]
        entries.append(_key(s, value))
        probes += [_key(s, value.bitwiseXOR(F.lit(x - (1 << 64) if x >> 63 else x))) for x in ball]
    table = distinct.select(F.col("fp").alias("a"), F.inline(F.array(*entries)))
    looked = distinct.select(F.col("fp").alias("b"), F.inline(F.array(*probes)))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return looked.join(table, ["s", "v"]).where(near).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of undirected ``edges`` (a, b): the least node reachable.

    Alternates two rewrites until nothing changes. Large star: each node's
    larger neighbours attach to the least node next to it. Small star: each
    node and its smaller neighbours attach to the least of them. Each is an
    aggregate to one row per node and a join; every round is written to the
    shared folder, and only counts reach the driver.
    """
    edges = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .where("u <> v").distinct(), "components")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        edges = keep(small, "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return (edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


def _grouped(docs: DataFrame, shingle: int, max_bits: int, id_col: str, text_col: str) -> DataFrame:
    """Per input row: id, tag, fp, root (a group's name), component_id, n_links."""
    fps = keep(fingerprints(docs, shingle, id_col, text_col), "simhash")
    pairs = keep(links(fps, max_bits), "simhash-links")
    degree = (pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links")))
    group = components(pairs).select(F.col("node").alias("fp"), "root")
    classes = (fps.groupBy("fp").agg(F.min("id").alias("first_id")).join(group, "fp", "left").join(degree, "fp", "left")
               .withColumn("root", F.coalesce("root", "fp")))
    first = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = classes.join(first, "root").select("fp", "root", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return fps.join(classes, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per input row: id, fingerprint (16 hex digits), component_id (least id reachable),
    n_links (linked fingerprints other than its own)."""
    return _grouped(docs, shingle, max_bits, id_col, text_col).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """One document of each group stays, the one with the least id; columns as they are.

    Null and empty texts have fingerprint zero and are one group. Of repeated
    rows one stays. Rows that share an id but not the text are documents of
    their own, each in its text's group; if a group holds several under its
    least id, the one whose text has the least hash stays. Rows without an id
    can't be told apart and stay. An empty table gives an empty one.
    """
    names = docs.columns
    stay = (_grouped(docs, shingle, max_bits, id_col, text_col).where(F.col("id") == F.col("component_id"))
            .groupBy("root", "id").agg(F.min("tag").alias("tag")).select("id", "tag").distinct())
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{id_col}`").alias("id"),
                        F.xxhash64(F.col(f"`{text_col}`")).alias("tag"))
    kept = keyed.where("id is not null").join(stay, ["id", "tag"], "left_semi").dropDuplicates(["id", "tag"])
    kept = kept.unionByName(keyed.where("id is null"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in names])

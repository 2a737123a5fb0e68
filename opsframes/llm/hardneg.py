"""Hard negatives by rotated one-bit codes and deterministic score intervals.

Components are scaled to integers (``floor(256 * x)``); a score is the integer
inner product. Every vector is rotated (sign flips and Hadamard transforms);
its code is the signs of the rotated vector, and beside the code stand the
alignment of the vector with its code vector and the length of the residual
that the code leaves. One code leaves about 0.6 of the length, too much to
rule anything out in 64 dimensions, so the residual is coded in the same way,
``LEVELS`` times in all. For an anchor, whose rotated components are cut to a few
bits, popcounts of its bit planes with a code give the inner product of anchor
and code vector up to a known error; by Cauchy and Schwarz the residual adds at
most (its length) x (the length of what of the anchor is orthogonal to the code
vector). So each score lies in an interval that always holds, and only rows
whose interval can still reach the answer go on to the next level, and after
the last are scored, in integers. The result is exact.

Spark deals rows and anchors into blocks; every block of anchors meets every
block of rows once for the positives and once for the negatives. A block hands
on at most the wanted number of rows for an anchor (and positive), and a window
over those takes the best. The anchors are a stated share of the table.

Edge cases: rows with a null id, label or vector, a null or non-finite
component, or one that is no longer finite when scaled take no part. Rows equal
in id, label and vector count once; rows that share an id but differ are rows
of their own, and none of them is an "other" row of that id. Vectors are
compared with those of their own length only. Ties go to the smaller id. A
score beyond the range of a long is held at its limit. Anchors without
positives, and positives without negatives in range, give no rows. An empty
vector scores 0 with every other.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframes.llm._common import keep, only

POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 30, 90
SCALE = 256.0
BITS = 8
#: One-bit codes a row: each codes what the ones before leave, about 0.6 of its length.
LEVELS = 5
BLOCK_BYTES = 24 << 20
ANCHOR_BLOCK = 2048
#: Above the rounding error of the rotation, as a share of the vectors' lengths.
SLACK = 1e-9
_LONG = np.iinfo(np.int64)


@lru_cache(8)
def _flips(width: int) -> np.ndarray:
    return np.random.default_rng(20).choice(np.array([-1.0, 1.0]), (3, width))


def rotate(vectors: np.ndarray) -> np.ndarray:
    """Rows turned by three rounds of sign flips and Hadamard transforms, zero-padded to a power of two of 64 or more."""
    n, dims = vectors.shape
    width = max(64, 1 << max(0, dims - 1).bit_length())
    out = np.zeros((n, width))
    out[:, :dims] = vectors
    for signs in _flips(width):
        out *= signs
        h = 1
        while h < width:
            pairs = out.reshape(n, width // (2 * h), 2, h)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
            h *= 2
        out /= np.sqrt(width)
    return out


def encode(vectors: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row and level: code (64-bit words), alignment with its code vector, length of the residual it leaves.

    The first level codes the vector, each further one the residual of the level before."""
    left = rotate(vectors)
    root = np.sqrt(left.shape[1])
    codes, along, rest = [], [], []
    for _ in range(levels):
        up = left >= 0
        codes.append(np.packbits(up, axis=1, bitorder="little").view(np.uint64))
        along.append(np.abs(left).sum(axis=1) / root)
        left = left - np.where(up, 1.0, -1.0) * (along[-1] / root)[:, None]
        rest.append(np.sqrt((left ** 2).sum(axis=1)))
    return np.stack(codes, axis=1), np.stack(along, axis=1), np.stack(rest, axis=1)


class Planes:
    """Anchors cut to bit planes, for popcounts against codes."""

    def __init__(self, anchors: np.ndarray, bits: int = BITS):
        turned = rotate(anchors)
        self.root = np.sqrt(turned.shape[1])
        self.norm2 = (turned ** 2).sum(axis=1)
        self.least = turned.min(axis=1)
        self.step = np.maximum(turned.max(axis=1) - self.least, 1e-300) / (2 ** bits - 1)
        levels = np.rint((turned - self.least[:, None]) / self.step[:, None])
        self.error = np.abs(turned - self.least[:, None] - levels * self.step[:, None]).sum(axis=1)
        self.sum = (self.least[:, None] + levels * self.step[:, None]).sum(axis=1)
        levels = levels.astype(np.int64)
        self.planes = [np.packbits(((levels >> b) & 1).astype(bool), axis=1, bitorder="little").view(np.uint64) for b in range(bits)]

    def code_dots(self, i: int, codes: np.ndarray) -> tuple[np.ndarray, float]:
        """Inner products of anchor ``i`` with the unit code vectors, by popcounts, and their largest error."""
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        level = np.zeros(len(codes), dtype=np.int64)
        for b, plane in enumerate(self.planes):
            level += np.bitwise_count(codes & plane[i]).sum(axis=1, dtype=np.int64) << b
        # a code vector is +-1/root: twice the sum over its positive places less the whole sum
        dots = (2.0 * (self.least[i] * ones + self.step[i] * level) - self.sum[i]) / self.root
        return dots, self.error[i] / self.root

    def intervals(self, i: int, codes: np.ndarray, along: np.ndarray, rest: np.ndarray, keep):
        """(places, least, largest score) of the vectors that survive every level.

        ``keep(places, low, high)`` says after each level which ones do."""
        at = np.arange(len(codes))
        middle, loose = np.zeros(len(at)), np.zeros(len(at))
        low = high = middle
        for level in range(codes.shape[1]):
            dots, error = self.code_dots(i, codes[at, level])
            middle, loose = middle + along[at, level] * dots, loose + along[at, level] * error
            # the residual is orthogonal to the level's code vector, so only that part of the anchor meets it
            across = np.sqrt(np.maximum(0.0, self.norm2[i] - np.maximum(0.0, np.abs(dots) - error) ** 2))
            half = loose + rest[at, level] * across + SLACK * (1.0 + np.sqrt(self.norm2[i]) * along[at].sum(axis=1))
            stay = keep(at, middle - half, middle + half)
            at, middle, loose, half = at[stay], middle[stay], loose[stay], half[stay]
            low, high = middle - half, middle + half
        return at, low, high


def integer_scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued doubles, held within the range of a long."""
    if not rows.size:
        return np.zeros(len(rows), dtype=np.int64)
    if np.abs(rows).max() * np.abs(anchor).max() * rows.shape[1] < 2 ** 53:  # exact in doubles
        return (rows @ anchor).astype(np.int64)
    a = [int(x) for x in anchor]
    full = [sum(int(x) * y for x, y in zip(row, a)) for row in rows]
    return np.array([min(max(s, _LONG.min), _LONG.max) for s in full], dtype=np.int64)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


class Block:
    """A block of rows: identical ones once, those of a label side by side."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.drop_duplicates(["id", "tag"]).sort_values(["label", "id"], kind="stable")
        n = len(rows)
        self.ids, self.labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        self.vectors = _matrix(rows["vec"])
        self.along, self.rest = _matrix(rows["along"]), _matrix(rows["rest"])
        self.codes = np.frombuffer(b"".join(rows["code"]), dtype=np.uint64).reshape(n, self.along.shape[1], -1)

    def of(self, label) -> slice:
        return slice(int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right")))

    def reaching(self, planes: Planes, i: int, at: np.ndarray, keep) -> np.ndarray:
        """The places among ``at`` that ``keep`` leaves after the last level."""
        return at[planes.intervals(i, self.codes[at], self.along[at], self.rest[at], keep)[0]]

    def best(self, at: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` highest scores, ties to the smaller id."""
        order = np.lexsort((self.ids[at], -scores))[:most]
        return at[order], scores[order]


def _kth_largest(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, -k)[-k]) if len(values) >= k else -np.inf


def nearest(most: int):
    """Whatever can be among the ``most`` highest: at least the ``most``-th highest lower bound."""
    return lambda at, low, high: high >= _kth_largest(low, most)


def nearest_in(windows: list[tuple[int, int]], most: int):
    """Whatever can be among the ``most`` highest of any window of scores."""
    def keep(at, low, high):
        can = np.zeros(len(low), dtype=bool)
        for least, largest in windows:
            sure = (low >= least) & (high <= largest)
            can |= (low <= largest) & (high >= max(least, _kth_largest(low[sure], most)))
        return can
    return keep


def _positives(most: int):
    def run(key, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            block, anchors = Block(rows), anchors.drop_duplicates(["id", "tag"])
            vectors = _matrix(anchors["vec"])
            planes = Planes(vectors)
            for i, (aid, tag, label) in enumerate(zip(anchors["id"], anchors["tag"], anchors["label"])):
                own = block.of(label)
                at = np.arange(own.start, own.stop)
                at = block.reaching(planes, i, at[block.ids[at] != aid], nearest(most))
                found, scores = block.best(at, integer_scores(block.vectors[at], vectors[i]), most)
                if len(found):
                    out.append(pd.DataFrame({"anchor_id": aid, "tag": tag, "positive_id": block.ids[found], "positive_score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "tag": [], "positive_id": [], "positive_score": []})
    return run


def _negatives(most: int, low_pct: int, high_pct: int):
    names = ["anchor_id", "tag", "place", "positive_id", "positive_score", "negative_id", "negative_score"]

    def run(key, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            block, anchors = Block(rows), anchors.drop_duplicates(["id", "tag"])
            vectors = _matrix(anchors["vec"])
            planes = Planes(vectors)
            for i, row in enumerate(anchors.itertuples()):
                # the whole scores s with low_pct * p <= 100 * s <= high_pct * p, for each positive
                windows = [(-((-low_pct * int(p["score"])) // 100), (high_pct * int(p["score"])) // 100) for p in row.positives]
                own = block.of(row.label)
                at = np.concatenate([np.arange(own.start), np.arange(own.stop, len(block.ids))])
                at = block.reaching(planes, i, at[block.ids[at] != row.id], nearest_in([w for w in windows if w[0] <= w[1]], most))
                scores = integer_scores(block.vectors[at], vectors[i])
                for p, (least, largest) in zip(row.positives, windows):
                    fits = (scores >= least) & (scores <= largest)
                    found, s = block.best(at[fits], scores[fits], most)
                    if len(found):
                        out.append(pd.DataFrame({"anchor_id": row.id, "tag": row.tag, "place": p["place"], "positive_id": p["id"],
                                                 "positive_score": p["score"], "negative_id": block.ids[found], "negative_score": s}))
        return pd.concat(out)[names] if out else pd.DataFrame({n: [] for n in names})
    return run


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low_pct: int = LOW, high_pct: int = HIGH, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a predicate and ``label`` an expression over the columns
    ``id`` and ``label``. An anchor's positives are its ``positives`` nearest
    other rows of its label; for each, the ``negatives`` nearest rows of other
    labels whose score is from ``low_pct`` to ``high_pct`` percent of the positive's.
    """
    rows = only(vectors, id=id_col, vec=vector_col, label=label_col).where("id is not null and vec is not null and label is not null")
    if label is not None:
        rows = rows.withColumn("label", label)
    kind, label_kind = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    scaled = F.transform("vec", lambda x: x.cast("double") * F.lit(float(scale)))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # floor() of a double gives a long, which a large component leaves; what is larger than 2**52 is whole anyway
    whole = F.transform("vec", lambda x: F.when(F.abs(x) < F.lit(2.0 ** 52), F.floor(x).cast("double")).otherwise(x))
    rows = (rows.withColumn("vec", scaled).where(finite).withColumn("vec", whole)
            .select("id", "label", "vec", F.size("vec").alias("dims"), F.xxhash64("label", "vec").alias("tag"), is_anchor.alias("asks")))

    def code(batches):
        for batch in batches:
            sizes = batch.column("dims").to_numpy()
            vecs = batch.column("vec").to_numpy(zero_copy_only=False)
            n = batch.num_rows
            codes, along, rest = [None] * n, np.zeros((n, LEVELS)), np.zeros((n, LEVELS))
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                c, along[at], rest[at] = encode(np.stack(vecs[at]).astype(np.float64).reshape(len(at), d))
                for i, x in zip(at, c):
                    codes[i] = x.tobytes()
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), LEVELS).cast(pa.list_(pa.float64())) for x in (along, rest)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), *lists],
                                             names=[*batch.schema.names, "code", "along", "rest"])

    coded = keep(rows.mapInArrow(code, f"id {kind}, label {label_kind}, vec array<double>, dims int, tag long, asks boolean, "
                                       "code binary, along array<double>, rest array<double>"), "hardneg-codes")
    shape = coded.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("a"), F.max("dims").alias("dims")).first()
    per_block = max(256, BLOCK_BYTES // (8 * max(1, shape["dims"] or 1)))
    row_blocks, anchor_blocks = max(1, -(-shape["n"] // per_block)), max(1, -(-shape["a"] // min(ANCHOR_BLOCK, per_block)))

    def dealt(df: DataFrame, own: str, mine_: int, across: str, others: int) -> DataFrame:
        """Each row goes to one block of its side, by its id, and meets every block of the other."""
        return (df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(mine_)).cast("int"))
                .withColumn(across, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))))

    keys = ["dims", "qb", "vb"]
    anchors = coded.where("asks").select("id", "tag", "label", "vec", "dims")
    others = dealt(coded.drop("asks"), "vb", row_blocks, "qb", anchor_blocks)
    near = (dealt(anchors, "qb", anchor_blocks, "vb", row_blocks).groupBy(*keys).cogroup(others.groupBy(*keys))
            .applyInPandas(_positives(positives), f"anchor_id {kind}, tag long, positive_id {kind}, positive_score long"))
    first = Window.partitionBy("anchor_id", "tag").orderBy(F.desc("positive_score"), "positive_id")
    near = keep(near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives), "hardneg-positives")
    asked = near.groupBy(F.col("anchor_id").alias("id"), "tag").agg(
        F.sort_array(F.collect_list(F.struct("place", F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))).alias("positives"))
    asking = keep(anchors.join(asked, ["id", "tag"]), "hardneg-anchors")
    far = (dealt(asking, "qb", anchor_blocks, "vb", row_blocks).groupBy(*keys).cogroup(others.groupBy(*keys))
           .applyInPandas(_negatives(negatives, low_pct, high_pct),
                          f"anchor_id {kind}, tag long, place int, positive_id {kind}, positive_score long, negative_id {kind}, "
                          "negative_score long"))
    best = Window.partitionBy("anchor_id", "tag", "place").orderBy(F.desc("negative_score"), "negative_id")
    return (far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))

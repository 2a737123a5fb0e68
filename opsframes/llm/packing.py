"""Best-fit packing by exact-complement hashing.

Documents become token sequences that end in the end-of-text id; only those
longer than a sequence are cut, into full pieces but for the first. What fits
with what depends on piece lengths alone, so the plan is made on the histogram
of lengths, at most ``size`` numbers however large the corpus. Sums of two
lengths are indexed by sum (of three: a length and an indexed pair); for each
length, longest first, a look-up of the gap finds the single, pair or triple
that fills it exactly, and takes it as often as its counts allow. What remains
is packed best fit, longest first. Exact triples can use up short lengths that
best fit needs later, so the plan is made for every depth of the exact phase
(none, singles, pairs, triples; all lengths or only those of an eighth of a
sequence and more), and the one with the fewest sequences is taken. The plan is
a short list of patterns (which lengths share a sequence, how often).

Each task numbers its pieces of every length as it writes them. Shifted by the
counts of the tasks before, the numbers map to the places of the patterns. No
piece is sorted, and a hot length or document is spread like any other.

Edge cases: a null or empty text is the end-of-text id alone. Rows with equal
or null ids are packed one by one; their order among themselves is free.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsframes.llm._common import in_slices, keep, only

SIZE = 1024
END = 2
#: The byte-level pattern of the tokenizer file (its ``use_regex``), as the library states it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class all Unicode versions in use agree on; the tests go through every one.
_OTHER = re.compile("[^\x00-\u024f\u0400-\u0481\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")


def _byte_of() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of texts by the ``tokenizers`` library, or, for plain texts, by a faster one on the same file.

    A byte-level vocabulary whose merges stand in the order of their ids is
    the same thing to ``tiktoken``, which gives the same ids. Texts with an
    added token or a character that not all Unicode versions class alike go
    through ``tokenizers``, as do all if the file is of another kind.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.fast = self._same(spec)

    @cached_property
    def model(self):
        """The file's own library; loaded for the first text that needs it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _same(self, spec: dict):
        """The same tokenizer in the faster library, if it is of the kind described."""
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if (model.get("type") != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space")
                or not before.get("use_regex", True) or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix",
                                                                                   "byte_fallback", "ignore_merges"))):
            return None
        byte_of, vocab = _byte_of(), model["vocab"]
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        own = {t: i for t, i in vocab.items() if t not in self.added}
        if merged != sorted(set(merged)) or set(own.values()) != {*range(256), *merged} or not all(set(t) <= byte_of.keys() for t in own):
            return None
        import tiktoken

        ranks = {bytes(byte_of[c] for c in t): i for t, i in own.items()}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bool:
        return (text.isascii() or not _OTHER.search(text)) and not any(x in text for x in self.added)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        plain = [self.fast is not None and self._plain(t) for t in texts]
        other = [t for t, p in zip(texts, plain) if not p]
        rest = iter(self.model.encode_batch_fast(other, add_special_tokens=False) if other else ())
        return [self.fast.encode_to_numpy(t).astype("<u4", copy=False).tobytes() if p else np.array(next(rest).ids, dtype="<u4").tobytes()
                for t, p in zip(texts, plain)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenise(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, id_col: str = "doc_id",
             text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces: id, piece, start, length, ids_crc32, task, place (among the task's pieces of that length), and ids, if asked for.

    To be written before use: task and place hold for one run."""
    rows = only(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    last = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(tokenizer).encode, TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in in_slices(batches, "text", 2 << 20):
            at, piece, start, length, crc, place, kept = [], [], [], [], [], [], []
            for i, ids in enumerate(encode([t or "" for t in batch.column("text").to_pylist()])):
                ids += last
                n = len(ids) // 4
                a, b, k = 0, n % size or size, 0
                while a < n:
                    m = b - a
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(m)
                    crc.append(zlib.crc32(ids[4 * a:4 * b]))
                    place.append(seen[m])
                    seen[m] += 1
                    if with_ids:
                        kept.append(np.frombuffer(ids, dtype="<i4", count=m, offset=4 * a))
                    a, b, k = b, b + size, k + 1
            columns = [batch.column("id").take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(at), pa.int32()), pa.array(place, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32", "task", "place"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    ids = ", ids array<int>" if with_ids else ""
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, task int, place long{ids}")


Pattern = tuple[int, ...]


class Sums:
    """Lengths, and their pair sums, by sum; counts only go down, so an entry without stock is dropped for good."""

    def __init__(self, left: list[int], least: int):
        self.left = left
        self.have = [n for n in range(len(left) - 1, least - 1, -1) if left[n]]
        self.pairs: dict[int, list[int]] | None = None

    def _indexed(self) -> dict[int, list[int]]:
        """sum -> the longer length of each pair, shortest first (the end of a list is the next to take)."""
        if self.pairs is None:
            self.pairs = {}
            for i, a in enumerate(reversed(self.have)):
                for b in self.have[len(self.have) - 1 - i:]:
                    if a + b < len(self.left):
                        self.pairs.setdefault(a + b, []).append(a)
            for longer in self.pairs.values():
                longer.sort()
        return self.pairs

    def fits(self, parts: Pattern) -> bool:
        return all(self.left[n] >= parts.count(n) for n in parts)

    def single(self, first: int, gap: int) -> Pattern | None:
        return (gap,) if gap > 0 and self.have and gap >= self.have[-1] and self.fits((first, gap)) else None

    def pair(self, taken: Pattern, gap: int, most: int) -> Pattern | None:
        """A pair of that sum beside what is taken, its longer length at most ``most``, the longest there is."""
        longer = self._indexed().get(gap, [])
        for k in range(len(longer) - 1, -1, -1):
            a = longer[k]
            if not self.left[a] or not self.left[gap - a]:
                del longer[k]
            elif a <= most and self.fits((*taken, a, gap - a)):
                return a, gap - a
        return None

    def triple(self, first: int, gap: int) -> Pattern | None:
        for a in self.have:
            if 3 * a < gap:
                return None
            if a < gap - 1 and self.left[a] and (found := self.pair((first, a), gap - a, a)):
                return (a, *found)
        return None


def _packed(counts: dict[int, int], size: int, depth: int, least: int) -> list[tuple[Pattern, int]]:
    """Patterns of an exact phase with up to ``depth`` complements of ``least`` tokens or more, then best fit."""
    left = [counts.get(n, 0) for n in range(size + 1)]
    out: list[tuple[Pattern, int]] = [((size,), left[size])] if left[size] else []
    left[size] = 0
    if depth:
        sums = Sums(left, least)
        looks = [sums.single, lambda n, gap: sums.pair((n,), gap, gap), sums.triple][:depth]
        for n in list(sums.have):
            while left[n]:
                found = next((x for look in looks if (x := look(n, size - n))), None)
                if found is None:
                    break
                pattern = (n, *found)
                times = min(left[m] // pattern.count(m) for m in pattern)
                out.append((pattern, times))
                for m in pattern:
                    left[m] -= times
    # the residuals: best fit, longest first, over gaps of open kinds of sequences
    open_: dict[Pattern, int] = {}
    by_gap: dict[int, list[Pattern]] = {}

    def put(pattern: Pattern, times: int) -> None:
        if pattern not in open_:
            by_gap.setdefault(size - sum(pattern), []).append(pattern)
        open_[pattern] = open_.get(pattern, 0) + times

    for n in range(size - 1, 0, -1):
        todo = left[n]
        while todo:
            gap = min((g for g, p in by_gap.items() if g >= n and p), default=None)
            if gap is None:
                each = size // n
                if todo >= each:
                    put((n,) * each, todo // each)
                    todo %= each
                else:
                    put((n,) * todo, 1)
                    todo = 0
                continue
            pattern = by_gap[gap][-1]
            each = min(todo, gap // n)
            times = min(open_[pattern], todo // each)
            open_[pattern] -= times
            if not open_[pattern]:
                del open_[pattern]
                by_gap[gap].pop()
            put(pattern + (n,) * each, times)
            todo -= each * times
    return out + list(open_.items())


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[Pattern, int]]:
    """Patterns (lengths of a sequence, times) that use up ``counts`` exactly, in as few sequences as any depth of the exact phase gives."""
    bound = -(-sum(n * c for n, c in counts.items()) // size)
    best, fewest = [], None
    for depth, least in ((3, 1), (2, 1), (1, 1), (3, max(1, size // 8)), (2, max(1, size // 8)), (0, 1)):
        made = _packed(counts, size, depth, least)
        n = sum(times for _, times in made)
        if fewest is None or n < fewest:
            best, fewest = made, n
        if fewest <= bound:
            break
    return best


def assign(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (as :func:`tokenise` gives them, written) plus sequence_id and offset."""
    tasks = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    slots: dict[int, list[tuple[int, int, int]]] = {n: [] for n in histogram}  # by length: first number, first sequence, offset
    base, given = 0, dict.fromkeys(histogram, 0)
    for pattern, times in plan(histogram, size):
        offset = 0
        for n in pattern:
            slots[n].append((given[n], base, offset))
            given[n] += times
            offset += n
        base += times
    # bounded by the plan: a few entries a length
    tables = {n: np.array(x, dtype=np.int64).reshape(-1, 3).T for n, x in slots.items()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = tasks.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(shift, ["length", "task"]).withColumn("n", F.col("before") + F.col("place")).drop("before", "place", "task")

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, n = batch.column("length").to_numpy(), batch.column("n").to_numpy()
            sequence, offset = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(n) else []:
                first, base_of, offset_of = tables[int(length[at[0]])]
                k = np.searchsorted(first, n[at], "right") - 1
                sequence[at], offset[at] = base_of[k] + n[at] - first[k], offset_of[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)],
                                             names=[*batch.schema.names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema)
    return numbered.mapInArrow(seat, f"{fields}, sequence_id long, offset long").drop("n")


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for)."""
    pieces = keep(tokenise(docs, tokenizer, size, end, id_col, text_col, with_ids), "packing")
    out = assign(pieces, size)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
                      *(["ids"] if with_ids else []))

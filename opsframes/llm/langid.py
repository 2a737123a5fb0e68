"""Language identification by cross-parsing entropy.

Per language, labelled text is made into a suffix automaton. A document is
parsed greedily into the longest phrases that occur in that text; the language
that needs the fewest phrases per character wins.

Texts are normalised to lower-case letters, with one blank for each run of
anything else, and cut into blocks of ``BLOCK`` characters, at which a phrase
always ends. All blocks of a batch are parsed side by side: one array look-up
per character position moves every block's automaton state. Whole texts are
read, whatever their length.

Training text is a bounded sample of labelled rows, ``TEXTS`` per language at
most, drawn by a hash of the text; those with more than ``LONGEST`` characters
only where a language has no others. The texts drawn are read whole.

Edge cases: a null text, or one without a letter, is ``und`` with score 0.
With no labelled row everything is ``und``. Ties go to the language that
sorts first. Labels that are null or empty are not learned.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframes.llm._common import in_slices, only, utf8

BLOCK = 512
TEXTS = 24
LONGEST = 4_000
DENSE = 1 << 24
UNKNOWN = "und"


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1


def _lower(letter: str) -> str:
    """One lower-case letter (of a capital I with a dot, whose lower case is two code points, the first)."""
    return letter.lower()[0]


class Letters:
    """Code points to symbols: 0 blank, then each letter seen in training, last: any other letter."""

    def __init__(self, letters: list[str]):
        self.size = len(letters) + 2
        self.symbol = {ord(c): i + 1 for i, c in enumerate(letters)}
        self.kind = np.uint8 if self.size <= 256 else np.int32
        self.table = np.zeros(0x10000, dtype=self.kind)
        for point in range(len(self.table)):
            self.table[point] = self._of(point)
        self.far: dict[int, int] = {}

    def _of(self, point: int) -> int:
        if not unicodedata.category(chr(point)).startswith("L"):
            return 0
        return self.symbol.get(ord(_lower(chr(point))), self.size - 1)

    def read(self, text: str) -> np.ndarray:
        """Symbols of a text, with runs of blanks as one."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out = self.table[np.minimum(points, len(self.table) - 1)]
        for i in np.flatnonzero(points >= len(self.table)):
            point = int(points[i])
            if point not in self.far:
                self.far[point] = self._of(point)
            out[i] = self.far[point]
        return out[(out > 0) | np.concatenate(([True], out[:-1] > 0))] if len(out) else out


class Sparse:
    """Transitions as sorted keys state * size + symbol, with the states they lead to."""

    def __init__(self, following: list[dict[int, int]], size: int):
        keys = np.array([state * size + c for state, steps in enumerate(following) for c in steps], dtype=np.int64)
        to = np.array([t for steps in following for t in steps.values()], dtype=np.int32)
        order = np.argsort(keys)
        self.keys, self.to, self.size = keys[order], to[order], size

    def take(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.to[at], -1).astype(np.int32)


def automaton(symbols: np.ndarray, size: int) -> np.ndarray | Sparse:
    """Transitions of the suffix automaton; state 0 is the start. One row per state, -1 for none, or sparse
    where such a table has more than ``DENSE`` cells."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        cur = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = cur
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    if len(following) * size > DENSE:
        return Sparse(following, size)
    out = np.full((len(following), size), -1, dtype=np.int32)
    for state, steps in enumerate(following):
        for c, to in steps.items():
            out[state, c] = to
    return out


def phrases(blocks: np.ndarray, lengths: np.ndarray, steps: np.ndarray | Sparse) -> np.ndarray:
    """Phrases that each block (a column of symbols) needs; ``lengths`` descending.

    A phrase is the longest piece from its start on that occurs in the text behind ``steps``, or a symbol that doesn't occur there."""
    state = np.zeros(blocks.shape[1], dtype=np.int32)
    count = np.zeros(blocks.shape[1], dtype=np.int64)
    sparse = isinstance(steps, Sparse)
    size = steps.size if sparse else steps.shape[1]
    flat = steps if sparse else steps.ravel()
    start = np.maximum(flat.take(np.arange(size)), 0)  # 0 after a symbol unknown to the text
    width = np.searchsorted(-lengths, -np.arange(1, len(blocks) + 1), side="right")
    for row, w in zip(blocks, width):
        c = row[:w]
        count[:w] += state[:w] == 0  # nothing is matched yet: a phrase begins
        to = flat.take((state[:w].astype(np.int64) if sparse else state[:w]) * size + c)
        broken = np.flatnonzero(to < 0)
        if len(broken):
            count[broken[state[broken] > 0]] += 1  # the phrase ends before this symbol, which begins one
            to[broken] = start[c[broken]]
        state[:w] = to
    return count


class Languages:
    """A suffix automaton per language; tells the language of texts."""

    def __init__(self, samples: dict[str, list[str]], block: int = BLOCK):
        seen = {_lower(c) for texts in samples.values() for c in set("".join(texts)) if unicodedata.category(c).startswith("L")}
        self.letters = Letters(sorted(seen))
        self.block = block
        self.names = sorted(samples)
        self.steps = []
        for name in self.names:
            parts = [self.letters.read(t) for t in samples[name]]
            joined = np.concatenate([np.append(p, p.dtype.type(0)) for p in parts] or [np.zeros(1, self.letters.kind)])
            self.steps.append(automaton(joined, self.letters.size))

    def tell(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        read = [self.letters.read(t or "") for t in texts]
        owner, parts = [], []
        for i, symbols in enumerate(read):
            if symbols.any():
                cuts = range(0, len(symbols), self.block)
                owner += [i] * len(cuts)
                parts += [symbols[a:a + self.block] for a in cuts]
        if not parts or not self.names:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        lengths = np.array([len(p) for p in parts])
        order = np.argsort(-lengths, kind="stable")
        blocks = np.zeros((int(lengths.max()), len(parts)), dtype=self.letters.kind)
        for column, k in enumerate(order):
            blocks[:lengths[k], column] = parts[k]
        owner = np.array(owner)[order]
        found = np.stack([np.bincount(owner, phrases(blocks, lengths[order], s), len(texts)) for s in self.steps])
        names, scores = [], []
        for i, symbols in enumerate(read):
            if not symbols.any():
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            need = found[:, i] / len(symbols)
            best = int(need.argmin())
            # share of evidence: phrase rates as code lengths
            bits = np.exp(-np.minimum(50.0, (need - need[best]) * 40))
            names.append(self.names[best])
            scores.append(float(1.0 / bits.sum()))
        return names, scores


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          texts: int = TEXTS, longest: int = LONGEST) -> Languages:
    """Learn from whole texts of rows with a language that are not held out.

    Rows are drawn per language: of each of ``texts`` hash classes the text with
    the least hash, found by a map-side minimum of hashes alone; texts of more
    than ``longest`` characters are drawn only where a class has no other."""
    rows = only(docs, id=id_col, text=text_col, lang=lang_col).where("lang is not null and lang <> '' and text is not null")
    rows = rows.where(~F.coalesce(held_out(F.col("id")), F.lit(False))).where(F.rlike("text", F.lit(r"\p{L}")))
    h = F.xxhash64("text")
    # a class, then long texts after short ones, then the hash: one number
    draw = F.shiftrightunsigned(h, 2) + F.when(F.length("text") > longest, F.lit(1 << 62)).otherwise(F.lit(0))
    rows = rows.select("lang", "text", F.pmod(h, F.lit(texts)).alias("c"), draw.alias("draw"))
    least = rows.groupBy("lang", "c").agg(F.min("draw").alias("draw"))
    drawn = (rows.join(F.broadcast(least), ["lang", "c", "draw"]).groupBy("lang", "c").agg(F.first("text").alias("text"))
             .orderBy("lang", "c").collect())  # at most `texts` rows a language
    samples: dict[str, list[str]] = {}
    for r in drawn:
        samples.setdefault(r["lang"], []).append(r["text"])
    return Languages(samples)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per input row: id, held_out, lang_pred, score. One pass after training, no shuffle."""
    model = train(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size bounded by the sample of each language
    rows = only(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = shared.value
        for batch in in_slices(batches, "text", 4 << 20):
            names, scores = languages.tell([None if t is None else t.decode() for t in utf8(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["id", "lang_pred", "score"])

    told = rows.mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return told.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "lang_pred", "score")

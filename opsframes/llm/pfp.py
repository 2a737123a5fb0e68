"""Repeated byte strings by prefix-free parsing and suffix arrays.

A byte goes if some ``width``-byte string that covers it also starts anywhere
else, in another document or the same one. Strings are judged on the input.

Triggers: the rolling hash of 8 bytes that is strictly least among the
``GAP`` hashes on either side. What makes a trigger is ``CONTEXT`` bytes, so
equal strings have equal triggers inside. Phrases run from one context to the
end of the next; none is a proper prefix of another's suffix longer than a
context. Triggers are more than ``GAP`` bytes apart, so the parse is short
whatever the text.

1. Each text is parsed. Equal texts are one text with a count. Every window
   is tied to an anchor: of all runs of ``RUN`` whole phrases inside it the one
   of least digest (fewer phrases: all of them). Equal windows have equal
   anchors, so only windows whose anchor occurs twice in the corpus go on.
   Neighbouring windows with one anchor form a block. Windows without a trigger
   (short periods) have the least hash inside them as anchor and always go on,
   in blocks of ``BARE`` starts at most.
2. Blocks that equal another, byte for byte (128-bit digest), are repeated in
   all their windows. That is the inside of every repeated passage.
3. What is left, the blocks at the edges of repeated passages and those whose
   anchor another block shares, is highly repetitive text. It is dealt by
   anchor into chunks. In each chunk the suffix array of the dictionary of
   phrases and that of the parse give the order of all suffixes; neighbours in
   that order with ``width`` bytes in common (compared as bytes) are one class.
   Chunks end between anchors, so a class is whole but for anchors too frequent
   for one chunk or cut by a task's edge: their classes meet by a 128-bit digest
   of their ``width`` bytes.
4. Starts found merge into maximal runs per text, and copies take their text's result.

Edge cases: a null or empty text has no bytes. Texts under ``width`` bytes keep
all. Repeated rows (one id, one text) are two occurrences like any other. A
null id is no hindrance. What is kept may cut through a character, so it is bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframes.llm._common import forget, in_slices, keep, only, utf8

WIDTH = 400
HASHED = 8
GAP = 12
CONTEXT = HASHED + 2 * GAP
RUN = 10
BARE = 4096
#: Bytes of blocks that one suffix array orders.
CHUNK_BYTES = 1 << 20
#: Bytes of blocks that one task orders, chunk by chunk.
TASK_BYTES = 16 << 20
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_STEP = 1 << 20
_LETTERS = np.random.default_rng(400).integers(1, 2 ** 32, 256, dtype=np.uint32)
_BASE = 0x9E3779B1
_PLACES = (1 << 24) - 1


def _hashes(raw: np.ndarray) -> np.ndarray:
    """A rolling hash of each run of 8 bytes."""
    h, base, reach = _LETTERS[raw], _BASE, 1
    while reach < HASHED:
        h = h[:-reach] + np.uint32(base) * h[reach:]
        base, reach = base * base % (1 << 32), 2 * reach
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(13))


def triggers(text: bytes) -> np.ndarray:
    """Starts of the trigger contexts, ascending."""
    out = []
    for at in range(0, max(0, len(text) - CONTEXT + 1), _STEP):
        raw = np.frombuffer(text, dtype=np.uint8, count=min(_STEP + CONTEXT - 1, len(text) - at), offset=at)
        h = _hashes(raw)
        low = np.minimum(h[:-1], h[1:])  # of 2, 4, 8 and then GAP hashes in a row
        low = np.minimum(low[:-2], low[2:])
        low = np.minimum(low[:-4], low[4:])
        low = np.minimum(low[:8 - GAP], low[GAP - 8:])
        middle = h[GAP:len(h) - GAP]
        out.append(np.flatnonzero((middle < low[:len(middle)]) & (middle < low[GAP + 1:GAP + 1 + len(middle)])) + at)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _run_digests(digests: np.ndarray, length: int) -> np.ndarray:
    """A digest of each run of ``length`` digests."""
    n = len(digests) - length + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, length, dtype=np.uint64)
    for i in range(length):
        out = (out ^ digests[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _least(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the least of ``size`` values from ``at`` on (by their upper bits; the first, if tied)."""
    n = len(values)
    # a value's upper 40 bits over its place, so that a minimum knows where it is; minima of 1, 2, 4, ... in a row
    rows = [(values & ~np.uint64(_PLACES)) | np.arange(n, dtype=np.uint64) & np.uint64(_PLACES)]
    out = np.empty(len(at), dtype=np.int64)
    level = np.frexp(size)[1] - 1
    for k in range(int(level.max()) + 1):
        if k:
            rows.append(np.minimum(rows[-1][:-(1 << k - 1)], rows[-1][1 << k - 1:]))
        mine = np.flatnonzero(level == k)
        if len(mine):
            x = at[mine]
            low = (np.minimum(rows[k][x], rows[k][x + size[mine] - (1 << k)]) & np.uint64(_PLACES)).astype(np.int64)
            out[mine] = x + ((low - x) & _PLACES)
    return out


def blocks(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, last start, anchor, whether the windows hold no trigger) of all blocks of windows, in order.

    The texts are worked on as one; contexts and windows that cross from one to the next are left out."""
    whole, size = b"".join(texts), np.array([len(t) for t in texts], dtype=np.int64)
    offset = np.cumsum(size) - size
    c = triggers(whole)
    if len(texts):
        own = np.searchsorted(offset, c, "right") - 1
        inside = c + CONTEXT <= (offset + size)[own]
        c, own = c[inside], own[inside]
    # a cell: the starts whose windows hold the same contexts, those from a to b
    early = c - (width - CONTEXT)
    begin = np.sort(np.concatenate((offset[size >= width], c + 1, early[early >= offset[own]] if len(c) else early)))
    begin = begin[np.concatenate(([True], begin[1:] != begin[:-1]))] if len(begin) else begin
    owner = np.searchsorted(offset, begin, "right") - 1
    last = (offset + size)[owner] - width
    valid = begin <= last
    begin, owner, last = begin[valid], owner[valid], last[valid]
    if not len(begin):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none.astype(bool)
    a, b = np.searchsorted(c, begin), np.searchsorted(c, begin + (width - CONTEXT), "right") - 1
    digests = np.array([xxhash.xxh3_64_intdigest(whole[x:y + CONTEXT]) for x, y in zip(c[:-1].tolist(), c[1:].tolist())], dtype=np.uint64)
    held = b - a
    anchor, place = np.zeros(len(begin), dtype=np.uint64), np.full(len(begin), -1)
    full = np.flatnonzero(held >= RUN)
    if len(full):
        runs = _run_digests(digests, RUN)
        place[full] = _least(runs, a[full], held[full] - RUN + 1)
        anchor[full] = runs[place[full]]
    few = np.flatnonzero((held >= 0) & (held < RUN))
    for n in np.unique(held[few]).tolist() if len(few) else ():
        some = few[held[few] == n]
        if n:
            anchor[some] = _run_digests(digests, n)[a[some]]
        else:
            anchor[some] = [xxhash.xxh3_64_intdigest(whole[x:x + CONTEXT]) for x in c[a[some]].tolist()]
        place[some] = -2 - some  # cells of their own
    # join cells of one text and anchor
    end = np.minimum(np.append(begin[1:], last[-1] + 1) - 1, last)
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])))
    first = np.flatnonzero(new)
    end = end[np.append(first[1:], len(new)) - 1]
    begin, owner, anchor, bare = begin[first], owner[first], anchor[first], held[first] < 0
    if bare.any():
        pieces = list(zip(begin[~bare].tolist(), end[~bare].tolist(), anchor[~bare].tolist(), bare[~bare].tolist()))
        for x, y in zip(begin[bare].tolist(), end[bare].tolist()):
            for z in range(x, y + 1, BARE):
                pieces += _bare_blocks(whole, z, min(z + BARE - 1, y), width)
        columns = zip(*sorted(pieces))
        begin, end, anchor, bare = (np.array(x, dtype=k) for x, k in zip(columns, (np.int64, np.int64, np.uint64, bool)))
        owner = np.searchsorted(offset, begin, "right") - 1
    return owner, begin - offset[owner], end - offset[owner], anchor.view(np.int64), bare


def _bare_blocks(text: bytes, first: int, last: int, width: int) -> list[tuple[int, int, int, bool]]:
    """Blocks of starts whose windows hold no trigger: the anchor is the least hash in the window."""
    low = _hashes(np.frombuffer(text, dtype=np.uint8, count=last - first + width, offset=first))
    size, reach = width - HASHED + 1, 1
    while 2 * reach <= size:
        low, reach = np.minimum(low[:-reach], low[reach:]), 2 * reach
    if size > reach:
        low = np.minimum(low[:reach - size], low[size - reach:])
    begin = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    end = np.append(begin[1:], len(low)) - 1
    return [(first + x, first + y, v * 0x9E3779B97F4A7C15 % (1 << 64), True) for x, y, v in zip(begin.tolist(), end.tolist(), low[begin].tolist())]


def suffix_ranks(symbols: np.ndarray, left: np.ndarray, depth: int, pack: int = 1) -> np.ndarray:
    """Ranks of the suffixes of strings laid end to end, by prefix doubling.

    ``left`` holds the number of symbols to the end of each one's string. Equal
    ranks: equal suffixes, or ``depth`` symbols in common. ``pack`` symbols (then
    under 511) make the first key. A rank is the place of its group's first in
    sorted order, so a round sorts only what is still tied and has symbols left."""
    n = len(symbols)
    padded = np.concatenate((symbols + 1, np.zeros(pack, dtype=np.int64)))
    keys = np.zeros(n, dtype=np.int64)
    for k in range(pack):
        keys = (keys << (9 if pack > 1 else 0)) | np.where(left > k, padded[k:k + n], 0)
    rank = np.zeros(n, dtype=np.int64)

    def regroup(at: np.ndarray, old: np.ndarray, key: np.ndarray, reach: int) -> np.ndarray:
        """``at``, sorted by old rank and key, gets new ranks; returns what is tied still and longer than ``reach``."""
        place = np.arange(len(at))
        group = np.concatenate(([True], old[1:] != old[:-1]))
        part = group | np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = old + np.maximum.accumulate(np.where(part, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        first = np.flatnonzero(part)
        many = np.repeat(np.diff(np.append(first, len(at))) > 1, np.diff(np.append(first, len(at))))
        return at[many & (left[at] >= reach)]

    order, reach = np.argsort(keys), pack
    tied = regroup(order, np.zeros(n, dtype=np.int64), keys[order], reach) if n else order
    while reach < depth and len(tied):
        longer = left[tied] > reach
        following = np.zeros(len(tied), dtype=np.int64)
        following[longer] = rank[tied[longer] + reach] + 1
        order = np.argsort(rank[tied] * (n + 2) + following)
        tied, reach = tied[order], 2 * reach
        tied = regroup(tied, rank[tied], following[order], reach)
    return rank


class Order:
    """All suffixes of a few texts in lexicographic order, from the suffix arrays of phrase dictionary and parse."""

    def __init__(self, texts: list[bytes], depth: int):
        known: dict[bytes, int] = {}
        parse, sizes, owner_at = [], [], []
        for text in texts:
            c = triggers(text).tolist()
            cuts = list(zip([0, *c], [x + CONTEXT for x in c] + [len(text)]))
            parse.append([known.setdefault(text[x:y], len(known)) for x, y in cuts])
            owner_at.append([0, *c, len(text)])
        phrases = sorted(known)
        rank_of = np.zeros(len(phrases), dtype=np.int64)
        for r, p in enumerate(phrases):
            rank_of[known[p]] = r
        # dictionary: suffixes of the sorted phrases
        lengths = np.array([len(p) for p in phrases], dtype=np.int64)
        offset = np.concatenate(([0], np.cumsum(lengths)))
        symbols = np.frombuffer(b"".join(phrases), dtype=np.uint8).astype(np.int64)
        left = np.repeat(offset[1:], lengths) - np.arange(len(symbols))
        dictionary = suffix_ranks(symbols, left, depth, 7)
        # parse: suffixes of the phrase sequences
        sizes = np.array([len(p) for p in parse], dtype=np.int64)
        sequence = rank_of[np.concatenate([np.array(p, dtype=np.int64) for p in parse])]
        ends = np.cumsum(sizes)
        parse_left = np.repeat(ends, sizes) - np.arange(len(sequence))
        after = suffix_ranks(sequence, parse_left, depth // GAP + 3) + 1
        following = np.zeros(len(sequence), dtype=np.int64)
        more = np.flatnonzero(parse_left > 1)
        following[more] = after[more + 1]
        # both together for every position: the phrase that holds it, and what of that phrase is left there
        own = np.concatenate([np.diff(x) for x in owner_at])
        phrase = np.repeat(np.arange(len(sequence)), own)
        inner = np.arange(len(phrase)) - np.repeat(np.concatenate(([0], np.cumsum(own)[:-1])), own)
        at = offset[sequence[phrase]] + inner
        self.first, self.second, self.left = dictionary[at], following[phrase], left[at]
        self.raw = np.frombuffer(b"".join(texts), dtype=np.uint8)

    def classes(self, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """``starts`` in suffix order, and for each whether a new class of equal windows begins."""
        order = starts[np.lexsort((self.second[starts], self.first[starts]))]
        new = np.ones(len(order), dtype=bool)
        x, y = order[:-1], order[1:]
        same = self.first[x] == self.first[y]
        # unlike rests of phrases differ before the shorter one ends, so within width bytes unless both are longer
        test = np.flatnonzero(same | ((self.left[x] >= width) & (self.left[y] >= width)))
        view = sliding_window_view(self.raw, width)
        for i in range(0, len(test), 20_000):
            t = test[i:i + 20_000]
            new[t + 1] = (view[x[t]] != view[y[t]]).any(axis=1)
        return order, new


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """A list of values for each of ``n`` owners; ``owner`` ascending."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values, pa.int64()))


def _profile(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, "text", 4 << 20):
        texts = [t or b"" for t in utf8(batch.column("text"))]
        digest = [hashlib.sha256(t) for t in texts]
        key = np.array([struct.unpack(">qq", d.digest()[:16]) for d in digest], dtype=np.int64).reshape(-1, 2)
        owner, _, _, anchor, bare = blocks(texts, width)
        order = np.lexsort((anchor, owner))
        owner, anchor, bare = owner[order], anchor[order], bare[order]
        head = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1])))) if len(order) else order
        # windows of one block can be equal if they hold no trigger
        twice = (np.diff(np.append(head, len(order))) > 1) | bare[head]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([d.hexdigest() for d in digest], pa.string()),
             pa.array(key[:, 0]), pa.array(key[:, 1]), _lists(owner[head], anchor[head], len(texts)),
             _lists(owner[head][twice], anchor[head][twice], len(texts))],
            names=["id", "n_bytes", "sha", "t1", "t2", "anchors", "twice"])


def _longs(digest: int) -> tuple[int, int]:
    return struct.unpack(">qq", digest.to_bytes(16, "big"))


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    names = ["t1", "t2", "lo", "hi", "anchor", "s1", "s2"]
    for batch in in_slices(batches, "text", 4 << 20):
        out: list[list] = [[] for _ in names]
        texts = [t or b"" for t in utf8(batch.column("text"))]
        owner, lo, hi, anchor, _ = blocks(texts, width)
        cut = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        for i, (t1, t2, shared) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "shared")))):
            mine = slice(cut[i], cut[i + 1])
            for k in (np.flatnonzero(np.isin(anchor[mine], np.array(shared, dtype=np.int64))) + cut[i]).tolist():
                b, e = int(lo[k]), int(hi[k])
                for column, value in zip(out, (t1, t2, b, e, int(anchor[k]), *_longs(xxhash.xxh3_128_intdigest(texts[i][b:e + width])))):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if n in ("lo", "hi") else pa.int64()) for n, x in zip(names, out)], names=names)


def _cut_blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, "text", 4 << 20):
        out: list[list] = [[] for _ in range(6)]
        for t1, t2, text, parts in zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), utf8(batch.column("text")),
                                       batch.column("parts").to_pylist()):
            for p in parts:
                for column, value in zip(out, (t1, t2, p["lo"], p["hi"], p["anchor"], text[p["lo"]:p["hi"] + width])):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        whole = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["t1", "t2", "lo", "hi", "anchor", "bytes"])
        yield from in_slices([whole], "bytes", 8 << 20)


def _order_chunk(rows: list[tuple[int, int, int, int, bytes]], width: int, split: set[int]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, t1, t2, first start, bytes) in suffix order.

    Gives the starts of windows that the chunk holds twice, as ranges per text.
    All windows equal to one have its anchor, so for anchors that the chunk holds
    whole this is all. For the anchors in ``split`` a row follows for each class:
    its digest, and its start, which is ``sure`` if the chunk holds the class twice."""
    sizes = np.array([len(r[4]) for r in rows], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    n = sizes - width + 1
    row = np.repeat(np.arange(len(rows)), n)
    inner = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
    order = Order([r[4] for r in rows], width)
    starts, new = order.classes(begin[row] + inner, width)
    head = np.flatnonzero(new)
    many = np.diff(np.append(head, len(new))) > 1
    t = np.array([r[1:4] for r in rows], dtype=np.int64)

    def batch(digests, lo, hi, sure):
        owner = np.searchsorted(begin, lo, "right") - 1
        first = t[owner, 2] - begin[owner]
        one, two = (pa.nulls(len(lo), pa.int64()),) * 2 if digests is None else map(pa.array, digests.T)
        return pa.RecordBatch.from_arrays([one, two, pa.array(t[owner, 0]), pa.array(t[owner, 1]), pa.array((lo + first).astype(np.int32)),
                                           pa.array((hi + first).astype(np.int32)), pa.array(sure)],
                                          names=["c1", "c2", "t1", "t2", "lo", "hi", "sure"])

    twice = np.sort(starts[np.repeat(many, np.diff(np.append(head, len(new))))])
    if len(twice):
        owner = np.searchsorted(begin, twice, "right") - 1
        edge = np.flatnonzero((np.diff(twice) > 1) | (np.diff(owner) > 0))
        lo, hi = twice[np.append(0, edge + 1)], twice[np.append(edge, len(twice) - 1)]
        yield batch(None, lo, hi, np.ones(len(lo), dtype=bool))
    is_split = np.array([r[0] in split for r in rows])
    if is_split.any():
        heads = starts[head]
        mine = np.flatnonzero(is_split[np.searchsorted(begin, heads, "right") - 1])
        raw = order.raw.tobytes()
        for i in range(0, len(mine), 100_000):
            at = mine[i:i + 100_000]
            digests = np.array([_longs(xxhash.xxh3_128_intdigest(raw[x:x + width])) for x in heads[at].tolist()], dtype=np.int64).reshape(-1, 2)
            yield batch(digests, heads[at], heads[at], many[at])


def _starts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by anchor, chunk by chunk; a chunk ends between two anchors unless one fills it twice over."""
    held, size, split = [], 0, set()
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "t1", "t2", "lo", "bytes"))):
            if not held and not split:
                split.add(row[0])  # the task's first anchor may have begun in another one
            if size >= CHUNK_BYTES and (row[0] != held[-1][0] or size >= 2 * CHUNK_BYTES):
                cut = {row[0]} if row[0] == held[-1][0] else set()
                yield from _order_chunk(held, width, split | cut)
                held, size, split = [], 0, cut | {None}
            held.append(row)
            size += len(row[4])
    if held:
        yield from _order_chunk(held, width, split | {held[-1][0]})


def _merged(found: list[dict], width: int) -> list[list[int]]:
    """Maximal intervals of what the windows with these starts cover."""
    out: list[list[int]] = []
    for lo, hi in sorted((f["lo"], f["hi"]) for f in found):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + width)
        else:
            out.append([lo, hi + width])
    return out


def _rest(text: bytes, removed: list[list[int]]) -> bytes:
    edges = [0, *(x for r in removed for x in r), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _changed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, "text", 4 << 20):
        removed, spans, sha = [], [], []
        for text, found in zip(utf8(batch.column("text")), batch.column("found").to_pylist()):
            merged = _merged(found, width)
            rest = _rest(text, merged)
            removed.append(len(text) - len(rest))
            spans.append([{"start": a, "end": b} for a, b in merged])
            sha.append(hashlib.sha256(rest).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("t1"), batch.column("t2"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
            names=["t1", "t2", "n_removed", "kept_sha", "removed"])


def _text_key(text) -> list:
    """The columns t1 and t2 of a text: the first 16 bytes of its SHA-256."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(t) for t, at in (("t1", 1), ("t2", 17))]


def repeated_strings(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(profile, outcome)``.

    ``profile``: one row per input row: id, n_bytes, sha, t1, t2 (the text's key).
    ``outcome``: one row per text of ``width`` bytes or more that loses any: t1,
    t2, copied (another row has the text too, so all of it goes), n_removed,
    kept_sha, removed (byte intervals).
    """
    if width < CONTEXT:
        raise ValueError(f"width must be {CONTEXT} at least")
    rows = only(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    both = ["t1", "t2"]
    profile = keep(rows.mapInArrow(lambda it: _profile(it, width), f"id {kind}, n_bytes long, sha string, t1 long, t2 long, "
                                                                   "anchors array<long>, twice array<long>"), "pfp-profile")
    name = F.coalesce(F.col("id").cast("string"), F.lit("null"))  # picks few rows of a text; any of them would do
    texts = keep(profile.where(f"n_bytes >= {width}").withColumn("name", name).groupBy(*both).agg(
        F.count(F.lit(1)).alias("copies"), F.min("name").alias("name"), F.first("anchors").alias("anchors"), F.first("twice").alias("twice")), "pfp-texts")
    anchors = texts.select(*both, "name", F.explode("anchors").alias("anchor"))
    shared = keep(anchors.groupBy("anchor").agg(F.min("t1").alias("lo"), F.max("t1").alias("hi")).where("lo < hi").select("anchor")
                  .union(texts.select(F.explode("twice"))).distinct(), "pfp-shared")
    marked = anchors.join(shared, "anchor", "left_semi").groupBy("name", *both).agg(F.collect_set("anchor").alias("shared"))
    named = rows.select(name.alias("name"), *_text_key(F.col("text")), "text")
    suspects = keep(named.join(marked, ["name", *both]).dropDuplicates(["name", *both]).drop("name"), "pfp-suspects")
    forget(shared)

    alike = keep(suspects.mapInArrow(lambda it: _blocks(it, width), "t1 long, t2 long, lo int, hi int, anchor long, s1 long, s2 long"), "pfp-blocks")
    # written, so that the join has an exchange of its own on either side, which splits hot passages
    equal = keep(alike.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.min("t1").alias("first")), "pfp-equal")
    told = keep(alike.join(equal, ["s1", "s2"]).drop("s1", "s2"), "pfp-told")
    forget(alike, equal)
    single, settled = told.where("n = 1"), told.where("n > 1")
    partners = settled.where("t1 = first").join(single.select("anchor").distinct(), "anchor", "left_semi")
    columns = [*both, "lo", "hi", "anchor"]
    unlike = single.select(*columns).union(partners.select(*columns))
    parts = unlike.groupBy(*both).agg(F.collect_list(F.struct("lo", "hi", "anchor")).alias("parts"))
    cut = keep(suspects.select(*both, "text").join(parts, both)
               .mapInArrow(lambda it: _cut_blocks(it, width), "t1 long, t2 long, lo int, hi int, anchor long, bytes binary"), "pfp-cut")
    size = cut.agg(F.sum(F.length("bytes"))).first()[0] or 0
    found = keep(cut.repartitionByRange(max(1, -(-size // TASK_BYTES)), "anchor", "t1").sortWithinPartitions("anchor", "t1")
                 .mapInArrow(lambda it: _starts(it, width), "c1 long, c2 long, t1 long, t2 long, lo int, hi int, sure boolean"), "pfp-starts")
    forget(cut)
    classes = found.where("c1 is not null")
    twice = classes.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c1", "c2")
    again = found.where("sure").union(classes.where("not sure").join(twice, ["c1", "c2"], "left_semi").select(*found.columns))
    starts = settled.select(*both, "lo", "hi").union(again.select(*both, "lo", "hi"))
    starts = starts.groupBy(*both).agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    changed = suspects.select(*both, "text").join(starts, both).mapInArrow(
        lambda it: _changed(it, width),
        "t1 long, t2 long, n_removed long, kept_sha string, removed array<struct<start:int,end:int>>")
    copied = texts.where("copies > 1").select(*both, F.lit(True).alias("copied"))
    return profile.drop("anchors", "twice"), changed.join(copied, both, "full_outer")


def removal_report(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, n_bytes, n_removed, n_spans, kept_sha256, removed (array of byte intervals).
    ``width`` has room for a trigger context at least."""
    profile, outcome = repeated_strings(docs, width, id_col, text_col)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return (profile.join(outcome, ["t1", "t2"], "left")
            .withColumn("removed", F.when(F.col("copied"), whole).otherwise(F.coalesce("removed", none)))
            .select(F.col("id").alias(id_col), "n_bytes",
                    F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                    F.size("removed").cast("long").alias("n_spans"),
                    F.when(F.col("copied"), F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"), "removed"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the bytes that remain of each text in ``text_col``, now binary; other columns as they are. No row goes."""
    outcome = repeated_strings(docs, width, id_col, text_col)[1].select("t1", "t2", "copied", "removed")
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *_text_key(F.col(f"`{text_col}`")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            texts = utf8(row.field(names.index(text_col)))
            kept = [b"" if copied else _rest(text or b"", [[r["start"], r["end"]] for r in removed or []])
                    for text, copied, removed in zip(texts, batch.column("copied").to_pylist(), batch.column("removed").to_pylist())]
            yield pa.RecordBatch.from_arrays([row, pa.array(kept, pa.binary())], names=["row", "kept"])

    done = keyed.join(outcome, ["t1", "t2"], "left").mapInArrow(cut, f"row {keyed.schema['row'].dataType.simpleString()}, kept binary")
    return done.select(*[F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names])

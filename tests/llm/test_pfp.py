"""Repeated byte strings against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from conftest import SF_CHECK
from opsframes.llm import pfp, queries

DOC = "doc_id long, text string, id string, sha string, t1 string, name string, row string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "i", "s", "t", "n", "r") for i, t in texts], DOC)


def brute(texts, width=400):
    raw = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(hashlib.md5(b[s:s + width]).digest() for _, b in raw for s in range(len(b) - width + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, dtype=np.int64)
        for s in range(len(b) - width + 1):
            if seen[hashlib.md5(b[s:s + width]).digest()] > 1:
                gone[s] += 1
                gone[s + width if s + width < len(gone) else -1] -= 1
        gone = np.cumsum(gone)[:len(b)] > 0
        rest = bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
        spans = int(((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return Counter(out)


def report(spark, texts, width=400):
    got = pfp.removal_report(table(spark, texts).repartition(4), width)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
    return Counter(tuple(r)[:5] for r in got.collect())


def prose(rng, n, words=400):
    return " ".join(f"word{rng.randrange(words)}" for _ in range(n))


def corpus(seed):
    """Copies, near copies, passages that repeat within and across texts, runs of one letter and of short periods."""
    rng = random.Random(seed)
    hot = [prose(rng, 90), prose(rng, 45), "é漢" * 90 + prose(rng, 40)]
    texts = []
    for _ in range(120):
        t = prose(rng, rng.randrange(0, 200))
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(hot) + t[at:]
        if rng.random() < 0.2:
            t += rng.choice(["a" * rng.randrange(300, 900), "ab" * rng.randrange(100, 500), "0123456789abcdefghijk" * rng.randrange(15, 60)])
        texts.append(t)
    texts += [texts[3], texts[4] + "!", "?" + texts[5], texts[6][:-1], texts[7][5:] + texts[8][:450], "a" * 20_000, "b" * 400, "b" * 400, "c" * 401]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    texts = corpus(seed)
    assert report(spark, texts) == brute(texts)


def test_other_widths_and_many_small_chunks(spark, monkeypatch):
    texts = corpus(3)
    monkeypatch.setattr(pfp, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(pfp, "TASK_BYTES", 20_000)
    for width in (64, 1000):
        assert report(spark, texts, width) == brute(texts, width)
    with pytest.raises(ValueError):
        pfp.removal_report(table(spark, texts), 20)


def test_awkward_rows(spark):
    long_ = " ".join(f"w{i % 997}" for i in range(30_000))
    texts = [(0, None), (1, ""), (2, "x"), (3, long_), (None, long_[1000:3000]), (4, "y" * 399), (4, "y" * 399), (5, "z" * 400), (5, "z" * 400),
             (None, "n" * 200 + "m" * 300), (None, "n" * 200 + "m" * 300), (6, "漢" * 140), (7, "e" + "漢" * 140)]
    assert report(spark, texts) == brute(texts)
    assert not pfp.removal_report(table(spark, [])).count()


def test_remaining_bytes(spark):
    texts = corpus(4)
    docs = table(spark, texts)
    kept = pfp.remove_repeats(docs)
    assert kept.columns == docs.columns
    want = Counter((i, sha) for i, *_, sha in brute(texts).elements())
    assert Counter((r.doc_id, hashlib.sha256(r.text).hexdigest()) for r in kept.collect()) == want


def test_triggers_depend_on_their_context_alone():
    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 101, 50_000, dtype=np.uint8))
    whole = pfp.triggers(text)
    assert (np.diff(whole) > pfp.GAP).all() and len(whole) > 1000
    assert [t for t in whole if 100 <= t <= 5000 - pfp.CONTEXT] == [t + 100 for t in pfp.triggers(text[100:5000])]
    step, pfp._STEP = pfp._STEP, 1000
    try:
        assert (pfp.triggers(text) == whole).all()
    finally:
        pfp._STEP = step


@pytest.mark.parametrize("pack", [1, 3, 7])
def test_suffix_ranks_against_sorting(pack):
    rng = np.random.default_rng(pack)
    for letters in (1, 2, 5, 200):
        strings = [rng.integers(0, letters, rng.integers(1, 60)) for _ in range(30)] + [np.zeros(50, dtype=np.int64)] * 2
        symbols = np.concatenate(strings).astype(np.int64)
        left = np.concatenate([np.arange(len(x), 0, -1) for x in strings])
        suffixes = [tuple(x[i:]) for x in strings for i in range(len(x))]
        got = pfp.suffix_ranks(symbols, left, 64, pack)
        place = {x: i for i, x in enumerate(sorted(set(suffixes)))}
        want = np.array([place[x] for x in suffixes])
        order = np.argsort(got, kind="stable")
        assert (np.diff(want[order]) >= 0).all()
        assert ((np.diff(got[order]) == 0) == (np.diff(want[order]) == 0)).all()
    assert len(pfp.suffix_ranks(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 10)) == 0


def test_blocks_are_the_same_alone_and_together():
    texts = [t.encode() for _, t in corpus(7)] + [b"", b"x" * 399, b"y" * 400, b"ab" * 3000]
    together = [[] for _ in texts]
    for i, *block in zip(*(x.tolist() for x in pfp.blocks(texts, 400))):
        together[i].append(block)
    for t, found in zip(texts, together):
        alone = [list(x[1:]) for x in zip(*(x.tolist() for x in pfp.blocks([t], 400)))]
        assert alone == found
        starts = [s for lo, hi, *_ in found for s in range(lo, hi + 1)]
        assert starts == list(range(max(0, len(t) - 399)))  # each window once


def test_order_is_that_of_all_suffixes():
    rng = random.Random(6)
    texts = [prose(rng, 60, 9).encode() for _ in range(12)] + [b"ab" * 300, b"q" * 50]
    order = pfp.Order(texts, 400)
    joined = b"".join(texts)
    suffixes, at = [], 0
    for t in texts:
        suffixes += [(t[i:], at + i) for i in range(len(t))]
        at += len(t)
    starts = np.array([p for s, p in suffixes if len(s) >= 64])
    got, new = order.classes(starts, 64)
    text_of = {p: s for s, p in suffixes}
    assert all(text_of[a][:400] <= text_of[b][:400] for a, b in zip(got, got[1:]))
    assert [joined[a:a + 64] != joined[b:b + 64] for a, b in zip(got, got[1:])] == new[1:].tolist()


def test_query(spark):
    got = Counter(map(tuple, queries.op12_repeated_bytes(spark, SF_CHECK).collect()))
    assert got == brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()])
    assert sum(1 for r in got if r[2]) > 100

"""Sequence counts against plain best fit, the index of sums, and the two tokenizer libraries on every plain character."""

from __future__ import annotations

import bisect
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from opsframes.llm import packing, queries


def plain_count(counts, size):
    """Sequences of best-fit decreasing, piece by piece."""
    gaps, made = [], 0
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        k = bisect.bisect_left(gaps, n)
        if k < len(gaps):
            gap = gaps.pop(k)
        else:
            gap, made = size, made + 1
        bisect.insort(gaps, gap - n)
    return made


def histograms():
    rng = np.random.default_rng(4)
    yield 1024, Counter(rng.integers(2, 1025, 8000).tolist())
    yield 1024, Counter(np.clip(rng.normal(420, 120, 8000).astype(int), 2, 1024).tolist())
    yield 1024, Counter(np.clip(rng.lognormal(5, 1, 8000).astype(int), 2, 1024).tolist())
    yield 100, Counter(rng.choice([34, 33, 50, 67, 1, 99, 100], 3000).tolist())
    for seed in range(30):
        r = random.Random(seed)
        size = r.choice([8, 30, 100])
        yield size, Counter(r.randrange(1, size + 1) for _ in range(r.randrange(0, 400)))


@pytest.mark.parametrize("size,counts", list(histograms()))
def test_no_more_sequences_than_best_fit(size, counts):
    made = packing.plan(dict(counts), size)
    used = Counter()
    for pattern, times in made:
        assert times > 0 and sum(pattern) <= size
        for n in pattern:
            used[n] += times
    assert used == +counts
    n = sum(times for _, times in made)
    assert -(-sum(k * c for k, c in counts.items()) // size) <= n <= plain_count(counts, size)


def test_sums_find_what_a_search_finds():
    for seed in range(200):
        r = random.Random(seed)
        size = r.choice([12, 20])
        left = [0] + [r.choice([0, 0, 1, 2]) for _ in range(size)]
        least = r.choice([1, 3])
        first = r.choice([n for n in range(1, size + 1) if left[n]] or [0])
        if not first:
            continue
        gap = size - first
        have = [n for n in range(size, least - 1, -1) if left[n]]
        fits = lambda parts: all(left[n] >= [first, *parts].count(n) for n in {first, *parts})
        pairs = [(a, b) for a in have for b in have if a >= b and a + b == gap and fits((a, b))]
        triples = [(a, b, c) for a in have for b in have for c in have if a >= b >= c and a + b + c == gap and fits((a, b, c))]
        sums = packing.Sums(left, least)
        assert sums.pair((first,), gap, gap) == (max(pairs) if pairs else None)
        assert sums.triple(first, gap) == (max(triples) if triples else None)
        assert sums.single(first, gap) == ((gap,) if gap in have and fits((gap,)) else None)


def test_exact_triples_fill_sequences_whole():
    # best fit alone puts 6 + 3, which leaves a gap of 1
    made = packing.plan({6: 2, 2: 4, 3: 0}, 10)
    assert made == [((6, 2, 2), 2)]


def test_places_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    out = packing.pack(docs.repartition(5), queries.tokenizer_path()).cache()
    counts = {r.length: r["count"] for r in out.groupBy("length").count().collect()}
    assert out.agg(F.count_distinct("sequence_id")).first()[0] <= plain_count(counts, 1024)
    filled = {}
    for r in sorted(out.collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 1024


def test_a_row_repeated_often_is_spread(spark):
    row = spark.createDataFrame([(1, "the same text")], "doc_id long, text string")
    docs = row.crossJoin(spark.range(0, 3000, 1, 6).select(F.col("id").alias("n")))
    out = packing.pack(docs, queries.tokenizer_path(), size=32)
    assert out.count() == out.select("sequence_id", "offset").distinct().count() == 3000


def test_both_libraries_give_the_same_ids():
    e = packing.Encoder(queries.tokenizer_path())
    assert e.fast is not None
    plain = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not packing._OTHER.search(chr(c))]
    assert len(plain) > 30_000
    probes = [f"a{x}b {x} 1{x}2 .{x}. {x}{x}'{x}\n{x} \t{x}  {x}" for x in plain]
    probes += ["I'll we've it's 'd 'LL can't", " \n\n  a  b　c", "x" * 5000, " " * 5000, "a\r\n\r\nb", "\x1c\x1d a\x85b"]
    for i in range(0, len(probes), 5000):
        part = probes[i:i + 5000]
        assert all(e._plain(x) for x in part if "　" not in x)
        want = [x.ids for x in e.model.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(part)] == want
        assert [e.fast.encode_ordinary(x) for x in part if "　" not in x] == [w for x, w in zip(part, want) if "　" not in x]


def test_given_documents_encode_alike(spark):
    e = packing.Encoder(queries.tokenizer_path())
    texts = [r.text or "" for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()]
    assert sum(map(e._plain, texts)) > len(texts) // 2
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [x.ids for x in e.model.encode_batch(texts, add_special_tokens=False)]


def test_other_kinds_of_tokenizer_files_are_left_to_their_library(tmp_path):
    import json
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "Lowercase"}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    e = packing.Encoder(str(path))
    assert e.fast is None and e.encode(["ABC d"]) == packing.Encoder(queries.tokenizer_path()).encode(["abc d"])

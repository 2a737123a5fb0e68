"""Hard negatives and importance resampling against brute force, on small and awkward tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from opsframes.llm import hardneg, queries, resample

VEC = "vec_id long, embedding array<float>, label int, id string, code int, tag string, vec string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1, "t", "w") for i, v, y in rows], VEC)


def brute(rows, anchor_every=100, positives=5, negatives=10):
    sound = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        sound[(i, y, tuple(v))] = (i, [math.floor(256 * float(np.float32(x))) for x in v], (y + 1) % 10 if i % 7 == 0 else y)
    out, flat = [], list(sound.values())
    for i, q, y in flat:
        if i % anchor_every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, z) for j, v, z in flat if j != i and len(v) == len(q))
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            p = -s
            fits = [(-t, k) for t, k, z in scored if z != y and 30 * p <= -100 * t <= 90 * p]
            out += [(i, j, r + 1, k, p, t) for r, (t, k) in enumerate(fits[:negatives])]
    return sorted(out)


def mined(spark, rows, **more):
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hardneg.mine(table(spark, rows), F.col("id") % 100 == 0, moved, **more)
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("dims", [3, 64, 100])
def test_hard_negatives_equal_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(4, dims))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 4] * (i % 3) + rng.normal(size=dims) / 4], int(rng.integers(0, 3))) for i in range(500)]
    want = brute(rows)
    assert want and mined(spark, rows) == want


def test_hard_negatives_on_awkward_rows(spark, monkeypatch):
    """Nulls, non-finite, zero, huge and empty vectors, other lengths, a hot vector, repeated rows, ids in several blocks."""
    monkeypatch.setattr(hardneg, "BLOCK_BYTES", 8 * 256 * 2)
    monkeypatch.setattr(hardneg, "ANCHOR_BLOCK", 2)
    inf, nan = math.inf, math.nan
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [1.0, 1.0], None),
            (None, [1.0, 1.0], 1), (6, [0.0, 0.0], 1), (8, [3.0], 1), (9, [], 1), (100, [], 1), (10, [], 2), (11, [1e30, -1e30], 3), (200, [1e30, 0.5], 3)]
    rows += [(i, [0.5, 0.25] if i % 3 == 1 else [1.0, 0.5], i % 4) for i in range(300, 1200)] + [(1200, [1.0, 2.0], 2)] * 3 + [(1201, [1.0, 0.75], 1)] * 3
    want = brute(rows)
    limit = 2 ** 63 - 1
    held = [tuple(min(max(x, -limit - 1), limit) for x in r) for r in want]
    got = mined(spark, rows)
    assert {r[0] for r in want} >= {0, 100, 300, 500, 600, 1200}
    assert [r for r in got if abs(r[4]) < limit] == [r for r in held if abs(r[4]) < limit]
    assert not mined(spark, [])
    assert not mined(spark, [(7, [1.0], 1), (8, [1.0], 2)])  # no anchor


@pytest.mark.parametrize("clustered", [True, False])
def test_intervals_hold_and_leave_rows_out(clustered):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 64)) * 40 * clustered
    rows = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 64)) * 20)
    codes, along, rest = hardneg.encode(rows)
    planes, left = hardneg.Planes(rows[:50]), 0
    for i in range(50):
        true = rows @ rows[i]

        def hold(at, low, high):
            assert (low <= true[at]).all() and (true[at] <= high).all()
            return hardneg.nearest(5)(at, low, high)

        at, low, high = planes.intervals(i, codes, along, rest, hold)
        assert set(np.argsort(-true)[:5]) <= set(at)
        left += len(at) / 4000
    assert left / 50 < 0.2  # most rows are never scored


def test_hard_negatives_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF_CHECK}/embeddings.parquet')")
    got = queries.op11_hard_negatives(spark, SF_CHECK)
    want = con.execute(queries.ORACLE_SQL["op11_hard_negatives"]).df()[got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.itertuples(index=False)))


DOC = "doc_id long, text string, rank string, score string, id string, part string, at string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "r", "s", "i", "p", "a") for i, t in texts], DOC)


def plain(texts, target, percent=25, least=20):
    """The contract in regular expressions and whole features."""
    def found(t):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        return len(w), [zlib.crc32(x.encode()) % 10000 for x in [*w, *map(" ".join, zip(w, w[1:]))]]
    docs = [(i, *found(t)) for i, t in texts]
    s, t = Counter(b for d in docs for b in d[2]), Counter(b for x in target for b in found(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    out, able = [], []
    for i, n, f in docs:
        g = [math.floor(1000 * math.log((t[b] + 1) * (ss + 10000) / ((s[b] + 1) * (tt + 10000)))) for b in f]
        w = math.floor(sum(g) / len(g)) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), w, score, None])
        if n >= least:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(map(tuple, out))


AWKWARD = [(0, None), (1, ""), (2, " \n!!"), (3, "one"), (4, "ÀÉ ß 漢字 Kelvin K Straße İI"), (5, "w " * 30_000), (6, "A-B_c d\x00e\x7ff 0:9@Z[`{~"),
           (7, "tab\tnbsp wide　end x\x1cy\x85z"), (None, "null id " * 10)] + [(8, "again and again " * 9)] * 5


def test_resample_equals_plain_version(spark, monkeypatch):
    monkeypatch.setattr(resample, "ROWS_PER_PART", 7)
    texts = AWKWARD + [(i, " ".join(f"w{(i * j) % 37}" for j in range(i % 50))) for i in range(100, 500)]
    target = ["w1 w2 w3", None, "", "w5 " * 40]
    bench = spark.createDataFrame([(str(i), t) for i, t in enumerate(target)], "item_id string, text string")
    got = resample.resample(documents(spark, texts).repartition(5), bench)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == plain(texts, target)


def test_resample_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    assert not resample.resample(documents(spark, []), none).count()
    got = resample.resample(documents(spark, AWKWARD), none)
    assert Counter(map(tuple, got.collect())) == plain(AWKWARD, [])
    short = resample.resample(documents(spark, AWKWARD[:5]), none).collect()
    assert len(short) == 5 and {r["rank"] for r in short} == {None}


def test_resample_query(spark):
    got = queries.op13_resample(spark, SF_CHECK).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF_CHECK}/benchmark.parquet").collect()]
    assert Counter(map(tuple, got)) == plain(texts, target)


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(resample, "MEMO_BYTES", 2000)
    seeds = resample.Seeds()
    for i in range(1000):
        assert seeds[b"%d" % i] == (zlib.crc32(b"%d" % i), zlib.crc32(b"%d " % i))
        assert len(seeds) <= 10

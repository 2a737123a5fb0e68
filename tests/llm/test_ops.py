"""The training-data operators against brute force, on small and awkward tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_CHECK, SF_SMALL
from opsframes.llm import (ann, decontaminate, langid, licenses, packing, queries, sharding, simhash, substrings, toxicity, warc)

DOC = "doc_id long, text string, lang string, source string, n_chars long, id long, tag string, row string"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))


def docs(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", len(t or ""), 7, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empties, copies, a repeated row, a null id, a very long text, clashing column names."""
    texts = [None, "", "  \n ", "one", PASSAGE, PASSAGE, "start " + PASSAGE + " end", LONG, "ÀÉ ß 漢字 x", "!!! ???"]
    table = docs(spark, texts)
    return table.unionByName(table.where("doc_id = 6")).unionByName(docs(spark, ["a null id"]).withColumn("doc_id", F.lit(None).cast("long"))).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([("b", " ".join(f"P{i}" for i in range(5, 30))), ("a", "one"), ("c", None), (None, "x"), ("d", "")],
                                 "item_id string, text string")


def test_awkward_rows_all_come_back(spark, awkward, labels, benchmark):
    n = awkward.count()
    assert simhash.near_duplicates(awkward).count() == n
    assert toxicity.toxicity(awkward, labels).where("score between 0 and 1").count() == n
    assert substrings.removal_report(awkward).count() == n
    assert substrings.remove_repeats(awkward).count() == n
    assert decontaminate.contamination(awkward, benchmark).count() == n
    assert licenses.scan(awkward).count() == n
    told = langid.identify(awkward).collect()
    assert len(told) == n and {r.lang_pred for r in told} == {"und", "en"}
    assert packing.pack(awkward, queries.tokenizer_path()).where("piece = 0").count() == n
    assert sharding.assign(awkward).count() == n


def test_empty_tables(spark, empty, labels, benchmark):
    assert not simhash.near_duplicates(empty).count()
    assert not toxicity.toxicity(empty, labels).count()
    assert not substrings.removal_report(empty).count()
    assert not decontaminate.contamination(empty, benchmark.limit(0)).count()
    assert not langid.identify(empty).count()
    assert not licenses.scan(empty).count()
    assert not packing.pack(empty, queries.tokenizer_path()).count()
    assert not sharding.assign(empty).count()
    assert not ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count()
    assert not warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count()


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_groups_equal_brute_force(spark):
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = table.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    want = {(r.doc_id, f"{prints[i]:016x}", least[find(i)]) for i, r in enumerate(rows)}
    got = simhash.near_duplicates(table).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == want


@pytest.mark.parametrize("segments", [1, 2, 3, 4, 5])
def test_every_segment_count_finds_every_link(spark, segments):
    rng = random.Random(segments)
    base = [rng.getrandbits(64) for _ in range(20)]
    near = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(6)}
    limit = 2 if segments == 1 else 4
    want = {(a, b) for a in near for b in near if a < b and (a ^ b).bit_count() <= limit}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in near]
    got = simhash.links(spark.createDataFrame(signed, "fp long"), limit, segments).collect()
    assert {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in got} == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_CHECK}/{t}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF_CHECK)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want.fetchall())


def test_substrings_on_awkward_rows(awkward):
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removal_report(awkward).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {(4, 60, 0, sha(PASSAGE)), (5, 60, 60, sha("")), (6, 62, 60, sha("start end")), (0, 0, 0, sha(""))} <= got


def test_vectors_equal_brute_force_on_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:760] = x[700]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [None] * 16), (9004, [float("nan")] * 16),
                                                         (None, x[0].tolist()), (9005, [1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.pmod("id", F.lit(20)) == 0, codes=8).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    y = x.astype(np.float64)
    hit = 0
    for q, found in by.items():
        s = y @ y[q]
        s[q] = -np.inf
        hit += len({v for v, _ in found} & set(np.lexsort((np.arange(1500), -s))[:20].tolist()))
        assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert len(by) == 75 and hit / (75 * 20) >= 0.9
    assert [v for v, _ in by[700]] == list(range(701, 721))


def test_toxicity_held_out(spark):
    sf = SF_CHECK.replace("0.01", "0.1")
    scored = queries.op3_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    right = Counter((r.toxic, r.predicted) for r in scored)
    assert right[1, 1] >= 0.9 * (right[1, 1] + right[1, 0]) and right[0, 1] <= 0.01 * (right[0, 1] + right[0, 0])


def test_composed_machine_equals_its_parts_one_after_the_other():
    """The product of the five machines gives each word the value that it has after a run through each of them."""
    parts, whole = toxicity.grammar_parts(), toxicity.CLAUSES
    assert len(whole.arcs) > 100 and all(len(row) == len(toxicity.LABELS) for row in whole.arcs)
    rng = random.Random(2)
    for _ in range(500):
        labels = [rng.choice(toxicity.LABELS) for _ in range(rng.randrange(0, 30))]
        values = [rng.choice([0.0, 1.5, 3.0]) if x in (toxicity.INSULT, toxicity.HARM) else 0.0 for x in labels]
        stepwise = values
        for machine in parts:
            stepwise = machine.run(labels, stepwise)
        assert whole.run(labels, values) == pytest.approx(stepwise)


def test_machines_against_their_descriptions():
    """Each part against a search through the words before, without states."""
    T, rng = toxicity, random.Random(3)
    for _ in range(300):
        labels = [rng.choice(T.LABELS) for _ in range(rng.randrange(1, 20))]
        values = [float(rng.randrange(1, 5)) for _ in labels]
        near = lambda i, label, reach: label in labels[max(0, i - reach):i]
        got = T.within(3, T.NEGATION, T.SCORED, factor=0.3).run(labels, values)
        assert got == [v * 0.3 if x in T.SCORED and near(i, T.NEGATION, 3) else v for i, (x, v) in enumerate(zip(labels, values))]
        got = T.within(2, T.INSULT, (T.TARGET,), addend=0.5).run(labels, values)
        assert got == [v + 0.5 if x == T.TARGET and near(i, T.INSULT, 2) else v for i, (x, v) in enumerate(zip(labels, values))]
        want, quoted, reported = [], False, False
        for x, v in zip(labels, values):
            want.append(v / 2 if x in T.SCORED and (quoted or reported) else v)
            if x == T.QUOTE:
                quoted, reported = not quoted, False
            elif x == T.REPORT and not quoted:
                reported = True
        assert T.reported_speech().run(labels, values) == want
        want, open_until = [], -1
        for i, (x, v) in enumerate(zip(labels, values)):
            harm = x == T.HARM and i <= open_until
            want.append(v if x == T.INSULT else v + 1 if harm else 0.0)
            if x == T.OPENER or harm:
                open_until = i + T.NEAR
        assert T.insult_and_threat().run(labels, values) == want


def test_grammar_weighs_clauses():
    g = toxicity.Grammar(entries={"idiot": 3.0, "vequ*": 3.0})
    score = lambda t: g.score(t)
    nothing, word, aimed = score("a fine day"), score("idiot"), score("You idiot")
    negated, quoted, reported = score("You are not an idiot"), score('She wrote "you idiot"'), score("They said you idiot")
    assert nothing < negated < word < aimed and quoted < word and reported < word
    # matched words alone tell nothing: only what the clauses make of them
    assert score("not an idiot. never an idiot. no idiot") < score("idiot. idiot. idiot")
    assert score("vequelle") > nothing and g.label("vequelle") == (toxicity.INSULT, 3.0)
    threat = score("I am going to murder you and strangle your family")
    assert threat > score("I will not kill you") > nothing and threat > score("They will kill time") and score("murder mystery") == nothing
    assert score("") == score("x" * 100_000) == nothing


def test_verbs_of_harm_are_learned(spark):
    rng = random.Random(1)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for i in range(600):
        t = [rng.choice(words) for _ in range(30)]
        toxic = i % 3 == 0
        t[10:13] = ["will", rng.choice(words), "zorvex"] if toxic else ["will", rng.choice(words), rng.choice(words)]
        if not toxic:
            t[25] = "zorvex"  # the word itself is in all documents
        rows.append((i, " ".join(t), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    grammar = toxicity.train(docs, labels)
    assert "zorvex" in grammar.harm and "zorvex" not in grammar.entries
    told = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    assert sum(told[i] == y for i, _, y in rows) >= 590


def test_language_held_out(spark):
    told = queries.op7_language(spark, SF_CHECK).where("held_out").join(spark.read.parquet(f"{SF_CHECK}/documents.parquet"), "doc_id")
    assert told.where("lang_pred = lang").count() >= 0.98 * told.count()


@pytest.mark.parametrize("dense", [langid.DENSE, 0])
def test_phrases_equal_greedy_parsing(monkeypatch, dense):
    """Exactly as many phrases as a search for the longest piece from each start on; unknown symbols are phrases of their own."""
    monkeypatch.setattr(langid, "DENSE", dense)
    rng = random.Random(5)
    text = "".join(rng.choice("abc ") for _ in range(300))
    model = langid.Languages({"x": [text]})
    ref = "".join(" abc"[c] for c in model.letters.read(text)) + " "
    docs = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["ddd", "d", "dad", "add", "a", "abcabcd d"]
    read = sorted((model.letters.read(d) for d in docs), key=len, reverse=True)
    want = []
    for symbols in read:
        s, at, n = "".join(" abc?"[c] for c in symbols), 0, 0
        while at < len(s):
            k = 1
            while at + k < len(s) and s[at:at + k + 1] in ref:
                k += 1
            at, n = at + k, n + 1
        want.append(n)
    blocks = np.zeros((len(read[0]), len(read)), dtype=read[0].dtype)
    for i, symbols in enumerate(read):
        blocks[:len(symbols), i] = symbols
    assert langid.phrases(blocks, np.array([len(x) for x in read]), model.steps[0]).tolist() == want


def test_letters_with_a_long_lower_case_are_letters(spark):
    model = langid.Languages({"tr": ["istanbul ilık İzmir"], "x": ["zzz qqq"]})
    names, scores = model.tell(["İİİ İ", "İZ", "̇̇ 1 !", None])
    assert names == ["tr", "tr", "und", "und"] and scores[0] > 0 and scores[2:] == [0.0, 0.0]
    for point in range(0x10000):
        if not 0xD800 <= point < 0xE000:
            letter = __import__("unicodedata").category(chr(point)).startswith("L")
            assert bool(model.letters._of(point)) == letter


def test_language_learns_from_whole_texts(spark):
    """What tells two languages apart stands at the end of their texts, beyond any prefix."""
    same, rows = "lorem ipsum " * 150, []
    for i in range(400):
        lang = "ab"[i % 2]
        rows.append((i, same + ("xyx yxy " if lang == "a" else "uvu vuv ") * 60, lang, "s", 1, 1, "t", "r"))
    rows += [(1000 + i, "x" * 3 + "yx" * 9_000, "long", "s", 1, 1, "t", "r") for i in range(9)]  # only long texts in this one
    table = spark.createDataFrame(rows, DOC)
    model = langid.train(table)
    assert model.names == ["a", "b", "long"]
    told = {r.doc_id: r.lang_pred for r in langid.identify(table).collect()}
    assert all(told[i] == "ab"[i % 2] for i in range(400))


def test_scripts_of_many_letters_are_told_apart(monkeypatch):
    rng = random.Random(4)

    def pieces(words, k):
        return ["".join(rng.choice(words) + (" " if rng.random() < 0.2 else "") for _ in range(k)) for _ in range(12)]

    # the same rate of blanks, so that only the letters tell; Cyrillic, Latin, Greek and Arabic fill the low code points
    low = {"ru": (0x400, 96), "en": (0x61, 26), "de": (0xC0, 190), "el": (0x3B1, 24), "ar": (0x621, 26)}
    high = {"zh": (0x4E00, 900), "ja": (0x6E00, 900), "ko": (0xAC00, 900)}
    words = {n: ["".join(chr(a + rng.randrange(k)) for _ in range(3)) for _ in range(400)] for n, (a, k) in (low | high).items()}
    model = langid.Languages({n: pieces(w, 400) for n, w in words.items()})
    fresh = [(n, t) for n, w in words.items() for t in pieces(w, 40)]
    assert model.tell([t for _, t in fresh])[0] == [n for n, _ in fresh]
    assert len(set(model.letters.symbol.values())) == model.letters.size - 2 > 1_500
    again = langid.Languages({"x": ["abc abd abe"], "y": ["bca bda eba"]})
    monkeypatch.setattr(langid, "DENSE", 0)
    sparse = langid.Languages({"x": ["abc abd abe"], "y": ["bca bda eba"]})
    assert all(isinstance(s, langid.Sparse) for s in sparse.steps) and not any(isinstance(s, langid.Sparse) for s in again.steps)
    texts = ["".join(rng.choice("abcdez ") for _ in range(60)) for _ in range(50)]
    assert sparse.tell(texts) == again.tell(texts)


def test_licences_found_and_nothing_else(spark):
    table = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    got = licenses.scan(table).join(table, "doc_id").collect()
    says = {"Apache-2.0": "Apache License", "MIT": "the MIT License", "GPL": "GNU General Public", "CC-BY-NC": "CC BY-NC 4.0"}
    assert all(r.families == ",".join(sorted(f for f, s in says.items() if s in r.text)) for r in got)


OTHER = "rain river stone market garden winter bread evening letter window".split()


def among(text, n, rng):
    """``text`` between ``n`` other words, on one line."""
    k = rng.randint(0, n)
    words = [rng.choice(OTHER) + str(rng.randint(1, 99)) * rng.randint(0, 1) for _ in range(n)]
    return " ".join(words[:k] + [text] + words[k:])


@pytest.mark.parametrize("n", [200, 1000, 20_000])
def test_templates_found_in_long_paragraphs(spark, n):
    rng = random.Random(n)
    told = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts]
    texts = [among(t, n, rng) for _, t in told] + [among("", n, rng) for _ in range(20)]
    got = {r.doc_id: r.families for r in licenses.scan(docs(spark, texts)).collect()}
    assert not [(f, t) for i, (f, t) in enumerate(told) if f not in got[i].split(",")]
    assert not any(got[i] for i in range(len(told), len(texts)))


HEADERS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell""",
    "GPL": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "GPL,": """You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    "LGPL": """You should have received a copy of the GNU Lesser General Public
License along with this library; if not, write to the Free Software""",
    "AGPL": """You should have received a copy of the GNU Affero General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:""",
    "BSD,": """Use of this source code is governed by a BSD-style
license that can be found in the LICENSE file.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at""",
    "CC-BY": """This work is licensed under a Creative Commons
Attribution 4.0 International License.""",
    "CC-BY-SA": """This work is licensed under a Creative Commons
Attribution-ShareAlike 4.0 International License.""",
    "CC-BY-NC": """This work is licensed under a Creative Commons
Attribution-NonCommercial 4.0 International License.""",
    "CC0": """To the extent possible under law, the author has waived all copyright
and related or neighboring rights to this work.""",
}


def test_wrapped_headers_found_behind_comment_marks(spark):
    marks = [("", "\n", ""), ("# ", "\n# ", "\n"), ("/*\n * ", "\r\n * ", "\n */"), ("<!--\n", "\n", "\n-->"), ("REM ", "\nREM ", ""), ("dnl ", "\ndnl ", "")]
    told = [(f.rstrip(","), begin + t.replace("\n", mark) + end) for f, t in HEADERS.items() for begin, mark, end in marks]
    texts = ["A title\n\n" + t + "\n\nint main() {}\n" for _, t in told]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts)).collect()}
    assert not [(f, t) for i, (f, t) in enumerate(told) if got[i].families != f]
    assert all(got[i].n_licensed == 1 and got[i].n_paragraphs == 3 for i, t in enumerate(texts) if "/*" not in t and "<!" not in t)


SAID = {
    "MIT": ["Licensed under the MIT License.", "SPDX-License-Identifier: MIT", "# SPDX-License-Identifier: MIT\n# Copyright 2024 Foo",
            "It is distributed under the MIT licence."],
    "BSD": ["Released under the BSD 2-Clause License.", "Available under the 2-clause BSD license", "// SPDX-License-Identifier: BSD-2-Clause"],
    "CC-BY": ["Licensed under CC BY 3.0.", "This text is available under the Creative Commons Attribution 3.0 Unported License.",
              "see https://creativecommons.org/licenses/by/2.5/"],
    "CC-BY-SA": ["Shared under CC BY-SA 3.0", "Published under a Creative Commons Attribution-ShareAlike 2.0 license"],
    "CC-BY-NC": ["Published under CC BY-NC 2.0"],
    "GPL": ["Released under the GNU GPL version 2", "Distributed under the terms of the GNU General Public License v2", "licensed under the GPLv3.",
            "SPDX-License-Identifier: GPL-2.0-only",
            "This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License"],
    "LGPL": ["Available under the LGPL v2.1", "This library is free software; you can redistribute it and/or\n"
             "modify it under the terms of the GNU Lesser General Public License"],
    "AGPL": ["This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published"],
    "Apache-2.0": ["Released under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0\n2024 Foo", "https://www.apache.org/licenses/LICENSE-2.0.txt"],
    "MPL-2.0": ["Released under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "Apache-2.0,MIT": ["SPDX-License-Identifier: MIT OR Apache-2.0", "Released under the MIT License. Licensed under the Apache License, Version 2.0."],
    "": ["Licensed under the Apache License, Version 1.1", "Released under the Mozilla Public License 1.1", "Licensed under CC BY-NC-SA 4.0", "He is licensed to drive.",
         "The MIT campus is under construction.", "The park is open under the terms of the city."],
}


def test_licences_in_other_words(spark):
    told = [(f, t) for f, ts in SAID.items() for t in ts]
    got = {r.doc_id: r.families for r in licenses.scan(docs(spark, [t for _, t in told])).collect()}
    assert not [(f, t, got[i]) for i, (f, t) in enumerate(told) if got[i] != f]


def test_licence_threshold_reads_all_windows_and_the_draw_counts_distinct_lines(spark):
    rng = random.Random(8)
    texts = ["This software was granted, day " + " ".join(rng.choice(OTHER) for _ in range(12)) for _ in range(300)]
    table = docs(spark, texts + ["one boilerplate line"] * 3_000)
    model = licenses.Classifier(table, sample=100)
    scored = model.score(licenses.paragraphs(table)).cache()
    assert scored.count() == 300 and not scored.where("alike").count()
    worst = sorted(r.best for r in scored.select("best").collect())
    assert model.threshold(scored.withColumn("best", F.col("best") * 0)) == min(0.5, model.least)
    high = scored.withColumn("best", F.when(F.col("best") >= worst[-1], F.lit(0.75)).otherwise(F.lit(0.1)))
    assert model.threshold(high) == min(0.75, model.least)


def test_every_template_has_anchors_and_fits_a_window(spark):
    held = F.filter("shingles", lambda s: licenses.may_grant(F.regexp_replace(s, "licensed under", "published under")))
    short = licenses.templates(spark).where((F.size("shingles") - F.size(held)) / F.size("shingles") >= licenses.CONFIRM)
    assert not short.collect()
    assert not licenses.templates(spark).where(F.size(licenses.words_of(F.col("line"))) > licenses.STEP + 1).collect()


def test_plan_uses_each_piece_once_and_fills_exactly():
    rng = random.Random(2)
    for _ in range(50):
        counts = Counter(rng.randint(1, 100) for _ in range(rng.randint(0, 400)))
        made = packing.plan(dict(counts), 100)
        used = Counter()
        for pattern, times in made:
            assert times > 0 and sum(pattern) <= 100
            for n in pattern:
                used[n] += times
        assert used == counts


def test_packing_round_trip(spark):
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    pieces = packing.pack(table, queries.tokenizer_path(), with_ids=True).collect()
    model = packing.Encoder(queries.tokenizer_path()).model
    ids = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(ids.setdefault(r.doc_id, [])) and r.length == len(r.ids)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        ids[r.doc_id] += r.ids
    assert ids == {r.doc_id: [*model.encode(r.text, add_special_tokens=False).ids, 2] for r in table.collect()}
    filled = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 1024


def test_encoder_equals_plain_encoding():
    e = packing.Encoder(queries.tokenizer_path())
    texts = ["a  b", " a", "a ", "\n a", "a \nb", "  ", "", "x<|endoftext|> y", "it's  'll", "a  b", "\t\tb c", "é b Ġx Ġ", "   x y"]
    assert e.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in e.model.encode_batch(texts, add_special_tokens=False)]


def test_warc_round_trip(spark):
    big, other = "x" * 1500, "é" * 700
    rows = [(1, "http://a", big), (2, None, big), (3, "http://c", "small"), (4, "u", "small"), (5, "u", None), (6, "u", other), (7, "u", other),
            (None, "u", big), (7, "u", other)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    payload = {k: (h or "").encode() for k, _, h in rows}
    assert Counter(r.page_id for r in got) == Counter(k for k, *_ in rows)
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == (len(payload[r.page_id]), hashlib.sha1(payload[r.page_id]).hexdigest())
        assert r.payload == (None if r.record_type == "revisit" else payload[r.page_id])
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {(1, 2), (6, 7)}


def test_least_capacity_is_minimal_and_blocks_refine_to_it():
    rng = random.Random(1)
    for _ in range(300):
        shards, n = rng.randint(1, 8), rng.randint(1, 40)
        sizes = [rng.choice([1, 2, 8, 50, rng.randint(1, 100)]) for _ in range(n)]
        low = max(-(-sum(sizes) // shards), *sizes)

        def fits(c):
            k = s = 0
            for x in sizes:
                if not k or s + x > c:
                    k, s = k + 1, 0
                s += x
            return k <= shards

        want = next(c for c in range(low, sum(sizes) + 1) if fits(c))
        step = rng.randint(2, 6)
        blocks = [sizes[i:i + step] for i in range(0, n, step)]
        while go := sharding.touched([sum(b) for b in blocks], [len(b) == 1 for b in blocks], shards, low, max(sizes)):
            blocks = [h for i, b in enumerate(blocks) for h in ([b[:len(b) // 2], b[len(b) // 2:]] if i in go else [b])]
        sums = [sum(b) for b in blocks]
        edges = [0, *sharding.cut(sums, shards, low), len(sums)]
        assert max(sum(sums[a:b]) for a, b in zip(edges, edges[1:])) == want


def test_shards_keep_groups_whole(spark):
    table = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    got = sharding.assign(table).join(table.select("doc_id", "text"), "doc_id").collect()
    shard, slots, sizes = {}, {}, Counter()
    for r in got:
        assert shard.setdefault(r.text, r.shard) == r.shard
        assert (r["size"], r.text_crc32) == (len(r.text.encode()) + 8, zlib.crc32(r.text.encode()))
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(shard.values()) == set(range(24))
    assert max(sizes.values()) <= 1.2 * sum(sizes.values()) / 24


def test_pipeline_stages(spark):
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "substrings", "decontamination", "packing"]
    now = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF_SMALL)
        assert now.columns == table.columns
    packed = corpus_pipeline.run(spark, SF_SMALL)
    assert packed.select("doc_id").distinct().count() == now.count() < table.count()


def test_near_duplicates_with_one_id_and_other_texts(spark):
    """Rows that share an id but not the text stand for their own groups, whichever row comes first."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, a), (3, b), (4, c), (4, c), (5, None), (6, ""), (None, a)]
    for order in (rows, rows[::-1]):
        table = spark.createDataFrame([(i, t, "en", "s", 1, 7, "x", "y") for i, t in order], DOC)
        kept = sorted(((r.doc_id, r.text) for r in simhash.drop_near_duplicates(table, 4, 4).collect()), key=str)
        assert kept == sorted([(1, a), (1, b), (4, c), (5, None), (None, a)], key=str)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_and_empty_tables(spark, awkward, empty, name, tmp_path):
    """Each stage on nulls, empties, copies, repeated rows, a null id, a long text and clashing names, and on no rows."""
    for t, rows in (("labels", [(6, 0, 0), (4, 0, 0), (None, 1, 1)]), ("benchmark", [("a", "no such words here at all"), ("c", None)])):
        schema = "doc_id long, quality int, toxic int" if t == "labels" else "item_id string, text string"
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, awkward, str(tmp_path))
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert stage(spark, empty, str(tmp_path)).count() == 0
    if name == "packing":
        assert ids == {r.doc_id for r in awkward.select("doc_id").collect()}
        return
    assert out.columns == awkward.columns
    assert out.exceptAll(awkward).count() == 0 or name == "substrings"
    assert None in ids and 7 in ids
    if name in ("substrings", "decontamination"):
        assert out.count() == awkward.count()
    if name == "simhash":
        assert out.count() == out.select("doc_id").distinct().count()


@pytest.mark.parametrize("limits", [(3, 1 << 30, 1000), (10 ** 6, 400, 1000), (10 ** 6, 60, 1), (10 ** 6, 5, 10 ** 6)])
def test_decontamination_in_any_parts(spark, awkward, benchmark, monkeypatch, limits):
    """Parts by rows or by bytes, or a shuffle join where it would be too many or a window is too long: the same rows."""
    items = benchmark.unionByName(spark.createDataFrame([("cjk", "漢字" * 50)], "item_id string, text string"))
    texts = awkward.unionByName(docs(spark, ["before " + "漢字" * 50 + " after"], first=77))
    want = sorted(map(str, decontaminate.contamination(texts, items).collect()))
    assert sum("contaminated=True" in r for r in want) >= 3
    for name, value in zip(("PART", "PART_BYTES", "PASSES"), limits):
        monkeypatch.setattr(decontaminate, name, value)
    got = decontaminate.contamination(texts, items)
    assert sorted(map(str, got.collect())) == want


def _nearest_by_hand(vectors, k=20, every=20):
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids])
    out = {}
    for q in (i for i in ids if i % every == 0):
        scores = m @ np.array(vectors[q])
        order = sorted((x for x in range(len(ids)) if ids[x] != q), key=lambda x: (-scores[x], ids[x]))[:k]
        out[q] = [(ids[x], scores[x]) for x in order]
    return out


def _recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.vec_id] = (r.rank, r.score)
    for q, hits in found.items():
        assert sorted(rank for rank, _ in hits.values()) == list(range(1, len(want[q]) + 1))
    return np.mean([len({i for i, _ in want[q]} & found.get(q, {}).keys()) / max(1, len(want[q])) for q in want])


def test_nearest_on_the_given_table(spark):
    rows = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").collect()
    vectors = {r.vec_id: [float(x) for x in r.embedding] for r in rows
               if r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)}
    got = queries.op2_nearest(spark, SF_CHECK).collect()
    want = _nearest_by_hand(vectors)
    assert _recall(got, want) >= 0.9
    for r in got:
        assert r.score == pytest.approx(float(np.dot(vectors[r.query_id], vectors[r.vec_id])), abs=1e-12)


def test_clustered_vectors_open_few_cells(spark):
    """On vectors in clusters a query opens a small share of the table for the wanted recall."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 32))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    m = centres[rng.integers(0, 60, 4000)] + rng.normal(size=(4000, 32)) * 0.05
    index = ann.MultiIndex(m, 32, 20, ann.RECALL)
    assert index.share < 0.3
    table = spark.createDataFrame([(i, [float(x) for x in v], "clash", 1) for i, v in enumerate(m)],
                                  "vec_id long, embedding array<double>, vec string, id int")
    got = ann.search(table, F.pmod("id", F.lit(20)) == 0).collect()
    assert _recall(got, _nearest_by_hand(dict(enumerate(m.tolist())))) >= 0.9


def test_nearest_leaves_unsound_vectors_out(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [inf, 0.0]), (2, [1.0, -inf]), (3, [nan, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (None, [1.0, 1.0]),
            (7, [2.0, 0.0]), (8, [1.0, 1.0, 1.0]), (9, []), (10, [1.0, 0.0]), (20, [3.0, 3.0]), (20, [3.0, 3.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.pmod("id", F.lit(20)) == 0).collect()
    told = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        told.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert told == {0: [(20, 3.0), (7, 2.0), (10, 1.0)], 20: [(7, 6.0), (0, 3.0), (10, 3.0)]}


def test_warc_of_long_payloads_and_clashing_names(spark):
    """Megabytes in one record, equal but for the last byte; further columns named like those added on the way."""
    long_ = "".join(random.Random(1).choices("abcdefgh<>/ ", k=3_000_000))
    rows = [(1, "u", long_ + "x"), (2, "u", long_ + "y"), (3, "u", long_ + "x"), (4, None, "é" * 500), (5, "u", "é" * 500), (6, "u", "é" * 499)]
    table = spark.createDataFrame([(*r, "d", "s", "p", 1, "k") for r in rows],
                                  "page_id long, url string, html string, digest string, same string, payload string, id int, kind string")
    got = {r.page_id: r for r in warc.round_trip(table).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        1: ("revisit", 3), 2: ("response", None), 3: ("response", None), 4: ("revisit", 5), 5: ("response", None), 6: ("response", None)}
    for i, _, html in rows:
        assert got[i].payload_digest == hashlib.sha1(html.encode()).hexdigest() and got[i].payload_bytes == len(html.encode())
        assert got[i].payload == (None if got[i].record_type == "revisit" else html.encode())


def test_pipeline_of_an_empty_table(spark, empty, labels, benchmark, tmp_path):
    for name, df in (("documents", empty), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

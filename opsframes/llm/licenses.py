"""License scans by a trained paragraph classifier.

Every paragraph of every document (lines up to a blank one, or one of comment
marks alone; joined without their comment marks) is cut into overlapping windows of
``WINDOW`` words that cover it whole. A window becomes sparse counts of hashed
word 1-grams and 2-grams, of those that the templates have. A multinomial
logistic regression gives each licence family's odds against ``unknown``. It
learns from the written templates below, alone and set between other words,
and from a bounded sample of the corpus' own windows as ``unknown``. All
windows that are classified and don't resemble a template calibrate the unknown
class: a family needs odds above all but ``FALSE_RATE`` of those, but never
more than the templates themselves reach among other words. A family counts only if its
template confirms it: a sentence of a template whose five-word shingles are in
the window to ``CONFIRM`` or more. So windows that cannot be confirmed, as no
anchor word of a template is in them, are not classified.

DataFrame functions and Spark's own feature and regression stages only.

Edge cases: null and empty texts have no paragraphs and no licence. Repeated
rows get equal results; null ids are carried along. A corpus without any
paragraph is scanned with the written background alone.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframes.llm._common import keep, only

UNKNOWN = "unknown"
FEATURES = 1 << 13
SAMPLE = 4_000
FALSE_RATE = 0.001
CONFIRM = 0.8
MIXED = 20
SHINGLE = 5
WINDOW = 64
STEP = 32
# Paragraphs end at blank lines, or lines of marks alone as in comments.
SPLIT = r"\n[^\p{L}\p{N}\n]*+\n[^\p{L}\p{N}]*+"
# Words that mark a comment line; other markers are no letters and fall out of the words.
MARKERS = r"(?m)^[ \t]*(?:rem|dnl)\b"
# Some anchor is in every text that a template can confirm (see may_grant).
ANCHORS = ["licen", "permission", "redistribut", "copyright", "compliance", "software", "granted", "binary", "permitted", "gpl", "creative",
           "mozilla"]
SHORT_ANCHOR = r"cc(?![a-z])|(?<![a-z])mpl(?![a-uw-z])"

# Notices, sentences of licence bodies and SPDX lines of public licences (fixed values). Verbs and version numbers are free
# slots (see SLOTS); each is short enough that another family's name in it, or another version of Apache or MPL, fails CONFIRM.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache 2.0 license.",
        "Apache License, Version 2.0, January 2004",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license",
        "SPDX-License-Identifier: Apache-2.0",
        "SPDX-License-Identifier: MIT OR Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "SPDX-License-Identifier: Apache-2.0 OR MIT",
    ],
    "GPL": [
        "Licensed under the GNU General Public License",
        "Licensed under the GNU GPL",
        "Licensed under the GPL v3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "You should have received a copy of the GNU General Public License along with this program.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works",
        "SPDX-License-Identifier: GPL-3.0",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License",
        "Licensed under the GNU LGPL",
        "Licensed under the LGPL v3",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "SPDX-License-Identifier: LGPL-2.1",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License",
        "Licensed under the GNU AGPL",
        "Licensed under the AGPL v3",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "SPDX-License-Identifier: AGPL-3.0",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Released under the 3-Clause BSD License.",
        "Released under the BSD License.",
        "Released under the New BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "Licensed under the MPL 2.0.",
        "Mozilla Public License Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "Licensed under a Creative Commons Attribution 4.0",
        "creativecommons.org/licenses/by/4.0",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "Licensed under a Creative Commons Attribution-ShareAlike 4.0",
        "Licensed under a Creative Commons Attribution-Share Alike 4.0",
        "creativecommons.org/licenses/by-sa/4.0",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under a Creative Commons Attribution-NonCommercial 4.0",
        "Licensed under a Creative Commons Attribution-Non-Commercial 4.0",
        "creativecommons.org/licenses/by-nc/4.0",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "CC0 1.0 Universal",
        "Licensed under the CC0 license.",
        "creativecommons.org/publicdomain/zero/1.0",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
}
# What is read alike, over lower-case words with single blanks: spellings, verbs of release, articles after "under", and
# version numbers as "#". Version 2 of Apache and MPL is "two", as those families name it.
SLOTS = [
    (r"\blicence", "license"),
    (r"\b(?:licenced|released|distributed|available|published|provided|offered|shared|covered) under\b", "licensed under"),
    (r"\bunder (?:the terms (?:and conditions )?of )?(?:(?:the|an?) )?", "under the "),
    (r"\b([al]?gpl|mpl)v?(\d)", "$1 $2"),
    (r"\b((?:apache|mozilla|mpl)(?: org| software| public| licenses?| mpl)*)(?: version| v)? v?2(?: 0)?\b(?! \d{1,2}\b)", "$1 two"),
    (r"\b(?:(?:version|v) )?v?\d+(?: \d+)*\b", "#"),
]
# Windows that speak of one of the families, or say "licensed under", are no examples of unknown.
ALIKE = (r"\b(?:licensed under|spdx license identifier|mit license|bsd|[al]?gpl|gnu|apache license|mozilla public|mpl|creative ?commons|cc by|cc0|"
         r"isc license|public domain)\b")
# Sentences that speak of licences, permission or copyright without granting any (background).
BACKGROUND = [
    "All rights reserved.", "Copyright 2020 the authors.", "He got his driving license last year.", "The public library is open.",
    "They gave permission to enter.", "The general was known to the public.", "Version 3 of the report is out.", "the", "",
]


def words_of(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), MARKERS, ""), r"[^\p{L}\p{N}]+", " "))
    for found, slot in SLOTS:
        plain = F.regexp_replace(plain, found, slot)
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    """Runs of ``n`` words; none if there are fewer."""
    last = F.size(words) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                                         lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _alike(words: Column) -> Column:
    return F.rlike(F.array_join(words, " "), F.lit(ALIKE))


def _terms(words: Column) -> Column:
    return F.concat(words, _grams(words, 2))


def may_grant(text: Column) -> Column:
    """False only where no template can be confirmed: each has one of the anchors in more than 1 - ``CONFIRM`` of its shingles."""
    low = F.lower(text)
    found = F.rlike(low, F.lit(SHORT_ANCHOR))
    for a in ANCHORS:
        found = found | F.contains(low, F.lit(a))
    return found


def windows(lines: DataFrame) -> DataFrame:
    """``lines`` with words in place of line: overlapping runs of ``WINDOW`` words that cover each whole line.

    Any ``STEP`` + 1 words in a row lie in one window, so every template does."""
    words = F.col("words")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - F.lit(WINDOW - STEP)), F.lit(STEP))
    spelt = lines.withColumn("words", words_of(F.col("line"))).drop("line").where(F.size(words) > 0)
    return spelt.withColumn("words", F.explode(F.transform(starts, lambda i: F.slice(words, i, WINDOW))))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, line): the non-blank paragraphs of every text, each as one line or more."""
    rows = only(docs, id=id_col, text=text_col).select("id", F.xxhash64("text").alias("tag"), F.explode(F.split("text", SPLIT)).alias("line"))
    return rows.where(F.trim("line") != "")


def templates(spark: SparkSession) -> DataFrame:
    """family, line, shingles of each written template; a few hundred rows at most."""
    rows = spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, line string")
    words = F.col("words")
    rows = rows.withColumn("words", words_of(F.col("line")))
    return rows.withColumn("shingles", F.when(F.size(words) < SHINGLE, F.array(F.array_join(words, " "))).otherwise(_grams(words, SHINGLE))).drop("words")


def _examples(spark: SparkSession, background: DataFrame) -> DataFrame:
    """label, words: templates alone and before, after and amid ``MIXED`` windows of the corpus; background as unknown."""
    label = F.create_map(*[F.lit(x) for i, n in enumerate(TEMPLATES) for x in (n, float(i + 1))])
    told = templates(spark).select(label[F.col("family")].alias("label"), words_of(F.col("line")).alias("t"))
    around = background.select(F.col("words").alias("w")).limit(MIXED)
    rest = F.lit(WINDOW) - F.size("t")
    amid = [F.concat("t", F.slice("w", F.lit(1), rest)), F.concat(F.slice("w", F.lit(1), rest), "t"),
            F.concat(F.slice("w", F.lit(1), F.floor(rest / 2).cast("int")), "t", F.slice("w", F.floor(rest / 2).cast("int") + 1, F.floor(rest / 2).cast("int")))]
    mixed = told.crossJoin(F.broadcast(around)).select("label", F.explode(F.array(*amid)).alias("words"))
    plain = spark.createDataFrame([(0.0, t) for t in BACKGROUND], "label double, line string").select("label", words_of(F.col("line")).alias("words"))
    return (told.select("label", F.col("t").alias("words")).unionByName(mixed).unionByName(plain)
            .unionByName(background.select(F.lit(0.0).alias("label"), "words")))


class Classifier:
    """The fitted regression; it is fitted on a sample, its threshold comes from all windows it classifies."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE):
        spark = docs.sparkSession
        lines = paragraphs(docs, id_col, text_col).select("line", F.xxhash64("line").alias("h"))
        n = lines.agg(F.approx_count_distinct("h")).first()[0]
        part = min(1 << 30, -(-2 * sample * (1 << 30) // max(1, n)))
        known = templates(spark)
        # features are the words and word pairs of the templates, so other words around a notice don't weigh
        self.vocabulary = sorted({t for r in known.select(_terms(words_of(F.col("line"))).alias("terms")).collect() for t in r["terms"]})
        self.shingles = sorted({s for r in known.select("shingles").collect() for s in r["shingles"]})
        drawn = windows(lines.where(F.pmod("h", F.lit(1 << 30)) < part).select("line")).distinct()
        drawn = drawn.where(~self._alike()).withColumn("h", F.xxhash64("words")).orderBy("h").limit(sample)
        background = keep(drawn.select("words"), "licenses-background")
        examples = keep(self._features(_examples(spark, background)).drop("words").coalesce(4), "licenses-examples")
        self.model = LogisticRegression(maxIter=30, regParam=1e-3, family="multinomial").fit(examples)
        own = F.element_at("odds", F.col("label").cast("int"))
        self.least = self._odds(examples.where("label > 0")).agg(F.min(own)).first()[0]

    def _alike(self) -> Column:
        """Windows that are no background: they share a five-word shingle with a template, or name a family."""
        return F.arrays_overlap(_grams(F.col("words"), SHINGLE), F.lit(self.shingles)) | _alike(F.col("words"))

    def _features(self, df: DataFrame) -> DataFrame:
        terms = df.withColumn("terms", F.array_intersect(_terms(F.col("words")), F.lit(self.vocabulary)))
        return HashingTF(numFeatures=FEATURES, inputCol="terms", outputCol="features").transform(terms).drop("terms")

    def _odds(self, featured: DataFrame) -> DataFrame:
        """With odds: per family, its probability when only it and unknown are possible."""
        scored = self.model.transform(featured).withColumn("ps", vector_to_array("probability"))
        none = F.col("ps")[0]
        return scored.withColumn("odds", F.transform(F.slice("ps", 2, len(TEMPLATES)), lambda p: p / (p + none))).drop(
            "features", "rawPrediction", "probability", "prediction", "ps")

    def score(self, lines: DataFrame) -> DataFrame:
        """Per window that may be confirmed: the columns of ``lines`` but for line, words (as text), alike, odds and the best of them."""
        text = F.array_join("words", " ")
        parts = windows(lines.where(may_grant(F.col("line")))).where(may_grant(text))
        scored = self._odds(self._features(parts.withColumn("alike", self._alike())))
        return scored.withColumn("words", text).withColumn("best", F.array_max("odds"))

    def predict(self, scored: DataFrame) -> DataFrame:
        """The columns of the lines scored, with family and p: families whose odds pass and a template confirms, in any window."""
        likely = scored.withColumn("words", F.concat(F.lit(" "), "words", F.lit(" "))).where(F.col("best") >= (least := self.threshold(scored)))
        names = F.lit(list(TEMPLATES))
        likely = likely.select("*", F.explode(F.arrays_zip(names.alias("family"), F.col("odds").alias("p"))).alias("of")).select(
            "*", "of.family", "of.p").drop("of", "odds", "best", "alike").where(F.col("p") >= least)
        inside = F.filter("shingles", lambda s: F.contains(F.col("words"), F.concat(F.lit(" "), s, F.lit(" "))))
        met = likely.join(F.broadcast(templates(scored.sparkSession).select("family", "shingles")), "family")
        share = F.size(inside) / F.size("shingles")
        return met.where(share >= CONFIRM).drop("shingles", "words").distinct()

    def threshold(self, scored: DataFrame) -> float:
        """Odds above all but ``FALSE_RATE`` of the distinct background windows; never above what the templates reach among other words."""
        unseen = scored.where(~F.col("alike")).groupBy(F.xxhash64("words")).agg(F.max("best").alias("best"))
        worst = unseen.agg(F.percentile_approx("best", F.lit(1 - FALSE_RATE), F.lit(100_000))).first()[0]
        return min(max(0.5, worst or 0.0), self.least)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, families (sorted, comma-joined; empty if none), n_paragraphs, n_licensed, score (largest odds, else 0)."""
    model = Classifier(docs, id_col, text_col)
    lines = paragraphs(docs, id_col, text_col)
    scored = keep(model.score(lines.select("id", "tag", F.xxhash64("line").alias("paragraph"), "line")), "licenses-scored")
    found = (model.predict(scored).groupBy("id", "tag")
             .agg(F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.count_distinct("paragraph").alias("n_licensed"),
                  F.max("p").alias("score")))
    found = keep(found, "licenses")
    split = F.split("text", SPLIT)
    rows = only(docs, id=id_col, text=text_col).select(
        "id", F.xxhash64("text").alias("tag"), F.coalesce(F.size(F.filter(split, lambda x: F.trim(x) != "")), F.lit(0)).cast("long").alias("n_paragraphs"))
    same = rows["id"].eqNullSafe(found["id"]) & (rows["tag"] == found["tag"])
    return rows.join(found, same, "left").select(
        rows["id"].alias(id_col), F.coalesce("families", F.lit("")).alias("families"), "n_paragraphs",
        F.coalesce("n_licensed", F.lit(0)).alias("n_licensed"), F.coalesce("score", F.lit(0.0)).alias("score"))

"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframes.llm import (ann, decontaminate, hardneg, langid, licenses, packing, pfp, resample, sharding, simhash, substrings, toxicity, warc)
from opsframes.llm._common import table

#: The tokenizer file's name among the installed public vocabularies.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(20)) == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_report(table(spark, sf_dir, "documents")).drop("removed")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("payload")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents")).withColumns(
        {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, moved)


def op12_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfp.removal_report(table(spark, sf_dir, "documents")).drop("removed")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_simhash, op2_nearest, op3_toxicity, op4_substrings, op5_licenses, op6_decontamination, op7_language, op8_packing, op9_warc,
    op10_sharding, op11_hard_negatives, op12_repeated_bytes, op13_resample)}

_WORDS4 = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_WORDS6 = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
           r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

ORACLE_SQL: dict[str, str] = {
    "op4_substrings": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS4} AS w FROM documents),
win AS (SELECT r, doc_id, s, sha256(array_to_string(w[s:s + 49], ' ')) AS k
        FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 49)) AS s FROM d WHERE len(w) >= 50)),
hit AS (SELECT r, s FROM win JOIN (SELECT k, min(doc_id) AS lo FROM win GROUP BY k) USING (k) WHERE doc_id > lo),
word AS (SELECT r, doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d),
gone AS (SELECT DISTINCT r, s + i AS p FROM hit, (SELECT unnest(generate_series(0, 49)) AS i)),
kept AS (SELECT word.r, count(*) AS n, string_agg(x, ' ' ORDER BY word.p) AS t
         FROM word LEFT JOIN gone USING (r, p) WHERE gone.r IS NULL GROUP BY word.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)""",
    "op6_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS6} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS6} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, w[s:s + 9] AS win FROM (
         SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (SELECT r, s, n, w[s:s + n - 1] AS win FROM (
         SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, s, n, item FROM dw JOIN bw USING (win)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)""",
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
             CAST(list_inner_product(a.vec, b.vec) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id AND len(a.vec) = len(b.vec)),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}

"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept. ``run`` writes each stage's result as Parquet in the shared folder and
reads it back for the next.

All stages but the last return the columns of ``docs``, whatever else is among
them, and an empty table for an empty one. Rows are told apart by id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsframes.llm import decontaminate, packing, simhash, substrings, toxicity
from opsframes.llm._common import keep, table
from opsframes.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go. Learns from the labelled ones among ``docs``.

    Null and empty texts have no match and are clean unless such are labelled toxic. Copies and repeated rows
    go or stay together. Without usable labels only the written threat patterns score."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by SimHash fingerprints the document with the least id stays.

    Null and empty texts are one group; of repeated rows one stays; rows without an id stay; rows that share an
    id but not the text belong each to its text's group."""
    return simhash.drop_near_duplicates(docs, simhash.SHINGLE, simhash.MAX_BITS)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller id has too are taken out.

    No row goes, not even one left without words; null and empty texts stay as they are, as do rows without an
    id; repeated rows get equal results."""
    return substrings.remove_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark window go.

    Null and empty texts contain none and stay; copies go or stay together; an empty benchmark keeps all."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, one row per piece.

    A null or empty text is one piece, the end-of-text id; repeated rows are packed one by one."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("substrings", remove_repeats),
          ("decontamination", drop_contaminated), ("packing", pack)]

#: No stage but decontamination and substring removal can be said in SQL, so the whole can't.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

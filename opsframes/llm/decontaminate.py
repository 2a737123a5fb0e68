"""Benchmark decontamination by a prefix-filtered set join.

A window is ``width`` consecutive words of a benchmark item (an item of fewer
words is one window). It occurs in a document only if all its word shingles
(here: words with their place) do, so any one of them is a necessary prefix.
The join uses the rarest: words are counted over all documents, each window
is represented by its rarest word, and only document words that are some
window's rarest word are looked up. A match gives the place where the window
would have to start; the positional bound (it starts within the document) and
the length bound (it ends within it) are applied, and the words are compared.

The main path is DataFrame functions in one generated stage: words, explode,
look-up, bounds and comparison are pipelined, so a document's word array is
never copied per word. The look-up table is broadcast in parts of at most
``PART`` rows and about ``PART_BYTES`` bytes (a word is any run of non-ASCII
characters, so rows alone bound nothing); a larger benchmark takes more passes
over the documents. A single window of more bytes than that is joined by a
shuffle, as are all if there would be more than ``PASSES`` parts.

Edge cases: null and empty texts have no words. Items without words or with
a null id take no part; rows that share an item id are one item with several
texts. Rows that share a document id are told apart by their text.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframes.llm._common import keep, only

WIDTH = 10
PART = 500_000
PART_BYTES = 48 << 20
PASSES = 16
_BREAKS = "".join(chr(c) for c in [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words: runs of ASCII letters and digits and of all other code points."""
    plain = F.translate(text, string.ascii_uppercase + _BREAKS, string.ascii_lowercase + " " * len(_BREAKS))
    return F.array_remove(F.split(F.coalesce(plain, F.lit("")), " "), "")


def item_windows(items: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: win (array of words) and item (id as string), one row each pair."""
    words = only(items, id=id_col, text=text_col).where("id is not null").select(
        F.col("id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    return (words.withColumn("at", F.explode(starts)).select("item", F.slice("words", F.col("at"), F.lit(width)).alias("win"))
            .distinct())


def occurrences(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, win_id, start, len) of every window that occurs in a document; ``windows``: win_id, win."""
    rows = only(docs, id=id_col, text=text_col)
    rows = rows.select("id", F.xxhash64("text").alias("tag"), words_of(F.col("text")).alias("words"))
    vocabulary = windows.select(F.explode("win").alias("word")).distinct()
    counts = [rows.select(F.explode("words").alias("word")).join(part, "word").groupBy("word").count()
              for part in _parts(vocabulary, "word", F.octet_length("word"))]
    common = keep(vocabulary.join(reduce(DataFrame.unionByName, counts), "word", "left")
                  .select("word", F.coalesce("count", F.lit(0)).alias("n")), "decontaminate-counts")
    placed = windows.select("win_id", "win", F.posexplode("win").alias("at", "word")).join(common, "word")
    rarest = placed.groupBy("win_id", "win").agg(F.min(F.struct("n", "word", "at")).alias("rarest"))
    prefixes = keep(rarest.select(F.col("rarest.word").alias("word"), F.col("rarest.at").alias("at"), "win_id", "win"),
                    "decontaminate-prefixes")
    found = []
    for part in _parts(prefixes, "win_id", 2 * F.octet_length("win_id")):
        met = rows.select("id", "tag", "words", F.posexplode("words").alias("pos", "word")).join(part, "word")
        start = F.col("pos") - F.col("at")
        bounds = (start >= 0) & (start + F.size("win") <= F.size("words"))
        same = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("win")) == F.col("win")
        found.append(met.where(bounds).where(same).select("id", "tag", "win_id", start.alias("start"), F.size("win").alias("len")))
    return reduce(DataFrame.unionByName, found)


def _parts(table: DataFrame, key: str, size: Column) -> list[DataFrame]:
    """``table`` in parts marked for broadcast, each of about ``PART`` rows and ``PART_BYTES`` bytes at most by
    ``size`` (a row's bytes); the table itself, unmarked, if it can't be cut so."""
    told = table.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), F.max(size).alias("most")).first()
    n = max(1, -(-told["n"] // PART), -(-(told["bytes"] or 0) // PART_BYTES))
    if n > PASSES or (told["most"] or 0) > PART_BYTES:
        return [table]
    return [F.broadcast(table if n == 1 else table.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)) for i in range(n)]


def _hits(docs: DataFrame, items: DataFrame, width: int, id_col: str, text_col: str, item_col: str, item_text_col: str):
    pairs = keep(item_windows(items, width, item_col, item_text_col).withColumn("win_id", F.array_join("win", " ")), "decontaminate-windows")
    windows = pairs.select("win_id", "win").distinct()
    return keep(occurrences(docs, windows, id_col, text_col).distinct(), "decontaminate-hits"), pairs


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per input row: id, n_words, n_hit (words within an occurrence), n_items, items (sorted ids),
    items_sha256, contaminated."""
    hits, pairs = _hits(docs, items, width, id_col, text_col, item_col, item_text_col)
    # words covered: between neighbouring starts a window adds what the one before has not covered
    by_start = Window.partitionBy("id", "tag").orderBy("start")
    spans = hits.groupBy("id", "tag", "start").agg((F.col("start") + F.max("len")).alias("end"))
    reach = F.coalesce(F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = (spans.select("id", "tag", F.greatest(F.col("end") - F.greatest("start", reach), F.lit(0)).alias("n"))
               .groupBy("id", "tag").agg(F.sum("n").alias("n_hit")))
    named = (hits.select("id", "tag", "win_id").distinct().join(pairs.select("win_id", "item"), "win_id")
             .groupBy("id", "tag").agg(F.array_sort(F.collect_set("item")).alias("items")))
    told = covered.join(named, _same(covered, named)).select(covered["id"], covered["tag"], "n_hit", "items")
    rows = only(docs, id=id_col, text=text_col).select("id", F.xxhash64("text").alias("tag"),
                                                      F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(told, _same(rows, told), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(rows["id"].alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
                      names.alias("items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["tag"] == b["tag"])


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the documents in which a benchmark window occurs; columns as they are.

    Null and empty texts hold no window and stay. Copies and repeated rows go or stay together; rows that share
    an id but not the text are judged each by its text. An empty table gives an empty one, an empty benchmark all rows."""
    names = docs.columns
    hits, _ = _hits(docs, items, width, id_col, text_col, item_col, item_text_col)
    # written, so that the planner knows its size: ids are broadcast where they are few, else both sides are sorted
    gone = keep(hits.select("id", "tag").distinct(), "decontaminate-gone")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{id_col}`").alias("id"),
                        F.xxhash64(F.col(f"`{text_col}`")).alias("tag"))
    return keyed.join(gone, _same(keyed, gone), "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in names])

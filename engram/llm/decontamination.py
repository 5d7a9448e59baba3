"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Words are runs of characters other than ASCII marks and white space, with A-Z in lower case. A window is ten consecutive
words of an item (all words of a shorter item). A document word is hit if it lies in an occurrence of a window.

1. Each window is a set of five-word shingles (fewer in shorter items). A window that occurs in a document has all its
   shingles there, so one of them is enough to find it: its prefix, the rarest one in the benchmark.
2. Every place of every document is looked up in the prefixes by hash. The place of the shingle in the window gives the
   only start the window can have (positional bound), which must leave room for it in the document (length bound).
3. The words at that start are compared with the window's, in the same stage: a common shingle costs comparisons where
   the text is, and nothing is shuffled but windows that do occur.

Prefixes are broadcast at most `BROADCAST_ROWS` at a time, counted first; a larger benchmark is looked up in several
passes over the documents, which are never shuffled for it.

Null or empty texts have no words; items without words have no windows. Equal items and items that share windows are all
reported. Rows of documents that share an id share their hits; a null id counts as an id of its own. An empty benchmark
leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import LOWERED, NOT_ALNUM, UPPER
from engram.session import materialise

WINDOW, SHINGLE = 10, 5
BROADCAST_ROWS = 200_000


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWERED))


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), NOT_ALNUM), lambda w: w != "")


def _grams(name: str, size: int) -> Column:
    """Places (from 1) and hashes of the runs of `size` words in the array column `name`."""
    w = F.col(name)
    places = F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(w, i, size)).alias("h")))


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows of the items: item_id, win (its words)."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    size = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    return items.withColumn("size", size).select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.col("size")))).alias("win")).distinct()


def prefixes(wins: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per distinct window: win, its rarest shingle's hash h, that shingle's place (from 1) and number of words."""
    one = wins.select("win").distinct()
    every = None
    for size in range(1, shingle + 1):
        part = one.where(F.size("win") == size if size < shingle else F.size("win") >= size)
        part = part.select("win", F.lit(size).alias("words"), F.explode(_grams("win", size)).alias("g")).select("win", "words", "g.h", "g.at")
        every = part if every is None else every.unionByName(part)
    rarity = every.groupBy("h").agg(F.count("*").alias("n"))
    ranked = every.join(rarity, "h").groupBy("win").agg(F.min(F.struct("n", "h", "at", "words")).alias("p"))
    return ranked.select("win", "p.h", "p.at", "p.words")


def occurrences(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """Where windows occur: doc_id, start (from 1), win."""
    keys = materialise(prefixes(wins))
    n = keys.count()
    sizes = [r[0] for r in keys.select("words").distinct().collect()]  # SHINGLE values at most
    split = docs.select(F.col("doc_id"), words(F.col("text")).alias("w"))
    found = []
    passes = max(1, -(-n // BROADCAST_ROWS))
    for k in range(passes):
        part = keys.where(F.pmod(F.xxhash64("h"), F.lit(passes)) == k).select("win", F.col("h").alias("_h"), F.col("at").alias("_at"))
        for size in sizes or [SHINGLE]:
            places = split.select("doc_id", "w", F.explode(_grams("w", size)).alias("g"))
            hit = places.join(F.broadcast(part), F.col("g.h") == F.col("_h")).withColumn("start", F.col("g.at") - F.col("_at") + 1)
            hit = hit.where((F.col("start") >= 1) & (F.col("start") + F.size("win") - 1 <= F.size("w")))
            hit = hit.where(F.slice("w", F.greatest("start", F.lit(1)), F.size("win")) == F.col("win"))
            found.append(hit.select("doc_id", "start", "win"))
    return reduce(DataFrame.unionByName, found)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    wins = materialise(windows(benchmark, window))
    found = materialise(occurrences(docs, wins))
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.size("win")).alias("end")))),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("n")),
    )
    hits = found.groupBy(F.col("doc_id").alias("_doc")).agg(covered["n"].alias("n_hit"))
    items = found.select("doc_id", "win").distinct().join(wins, "win").select(F.col("doc_id").alias("_doc2"), F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy("_doc2").agg(F.array_sort(F.collect_list("item")).alias("items"))
    rows = docs.select("doc_id", F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    out = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").join(items, F.col("doc_id").eqNullSafe(F.col("_doc2")), "left")
    none = F.array().cast("array<string>")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size(F.coalesce("items", none)), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns."""
    found = occurrences(docs, materialise(windows(benchmark, window))).select(F.col("doc_id").alias("_llm_hit")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("_llm_hit")), "left_anti")

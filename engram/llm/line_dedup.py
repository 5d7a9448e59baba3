"""Removal of repeated runs of lines by winnowing, in DataFrame functions only.

A document's lines are those between line feeds that hold more than white space; each is known by the hash of its text
without white space at the ends. A run of `RUN` consecutive lines is deleted where it also starts earlier: in a document
with a smaller id or further up in the same one. Longer repeats are covered by their runs. A line of `LONG` words or more is
a run of its own, so a long passage on one line goes whatever stands around it, also where it is all of a document. Blank
lines stay.

1. Winnowing: of every `RUN` neighbouring line hashes the smallest (the last one of equals) is a fingerprint, so any two
   equal runs share one, at the same place in both. A long line's own hash is one too.
2. Fingerprints that occur once are dropped. From every other place the match is extended both ways, to each run around
   it that chose it.
3. The first place of each run is a minimum with partial sums before the shuffle; the later places are deleted. A line
   that a third of all documents hold is one key of joins that Spark can split; no pairs of places are made.

Null texts stay null and have no lines; a document of one short line is never changed. Rows that share id and text never delete
each other's lines; rows that share an id and differ in text are ordered by a hash of the text. A null id comes first.
Empty tables give no rows; other columns are kept by `without_repeats`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.session import materialise

RUN, LONG = 2, 50  # lines of a run; words of a line that is one by itself
SPACE = " \t\r\x0b\x0c"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), l (all lines), at (places of lines that aren't blank)."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("key"), F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
    return rows.withColumn("at", F.filter(F.sequence(F.lit(1), F.size("l")), lambda i: _bare(F.get(F.col("l"), i - 1)) != ""))


def _is_long(line: Column, words: int) -> Column:
    """Whether a line has so many words; most lines are too short for them and aren't counted."""
    return F.when(F.length(line) < 2 * words - 1, False).otherwise(F.size(F.split(_bare(line), f"[{SPACE}]+")) >= words)


def repeated_runs(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """Runs that also start earlier: doc_id, key, start (number of the first line, from 1, blank lines not counted), n (lines)."""
    rows = _lines(docs).where(F.size("at") >= 1)
    rows = rows.select("doc_id", "key", F.transform("at", lambda i: F.get(F.col("l"), i - 1)).alias("l"))
    # a long line's place is kept as its number, any other's as 0
    rows = rows.select("doc_id", "key", F.transform("l", lambda x: F.xxhash64(_bare(x))).alias("h"), F.filter(F.transform("l", lambda x, i: F.when(_is_long(x, long), i + 1).otherwise(0)), lambda i: i > 0).alias("long"))
    starts = F.when(F.size("h") >= run, F.sequence(F.lit(1), F.greatest(F.size("h") - (run - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    # the place of each run's fingerprint: its smallest hash, the last one of equals
    chosen = lambda i: F.array_min(F.transform(F.sequence(i, i + (run - 1)), lambda k: F.struct(F.get(F.col("h"), k - 1).alias("h"), (-k).alias("k"))))
    runs = F.transform(starts, lambda i: F.struct(i.alias("start"), chosen(i).alias("f"), F.slice("h", i, run).alias("lines")))
    lone = F.transform("long", lambda i: F.struct(i.alias("start"), F.struct(F.get(F.col("h"), i - 1).alias("h"), (-i).alias("k")).alias("f"), F.slice("h", i, 1).alias("lines")))
    prints = rows.select("doc_id", "key", F.explode(F.concat(runs, lone) if run > 1 else runs).alias("x"))
    prints = prints.select("doc_id", "key", F.col("x.start").alias("start"), F.col("x.f.h").alias("print"), (-F.col("x.f.k")).alias("place"), F.col("x.lines").alias("lines"))
    prints = materialise(prints)
    # several runs may choose the same place: places are counted, not runs
    often = prints.groupBy("print").agg(F.min(F.struct("doc_id", "key", "place")).alias("a"), F.max(F.struct("doc_id", "key", "place")).alias("b")).where("a <> b").select("print")
    runs = prints.join(often, "print").select("doc_id", "key", "start", "lines")
    first = runs.groupBy(F.col("lines").alias("_lines")).agg(F.min(F.struct("doc_id", "key", "start")).alias("first"), F.max(F.struct("doc_id", "key", "start")).alias("last")).where("first <> last")
    later = runs.join(first, F.col("lines") == F.col("_lines")).where(F.struct("doc_id", "key", "start") > F.col("first"))
    return later.select("doc_id", "key", "start", F.size("lines").alias("n"))


def _cut(docs: DataFrame, run: int, long: int) -> DataFrame:
    """Every row with the lines that are left: l, at, gone (places of deleted lines), and the row's columns in `row`."""
    gone = repeated_runs(docs, run, long).groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).agg(F.collect_set(F.struct("start", "n")).alias("starts"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = own.withColumn("_id", F.col("row.doc_id")).withColumn("_text", F.xxhash64(F.col("row.text").cast("string")))
    both = own.join(gone, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_key")), "left")
    both = both.withColumn("l", F.split(F.coalesce(F.col("row.text").cast("string"), F.lit("")), "\n"))
    both = both.withColumn("at", F.filter(F.sequence(F.lit(1), F.size("l")), lambda i: _bare(F.get(F.col("l"), i - 1)) != ""))
    none = F.array().cast("array<struct<start:int,n:int>>")
    numbers = F.array_distinct(F.flatten(F.transform(F.coalesce("starts", none), lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    both = both.withColumn("gone", F.transform(numbers, lambda k: F.get(F.col("at"), k - 1)))
    left = F.transform(F.array_except(F.sequence(F.lit(1), F.size("l")), F.col("gone")), lambda i: F.get(F.col("l"), i - 1))
    text = F.when(F.size("gone") == 0, F.col("row.text").cast("string")).otherwise(F.array_join(left, "\n"))
    out = F.struct("row", F.size("at").cast("bigint").alias("n_lines"), F.size("gone").cast("bigint").alias("n_removed"), text.alias("left"))
    # the generator keeps filters above from being pushed into the expressions below, which would split a text per line
    return both.select(F.inline(F.array(out)))


def line_dedup(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """doc_id, n_lines, n_removed, text (what is left)."""
    return _cut(docs.select("doc_id", "text"), run, long).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.col("left").alias("text"))


def without_repeats(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """The documents with what is left of their texts and all their columns; those that lost every line are dropped."""
    rows = _cut(docs, run, long).where("n_removed = 0 or n_removed < n_lines")
    return rows.select(*[(F.col("left") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])

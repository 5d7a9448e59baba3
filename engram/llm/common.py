"""Helpers shared by the text operators: tables, slices of Arrow batches, word numbers and hashes, class labels of a graph."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.session import materialise

#: ASCII upper case to lower case, all else kept.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower case, and a space for every ASCII character that is neither letter nor digit; bytes of other characters are kept.
ALNUM = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Java pattern of what separates the words that `ALNUM` leaves.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, whole, by Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `limit` bytes of the named column (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum([len(v) if v is not None else 0 for v in as_bytes(batch.column(text))]) // limit
        starts = [0, *(np.flatnonzero(np.diff(sizes)) + 1), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            yield batch.slice(a, b - a)


def as_bytes(column: pa.Array) -> list:
    """UTF-8 bytes of each value, None for null."""
    return column.cast(pa.binary()).to_pylist()


def map_slices(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, text: str = "text", limit: int = 4 << 20) -> DataFrame:
    """`mapInArrow` over batches of bounded text size."""

    def run(batches):
        return fn(slices(batches, text, limit))

    return df.mapInArrow(run, schema)


class Words(dict):
    """Numbers of the words a task has met, with one table of values per function; emptied when it holds too many."""

    LIMIT = 400_000

    def __init__(self, *functions: Callable[[bytes], int]):
        super().__init__()
        self.functions, self.fresh = functions, []
        self.tables = [np.zeros(0, np.uint64) for _ in functions]

    def __missing__(self, word):
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def numbers(self, words: list) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
            self.tables = [np.zeros(0, np.uint64) for _ in self.functions]
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            for k, f in enumerate(self.functions):
                self.tables[k] = np.concatenate([self.tables[k], np.fromiter(map(f, self.fresh), np.uint64, len(self.fresh))])
            self.fresh = []
        return out

    def values(self, words: list) -> np.ndarray:
        """The first function's value of each word."""
        numbers = self.numbers(words)
        return self.tables[0][numbers]


word_hash = xxhash.xxh3_64_intdigest


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values; empty when there are fewer."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return mix(out)


def components(edges: DataFrame) -> DataFrame:
    """Smallest node each node reaches: rows (node, label) for the nodes of `edges` (columns a, b) that reach a smaller one.

    Alternates the large-star and small-star steps, in which every node hands its smallest neighbour to the others, until
    the edges stand still. A step keeps at most as many edges as it got; each is a pair of group-bys on the edge table,
    and the table is cut by `checkpoint`, so a lost executor only costs its own part.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialise(edges)
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "n")
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(low, F.col("a") == F.col("n"))
        small = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = materialise(small.where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    nodes = edges.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    return nodes

"""Packing of tokenised documents into sequences of fixed size by bin completion.

A document's tokens are those of its text and an end mark. Documents longer than a sequence are cut into whole sequences
and a rest; everything else stays in one piece. What has to be packed is then fully described by how many pieces there are
of each length, a table of at most `SIZE` rows whatever the corpus, so the search for the packing runs on that table:

* around the largest length left, fillings are enumerated, each the greedy completion of one more length; a filling is
  dominated and left out if a larger length would fit in place of the chosen one;
* a filling is used as often as the counts allow, and the search branches over the fullest ones. The first dive is a
  best-fit packing and the first incumbent; a branch is cut when its waste exceeds what a better packing could have;
* it ends at the lower bound (total length, or the number of pieces over half a sequence) or after `NODES` nodes.

Pieces find their places by their rank among those of their length. Ranks are counted in (length, salt) groups, so a
length that a third of all pieces have is spread over tasks; only narrow rows are moved, never texts or tokens.

Words are tokenised once per task and looked up after that, which equals tokenising whole texts, because the tokenizer
never joins what white space parts, nor a letter and a mark; ASCII letters are lowered and marks at the end of words cut
off beforehand, which the tokenizer does too. Words of letters only are tokenised many at a time. Null and empty texts are one piece, the end mark. Rows without an id and repeated rows
are packed like any other. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.llm.common import as_bytes, map_slices
from engram.session import scratch_path

SIZE, END = 2048, 0
NODES, FILLINGS = 6_000, 4
ROWS_PER_SALT, LEAST_SALTS = 1_000_000, 64


#: Marks behind a letter or digit at the end of a word.
_MARKS = re.compile(rb"(?<=[a-z0-9])([.,!?;:#*$%&|]+)(?=\s|\Z)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Tokens(dict):
    """Token numbers of the words a task has met."""

    LIMIT = 500_000

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.fresh = Tokenizer.from_file(path), []
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # the tokens that end a word
        self.last[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self._empty()

    def _empty(self):
        self.clear()
        self.ids, self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word):
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def _learn(self, words: list[str]) -> None:
        plain = [k for k, w in enumerate(words) if w.isalpha()]
        odd = [k for k, w in enumerate(words) if not w.isalpha()]
        order, ids, counts = [], [], []
        groups = [plain[k : k + 64] for k in range(0, len(plain), 64)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(words[k] for k in g) for g in groups], add_special_tokens=False), strict=True):
            own = np.array(found.ids, np.int64)
            ends = np.flatnonzero(self.last[own]) + 1
            if len(ends) != len(group) or ends[-1] != len(own):  # letters that become something else when lowered
                odd += group
                continue
            order += group
            ids.append(own)
            counts.append(np.diff(ends, prepend=0))
        for k, found in zip(odd, self.tokenizer.encode_batch_fast([words[k] for k in odd], add_special_tokens=False), strict=True):
            order.append(k)
            ids.append(np.array(found.ids, np.int64))
            counts.append(np.array([len(found.ids)]))
        counts = np.concatenate(counts)
        starts = len(self.ids) + np.cumsum(counts) - counts
        at = np.argsort(np.array(order))
        self.starts, self.counts = np.concatenate([self.starts, starts[at]]), np.concatenate([self.counts, counts[at]])
        self.ids = np.concatenate([self.ids, np.concatenate(ids).astype(np.uint32)])

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        if len(self) > self.LIMIT:
            self._empty()
        split = [_MARKS.sub(rb" \1", t if b"<|" in t else t.lower()).split() if t else [] for t in texts]
        flat = [w for ws in split for w in ws]
        numbers = np.fromiter(map(self.__getitem__, flat), np.int64, len(flat))
        if self.fresh:
            self._learn([w.decode() for w in self.fresh])
            self.fresh = []
        counts = self.counts[numbers]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        out = self.ids[np.repeat(self.starts[numbers] - ends + counts, counts) + np.arange(total)]
        words = np.cumsum([len(ws) for ws in split])
        at = np.concatenate([[0], ends])[np.concatenate([[0], words]).astype(np.int64)]
        return out, np.diff(at)


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def run(batches):
        tokens, end = Tokens(tokenizer), np.array([END], "<u4").tobytes()
        for b in batches:
            ids, counts = tokens(as_bytes(b.column("text")))
            out, at = [], 0
            for doc, n in zip(b.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                data = ids[at : at + n].astype("<u4").tobytes() + end
                at += n
                for k in range(0, n + 1, size):
                    part = data[4 * k : 4 * (k + size)]
                    out.append((doc, k // size, k, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_slices(rows, run, _PIECES)


def fillings(counts: np.ndarray, first: int, size: int) -> list[tuple[list[int], int]]:
    """The fullest undominated fillings around a piece of length `first`, each with its waste; `counts` by length."""
    left = size - first
    counts = counts.copy()
    counts[first] -= 1
    there = np.flatnonzero(counts[: left + 1])
    if not len(there):
        return [([first], left)]
    below = np.zeros(left + 1, np.int64)  # the largest length there is, up to each length
    below[there] = there
    np.maximum.accumulate(below, out=below)
    rest, steps, cap = left - there, [there], there
    while True:
        nxt = below[np.minimum(rest, cap)]
        if not nxt.any():
            break
        times = np.minimum(rest // np.maximum(nxt, 1), counts[nxt] - np.where(nxt == steps[0], 1, 0)) * (nxt > 0)
        times = np.maximum(times, 0)
        rest = rest - times * nxt
        steps += [nxt, times]
        cap = np.maximum(nxt - 1, 0)
    dominated = below[np.minimum(there + rest, left)] > there
    order = np.lexsort((-there, rest, dominated))[:FILLINGS]
    out = []
    for k in order:
        own = [first, int(there[k])]
        for nxt, times in zip(steps[1::2], steps[2::2], strict=True):
            own += [int(nxt[k])] * int(times[k])
        out.append((own, int(rest[k])))
    return out


def complete_bins(counts: np.ndarray, size: int = SIZE, nodes: int = NODES) -> list[tuple[list[int], int]]:
    """Fillings and how often each is used: `counts[n]` pieces of each length n in as few sequences as the search finds."""
    counts = np.asarray(counts, np.int64).copy()
    total = int((counts * np.arange(len(counts))).sum())
    bound = max(-(-total // size), int(counts[size // 2 + 1 :].sum()))
    best, best_bins = None, np.inf
    # an entry: counts left, used so far (linked), sequences, waste
    stack, seen = [(counts, None, 0, 0)], 0
    while stack:
        counts, used, bins, waste = stack.pop()
        while True:
            # a better packing has fewer sequences, and so at most this much waste
            if best is not None and waste > (best_bins - 1) * size - total:
                break
            largest = np.flatnonzero(counts)
            if not len(largest):
                if bins < best_bins:
                    best, best_bins = used, bins
                break
            seen += 1
            options = []
            for own, slack in fillings(counts, int(largest[-1]), size):
                lengths, need = np.unique(own, return_counts=True)
                times = int((counts[lengths] // need).min())
                if times:
                    options.append((own, slack, lengths, need, times))
            for own, slack, lengths, need, times in options[:0:-1]:
                if best is None or seen < nodes:
                    after = counts.copy()
                    after[lengths] -= need * times
                    stack.append((after, (used, own, times), bins + times, waste + slack * times))
            own, slack, lengths, need, times = options[0]
            counts = counts.copy()
            counts[lengths] -= need * times
            used, bins, waste = (used, own, times), bins + times, waste + slack * times
        if len(stack) > 4 * FILLINGS * len(counts):  # the oldest branches are the last ones tried
            del stack[: len(stack) // 2]
        if best_bins <= bound or seen >= nodes:
            break
    out = []
    while best is not None:
        best, own, times = best
        out.append((own, times))
    return out[::-1]


def places(packing: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of this length in a sequence, offset of the first of them), sorted."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for own, times in packing:
        offset = 0
        for n in sorted(set(own), reverse=True):
            k = own.count(n)
            out.append((n, taken.get(n, 0), sequence, k, offset))
            taken[n] = taken.get(n, 0) + k * times
            offset += n * k
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")
    pieces(docs, tokenizer or default_tokenizer(), size).write.parquet(path)
    rows = spark.read.parquet(path)
    counts = np.zeros(size + 1, np.int64)
    for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect():  # `size` rows at most
        counts[r.length] = r.n
    table = places(complete_bins(counts, size))

    salts = max(LEAST_SALTS, int(counts.sum()) // ROWS_PER_SALT)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sums = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("length").alias("_length"), F.col("salt").alias("_salt"), F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = rows.withColumn("own", own).join(sums, (F.col("length") == F.col("_length")) & (F.col("salt") == F.col("_salt")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))
    sent = spark.sparkContext.broadcast(table)  # some rows per length

    def run(batches):
        t = sent.value
        keys = (t[:, 0] << 48) + t[:, 1] if len(t) else np.zeros(0, np.int64)
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = t[np.searchsorted(keys, (n << 48) + rank, side="right") - 1]
            step = rank - at[:, 1]
            sequence, offset = at[:, 2] + step // at[:, 3], at[:, 4] + step % at[:, 3] * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, _PIECES + ", sequence_id bigint, offset bigint")

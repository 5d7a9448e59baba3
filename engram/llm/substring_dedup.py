"""Removal of repeated passages by level-wise doubling of word windows.

A window is `length` consecutive words of one document. A word is removed when it lies in a window whose word sequence
also starts in a document with a smaller id. Every level looks at windows of one length, and only windows that hold a
repeated one of the level below are extended to twice its length (to `length` at the last level); with no candidates
left, nothing more is sent. The levels for 13 words are 7 and 13.

Documents are packed into blocks of about `BLOCK_BYTES` of text, written once to the shared folder, so that every level
finds the same blocks whatever executors are lost. What moves between tasks are packed arrays, split by ranges of the
hash: a level sends, of each longer window, only the smallest hash among its parts (one in four windows of the level, and
two equal windows always send the same one), and gets back which of these are repeated. Levels below the last compare
32 bits within a range, which can only let too much through; the last one compares 64 bits of the candidates left. A
passage that a third of all documents hold is a run of equal numbers in such an array; no pairs are made.

`RANGE_WINDOWS` bounds what one reducer holds. Null texts have no words. Documents without an id are neither a source nor
changed. Rows that share an id never remove each other's words. Repeated rows stay as they are; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import Words, as_bytes, map_slices, mix, window_hashes, word_hash
from engram.session import scratch_path

LENGTH = 13
BLOCK_BYTES = 2 << 20
RANGE_WINDOWS = 1 << 22
LEAST_BITS, MOST_BITS = 8, 16


def levels(length: int) -> list[int]:
    """Window lengths from the first level to `length`, each at most twice the one before."""
    out = [length]
    while out[0] > 8:
        out.insert(0, (out[0] + 1) // 2)
    return out


def pack(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as compressed steps, byte planes apart."""
    steps = np.diff(values.astype(np.uint32), prepend=np.uint32(0)).astype("<u4")
    return len(values).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint32)
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel(), dtype=np.uint32)


def squeeze(values: np.ndarray) -> bytes:
    return len(values).to_bytes(4, "little") + pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def loosen(data: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    return np.frombuffer(pa.decompress(data[4:], decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


class Block:
    """The documents of one block: words, hashes, and which words start a window that stays within a document."""

    def __init__(self, data: bytes, ids: bytes, sizes: bytes, words: Words | None):
        sizes, ids = loosen(sizes, np.int64), loosen(ids, np.int64).reshape(2, -1)
        self.ids, self.known = ids[0], ids[1] > 0
        text = loosen(data, np.uint8).tobytes()
        ends = np.cumsum(sizes)
        self.split = [text[e - s : e].split() for s, e in zip(sizes, ends, strict=True)]
        self.counts = np.fromiter(map(len, self.split), np.int64, len(self.split))
        self.ends = np.cumsum(self.counts)
        if words is not None:
            self.hashes = words.values([w for ws in self.split for w in ws])

    def windows(self, n: int) -> np.ndarray:
        """Places where a window of n words starts."""
        left = np.repeat(self.ends, self.counts) - np.arange(self.counts.sum())
        return np.flatnonzero((left >= n) & np.repeat(self.known, self.counts))

    def smallest(self, level: int, above: int) -> np.ndarray:
        """For every place, the smallest hash of the windows of length `level` in the window of length `above` there."""
        h, width, done = window_hashes(self.hashes, level), above - level + 1, 1
        while done < width:
            step = min(done, width - done)
            h = np.minimum(h[:-step], h[step:]) if len(h) > step else h[:0]
            done += step
        return h

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")


def _ranges(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - bits)).astype(np.int64), ((h >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _parts(r: np.ndarray, order: np.ndarray):
    """(range, rows in order) of each range met."""
    r = r[order]
    cuts = [0, *(np.flatnonzero(np.diff(r)) + 1), len(r)]
    for s, e in zip(cuts, cuts[1:], strict=False):
        if e > s:
            yield int(r[s]), order[s:e]


def _rows(schema: list, rows: list):
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), schema, strict=True)], names=[n for n, _ in schema])


def _groups(batches, key: str):
    """Rows of sorted batches as (key, list of dicts)."""
    held, at = [], None
    for b in batches:
        for row in b.to_pylist():
            if held and row[key] != at:
                yield at, held
                held = []
            at = row[key]
            held.append(row)
    if held:
        yield at, held


def blocks_of(docs: DataFrame, path: str) -> DataFrame:
    """The documents in blocks, written once."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            texts, ids = [t or b"" for t in as_bytes(b.column("text"))], b.column("doc_id").to_pylist()
            numbers = np.array([[i or 0 for i in ids], [i is not None for i in ids]], np.int64)
            yield from _rows(_BLOCK, [((part << 32) + n, squeeze(np.frombuffer(b"".join(texts), np.uint8)), squeeze(numbers.ravel()), squeeze(np.array([len(t) for t in texts], np.int64)), sum(map(len, texts)) // 4)])
            n += 1

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    map_slices(rows, run, "block bigint, data binary, ids binary, sizes binary, about bigint", limit=BLOCK_BYTES).write.option("compression", "uncompressed").parquet(path)
    return docs.sparkSession.read.parquet(path)


_BLOCK = [("block", pa.int64()), ("data", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("about", pa.int64())]
_SENT = [("r", pa.int32()), ("block", pa.int64()), ("v", pa.binary()), ("p", pa.binary()), ("d", pa.binary())]
_SENT_DDL = "r int, block bigint, v binary, p binary, d binary"
_BACK = [("block", pa.int64()), ("r", pa.int32()), ("v", pa.binary())]
_BACK_DDL = "block bigint, r int, v binary"


def first_level(blocks: DataFrame, level: int, above: int, bits: int) -> DataFrame:
    def run(batches):
        words = Words(word_hash)
        for b in batches:
            for x in b.to_pylist():
                yield from _send_smallest(Block(x["data"], x["ids"], x["sizes"], words), x["block"], level, above, bits, None)

    return blocks.select("block", "data", "ids", "sizes").mapInArrow(run, _SENT_DDL)


def _send_smallest(block: Block, name: int, level: int, above: int, bits: int, places: np.ndarray | None):
    low = block.smallest(level, above)
    places = block.windows(above) if places is None else places
    if not len(places):
        return
    h, doc = low[places], block.document(places)
    new = np.ones(len(places), bool)  # neighbours mostly share the smallest part
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h = np.sort(h[new])
    r, v = _ranges(h, bits)
    yield from _rows(_SENT, [(k, name, pack(v[i]), None, None) for k, i in _parts(r, np.arange(len(h)))])


def repeated(sent: DataFrame) -> DataFrame:
    """Of each block's numbers, those that occur twice or more in all blocks."""

    def run(batches):
        for r, rows in _groups(batches, "r"):
            own = [unpack(x["v"]) for x in rows]
            every = np.sort(np.concatenate(own))
            twice = np.unique(every[1:][every[1:] == every[:-1]])
            out = []
            for x, v in zip(rows, own, strict=True):
                v = np.unique(v)
                v = v[_among(v, twice)]
                if len(v):
                    out.append((x["block"], r, pack(v)))
            yield from _rows(_BACK, out)

    return sent.repartition("r").sortWithinPartitions("r").mapInArrow(run, _BACK_DDL)


def _among(values: np.ndarray, those: np.ndarray) -> np.ndarray:
    if not len(those):
        return np.zeros(len(values), bool)
    return those[np.minimum(np.searchsorted(those, values), len(those) - 1)] == values


def _with(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks and what came back for them, block by block."""
    both = blocks.select("block", "data", "ids", "sizes", F.lit(None).cast("int").alias("r"), F.lit(None).cast("binary").alias("v"))
    none = [F.lit(None).cast("binary").alias(c) for c in ("data", "ids", "sizes")]
    return both.unionByName(answers.select("block", *none, "r", "v")).repartition("block").sortWithinPartitions("block", F.col("r").asc_nulls_first())


def next_level(blocks: DataFrame, answers: DataFrame, passed: int, level: int, above: int | None, bits: int) -> DataFrame:
    """Windows of length `level` that hold a repeated one of length `passed`, sent on: the smallest parts of those to be extended to `above`, or at the last level (None) all of them."""

    def run(batches):
        words = Words(word_hash)
        for name, rows in _groups(batches, "block"):
            if rows[0]["data"] is None or len(rows) == 1:
                continue
            block = Block(rows[0]["data"], rows[0]["ids"], rows[0]["sizes"], words)
            known = np.concatenate([(np.uint64(x["r"]) << np.uint64(32)) + unpack(x["v"]).astype(np.uint64) for x in rows[1:]])
            places = block.windows(level)
            low = block.smallest(passed, level)[places]
            places = places[_among(low >> np.uint64(32 - bits), known)]
            if above is not None:
                wide = block.windows(above)
                # an extended window can repeat only where the window at its start does
                wide = wide[_among(wide, places)]
                yield from _send_smallest(block, name, level, above, bits, wide)
                continue
            h = window_hashes(block.hashes, level)[places]
            r = (h >> np.uint64(64 - bits)).astype(np.int64)
            ids, out = block.ids[block.document(places)], []
            for k, i in _parts(r, np.argsort(r, kind="stable")):
                out.append((k, name, h[i].tobytes(), pack(places[i]), squeeze(ids[i])))
            yield from _rows(_SENT, out)

    return _with(blocks, answers).mapInArrow(run, _SENT_DDL)


def later(sent: DataFrame) -> DataFrame:
    """Of each block's candidate windows, the places of those that also start in a document with a smaller id."""

    def run(batches):
        for r, rows in _groups(batches, "r"):
            h = np.concatenate([np.frombuffer(x["v"], np.uint64) for x in rows])
            ids = np.concatenate([loosen(x["d"], np.int64) for x in rows])
            order = np.lexsort((ids, h))
            new = np.ones(len(h), bool)
            new[1:] = h[order][1:] != h[order][:-1]
            least = np.empty(len(h), np.int64)
            least[order] = ids[order][new][np.cumsum(new) - 1]
            gone, at, out = ids > least, 0, []
            for x in rows:
                places = unpack(x["p"])
                own = places[gone[at : at + len(places)]]
                at += len(places)
                if len(own):
                    out.append((x["block"], r, pack(own)))
            yield from _rows(_BACK, out)

    return sent.repartition("r").sortWithinPartitions("r").mapInArrow(run, _BACK_DDL)


def without(blocks: DataFrame, answers: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for _, rows in _groups(batches, "block"):
            if rows[0]["data"] is None:
                continue
            block = Block(rows[0]["data"], rows[0]["ids"], rows[0]["sizes"], None)
            step = np.zeros(int(block.counts.sum()) + 1, np.int64)
            for x in rows[1:]:
                places = unpack(x["v"]).astype(np.int64)
                np.add.at(step, places, 1)
                np.add.at(step, places + length, -1)
            gone = np.cumsum(step)[:-1] > 0
            kept, at, removed = [], 0, []
            for ws in block.split:
                own = gone[at : at + len(ws)]
                at += len(ws)
                removed.append(int(own.sum()))
                kept.append(b" ".join([ws[k] for k in np.flatnonzero(~own)] if removed[-1] else ws))
            ids = [int(i) if k else None for i, k in zip(block.ids, block.known, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(block.counts), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return _with(blocks, answers).mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed and the text that is kept (words joined by one space)."""
    spark = docs.sparkSession
    blocks = blocks_of(docs, scratch_path(spark, "passages"))
    about = blocks.agg(F.sum("about")).first()[0] or 0
    bits = min(max((about // RANGE_WINDOWS).bit_length(), LEAST_BITS), MOST_BITS)
    steps = levels(length)
    if len(steps) == 1:
        raise ValueError("length must be over 8 words")
    answers = repeated(first_level(blocks, steps[0], steps[1], bits))
    for k in range(1, len(steps)):
        above = steps[k + 1] if k + 1 < len(steps) else None
        sent = next_level(blocks, answers, steps[k - 1], steps[k], above, bits)
        answers = later(sent) if above is None else repeated(sent)
    return without(blocks, answers, length)

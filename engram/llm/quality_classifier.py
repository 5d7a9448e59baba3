"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features are the words, word pairs, word forms (runs of lower case, upper case, digits; other marks kept) and pairs of
forms, each hashed to one of `2 ** bits` weights; a pair of equal words also counts as a feature of its own. A text's
score is the sparse dot product of its feature frequencies with the weights.

Training reads a bounded sample of labelled rows (`max_rows`), picked by a hash of the id, so that its cost and the size
of the model don't grow with the corpus. The sample is dealt to `shards` tasks, each runs the updates over its rows, and
the weights are averaged; every weight vector has the fixed size `2 ** bits`. Scoring reads every text once, without a
shuffle. Labels, language, source and id are never inputs of a score.

Null and empty texts have no features and get the score of the bias alone. Rows without an id or without a label are
scored but never learned from; repeated labels of one id are reduced to the largest. With no usable label at all every
score is 0.5. Repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import Words, as_bytes, map_slices, mix, slices, word_hash

BITS, MAX_ROWS, SHARDS, EPOCHS = 18, 16_000, 4, 3
ALPHA, BETA, L1, L2, SCALE = 0.3, 1.0, 0.02, 0.1, 20.0
SLICE = 1 << 20  # bytes of text whose features a task holds at a time
THRESHOLD = 0.7

_FORM = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


def word_form(word: bytes) -> bytes:
    return _RUN.sub(rb"\1", word.translate(_FORM))


class Features:
    """Feature numbers of texts; one per task, for its word tables."""

    def __init__(self, bits: int):
        self.words = Words(word_hash, lambda w: word_hash(word_form(w), seed=7))
        self.mask = np.uint64((1 << bits) - 1)

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the features of all texts in a row, and how many each text has."""
        split = [t.split() if t else [] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        numbers = self.words.numbers([w for ws in split for w in ws])
        if not len(numbers):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        word, form = (t[numbers] for t in self.words.tables)
        ends = np.zeros(len(numbers), bool)
        ends[np.cumsum(counts)[counts > 0] - 1] = True
        after = np.roll(numbers, -1)
        odd = np.uint64(0x9E3779B97F4A7C15)
        # the last word of a text is paired with an end mark
        pair = np.where(ends, mix(word + odd), mix(word * odd + np.roll(word, -1)))
        forms = np.where(ends, mix(form + odd), mix(form * odd + np.roll(form, -1)))
        same = np.where(~ends & (after == numbers), np.uint64(11), np.uint64(12))
        out = np.stack([mix(word + np.uint64(1)), mix(pair + np.uint64(2)), mix(form + np.uint64(3)), mix(forms + np.uint64(4)), mix(same)], axis=1)
        return (out & self.mask).astype(np.int64).ravel(), counts * 5


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept for measuring."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bits: int = BITS, max_rows: int = MAX_ROWS, shards: int = SHARDS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last one is the bias), from labelled rows that aren't held out."""
    usable = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y is not null")
    usable = usable.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y"))
    n = usable.count()
    place = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 20))
    # at most max_rows rows in the mean; the margin keeps the broadcast below twice that
    sample = usable.where(place < int((1 << 20) * min(1.0, max_rows / max(n, 1)))).withColumn("_shard", F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int"))
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(sample), "_id")

    def count(batches):
        features = Features(bits)
        for b in batches:
            flat, sizes = features(as_bytes(b.column("text")))
            at, n, x = 0, [], []
            for k in sizes:
                i, c = np.unique(flat[at : at + k], return_counts=True)
                at += k
                n.append(i.astype(np.int32).tobytes())
                x.append((c * (SCALE / max(k, 1))).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("_shard"), b.column("_id"), b.column("_y"), pa.array(n, pa.binary()), pa.array(x, pa.binary())], names=["_shard", "_id", "_y", "i", "x"])

    vectors = map_slices(rows, count, "_shard int, _id bigint, _y int, i binary, x binary", limit=SLICE)
    vectors = vectors.repartition(shards, "_shard").sortWithinPartitions("_shard", F.xxhash64("_id"))

    def follow(batches):
        shard, seen = None, []
        for b in batches:
            for s, y, i, x in zip(*(b.column(c).to_pylist() for c in ("_shard", "_y", "i", "x")), strict=True):
                if s != shard and seen:
                    yield _blob(seen, bits, epochs)
                    seen = []
                shard = s
                seen.append((y, np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)))
        if seen:
            yield _blob(seen, bits, epochs)

    found = vectors.mapInArrow(follow, "n long, w binary").collect()  # one row of fixed size per shard
    if not found:
        return np.zeros((1 << bits) + 1, np.float32)
    total = sum(r.n for r in found)
    return (sum(np.frombuffer(r.w, np.float32).astype(np.float64) * r.n for r in found) / total).astype(np.float32)


def _blob(seen: list, bits: int, epochs: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([len(seen)], pa.int64()), pa.array([leader(seen, bits, epochs).tobytes()], pa.binary())], names=["n", "w"])


def leader(rows: list, bits: int, epochs: int) -> np.ndarray:
    """Weights after `epochs` passes of per-coordinate follow-the-regularised-leader over (label, features, values)."""
    size = (1 << bits) + 1
    z, n, bias = np.zeros(size), np.zeros(size), np.array([size - 1], np.int32)

    def weights(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for y, i, x in rows:
            i, x = np.concatenate([i, bias]), np.append(x.astype(np.float64), 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - (y > 0)) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(size)).astype(np.float32)


def with_score(docs: DataFrame, weights: np.ndarray, name: str, bits: int = BITS) -> DataFrame:
    """`docs` with the score of each text in column `name`."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 2 ** bits numbers, whatever the corpus

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features, w = Features(bits), sent.value.astype(np.float64)
        for column in batches:
            done = []
            for part in slices([pa.RecordBatch.from_arrays([column], names=["text"])], "text", SLICE):
                flat, sizes = features(as_bytes(part.column("text")))
                sums = np.concatenate([[0.0], np.cumsum(w[flat])])
                ends = np.cumsum(sizes)
                done.append(1 / (1 + np.exp(-((sums[ends] - sums[ends - sizes]) * SCALE / np.maximum(sizes, 1) + w[-1]))))
            yield pa.array(np.concatenate(done) if done else np.zeros(0), pa.float64())

    return docs.withColumn(name, score(F.col("text").cast("string")))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score and verdict: doc_id, held_out, score, predicted."""
    weights = train(docs, labels)
    scored = with_score(docs.select("doc_id", "text"), weights, "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("score"), (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    name = "_llm_score"
    while name in docs.columns:
        name += "_"
    return with_score(docs, train(docs, labels), name).where(F.col(name) >= THRESHOLD).drop(name)

"""Near-duplicates by min-max hashing, confirmed on whole shingle sets.

A document's set holds its distinct five-word shingles (fewer words: the whole sequence). Two documents are linked when
100 * intersection >= 85 * union. Under each of 160 permutations both the smallest and the largest hash are kept, so 320
signature values cost 160 evaluations; each is equal in two sets with the probability of their similarity. Forty bands
of eight values make the buckets: a pair at 0.85 shares none with a probability of about 3e-6.

1. Equal sets are one class, led by its smallest id; only leaders go on, so a group of any number of copies is one row.
2. In every bucket each member is compared with the bucket's smallest id. Pairs whose signatures agree far less than a
   linked pair's would (`CUT`, four standard deviations below) are left out, the others are confirmed on the texts.
3. The links give components. Buckets that still span several components are searched for links across them, in blocks
   of at most about `BLOCK` x `BLOCK` members (fewer of long texts), whatever the bucket's size. A pair is looked at in
   the first band it shares, the cut is applied, the whole sets are compared, and only links that join components of the
   block leave it: fewer than it has members. A link inside a component can't change the result and isn't needed.

Rows without words or text have an empty set and are linked with nothing; rows without an id are linked with nothing and
kept, their component is null. An id names one document: of rows that share an id but not a text each gets the component
of its own set, and only one of the sets that such an id leads is compared further. Repeated rows have equal sets. An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import LOWER, Words, as_bytes, components, map_slices, mix, window_hashes, word_hash
from engram.session import materialise, scratch_path

SHINGLE, PERMUTATIONS, ROWS = 5, 160, 8
BANDS = 2 * PERMUTATIONS // ROWS
PERCENT = 85
CUT = 0.77
BLOCK, BLOCK_SHINGLES = 512, 1_000_000

_RNG = np.random.Generator(np.random.PCG64(20_011))
_FACTOR = _RNG.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
_SHIFT = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)[:, None]


class Shingles:
    """Sorted distinct shingle hashes of texts; one per task, for its word table."""

    def __init__(self):
        self.words = Words(word_hash)

    def __call__(self, texts: list) -> list[np.ndarray]:
        split = [t.translate(LOWER).split() if t else [] for t in texts]
        hashes = self._hashes([w for ws in split for w in ws])
        out, at = [], 0
        for ws in split:
            h = hashes[at : at + len(ws)]
            at += len(ws)
            out.append(np.unique(window_hashes(h, min(SHINGLE, len(h)))) if len(h) else h)
        return out

    def _hashes(self, flat: list) -> np.ndarray:
        numbers = self.words.numbers(flat)
        return self.words.tables[0][numbers]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest and largest value of every permutation: PERMUTATIONS minima, then as many maxima."""
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):  # a block that stays in the cache
        values = short[None, at : at + 512] * _FACTOR + _SHIFT
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A key for each band: of the band's number and its eight bytes of the sketch."""
    rows = np.ascontiguousarray(sketch).view("<u8")
    return mix(mix(np.arange(1, BANDS + 1, dtype=np.uint64)) + rows).view(np.int64)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), key (of the set), bands, sketch (one byte of each signature value)."""

    def run(batches):
        shingles = Shingles()
        for b in batches:
            sets = shingles(as_bytes(b.column("text")))
            values = [signature(s).astype(np.uint8) if len(s) else None for s in sets]
            bands = [None if v is None else band_keys(v) for v in values]
            offsets = np.cumsum([0, *(0 if x is None else BANDS for x in bands)])
            flat = np.concatenate([x for x in bands if x is not None] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64())),
                pa.array([None if v is None else v.tobytes() for v in values], pa.binary()),
            ], names=["doc_id", "n", "key", "bands", "sketch"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_slices(rows, run, "doc_id bigint, n bigint, key binary, bands array<bigint>, sketch binary")


def _alike(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2 * PERMUTATIONS)


def likely(pairs: DataFrame, leaders: DataFrame) -> DataFrame:
    """The pairs whose sizes and signatures allow a link."""
    side = lambda x: leaders.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                agree = (_sketches(b.column("s_a")) == _sketches(b.column("s_b"))).mean(axis=1)
                keep = (agree >= CUT) & _alike(b.column("n_a").to_numpy(), b.column("n_b").to_numpy())
                yield b.select(["a", "b"]).filter(pa.array(keep))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; `texts` has rep and text."""

    def run(batches):
        shingles, last, own = Shingles(), None, None
        for b in batches:
            keep = []
            for y, text_a, text_b in zip(b.column("b").to_pylist(), as_bytes(b.column("text_a")), as_bytes(b.column("text_b")), strict=True):
                if y != last:  # rows come sorted by b
                    last, own = y, shingles([text_b])[0]
                other = shingles([text_a])[0]
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(own) + len(other) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    return map_slices(both.select("a", "b", "text_a", "text_b"), run, "a bigint, b bigint", text="text_a")


def across(members: DataFrame) -> DataFrame:
    """Links between components within buckets: `members` has key, band, rep, label, n, sketch, text, size and most (of the bucket: members, and shingles of the largest)."""
    block = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.lit(BLOCK_SHINGLES) / F.col("most")))
    parts = members.withColumn("k", F.ceil(F.col("size") / block).cast("int"))
    parts = parts.withColumn("c", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    parts = parts.select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "band", "rep", "label", "n", "sketch", "text")
    parts = parts.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")

    def run(batches):
        held, at = [], None
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("key", "i", "j")), strict=True))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if keys[s] != at and held:
                    yield from _joining(held)
                    held = []
                at = keys[s]
                held.append(b.slice(s, e - s))
        if held:
            yield from _joining(held)

    return map_slices(parts, run, "a bigint, b bigint").distinct()


def _joining(held: list):
    """Links that join components of one block."""
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    c, i, j, rep, label, n, band = (rows.column(x).to_numpy() for x in ("c", "i", "j", "rep", "label", "n", "band"))
    sketch, texts = _sketches(rows.column("sketch")), rows.column("text").cast(pa.binary())
    shingles, sets, found = Shingles(), {}, []
    label = label.copy()
    right = np.flatnonzero(c == j)

    def whole(x):
        if x not in sets:
            sets[x] = shingles([texts[x].as_py()])[0]
        return sets[x]

    for x in np.flatnonzero(c == i):
        y = right[rep[right] < rep[x]] if i[0] == j[0] else right
        y = y[(label[y] != label[x]) & _alike(n[y], n[x])]
        if not len(y):
            continue
        agree = sketch[y] == sketch[x]
        first = agree.reshape(len(y), BANDS, ROWS).all(axis=2).argmax(axis=1)
        share = agree.mean(axis=1)
        keep = np.flatnonzero((first == band[x]) & (share >= CUT))
        for z in y[keep[np.argsort(-share[keep])]]:
            if label[z] != label[x]:
                common = len(np.intersect1d(whole(x), whole(z), assume_unique=True))
                if 100 * common >= PERCENT * (n[x] + n[z] - common):
                    found.append((max(rep[x], rep[z]), min(rep[x], rep[z])))
                    label[label == label[z]] = label[x]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([int(p[k]) for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept."""
    spark = docs.sparkSession
    path = scratch_path(spark, "minhash")
    features(docs).write.parquet(path)
    rows = spark.read.parquet(path)
    classes = materialise(rows.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep")))
    leaders = rows.join(classes.select("rep", F.col("key").alias("_key")), (F.col("doc_id") == F.col("rep")) & (F.col("key") == F.col("_key")))
    leaders = leaders.select("rep", "n", "bands", "sketch").dropDuplicates(["rep"])
    leaders_path = scratch_path(spark, "minhash-leaders")
    leaders.write.parquet(leaders_path)
    leaders = spark.read.parquet(leaders_path)

    bands = leaders.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("first"), F.max("n").alias("most")).where("size > 1")
    members = materialise(bands.join(buckets, "key").select("key", "band", "rep", "size", "most", "first"))
    wanted = members.groupBy("rep").agg(F.count("*").alias("_n"))
    text_path = scratch_path(spark, "minhash-texts")
    docs.select(F.col("doc_id").cast("bigint").alias("rep"), F.col("text").cast("string").alias("text")).join(wanted, "rep").select("rep", "text").dropDuplicates(["rep"]).write.parquet(text_path)
    texts = spark.read.parquet(text_path)

    stars = members.where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()
    near = components(confirmed(likely(stars, leaders), texts))

    named = members.join(near, members.rep == near.node, "left").select("key", "band", "rep", "size", "most", F.coalesce("label", "rep").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("key")
    rest = named.join(mixed, "key").join(leaders.select("rep", "n", "sketch").join(texts, "rep"), "rep")
    more = across(rest)
    label = lambda x: near.select(F.col("node").alias(x), F.col("label").alias(f"l_{x}"))
    links = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b"))
    merged = components(links).select(F.col("node").alias("_n2"), F.col("label").alias("_l2"))

    known = classes.join(near, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("label", "rep").alias("_l1"))
    known = known.join(merged, F.col("_l1") == F.col("_n2"), "left").select("key", F.coalesce("_l2", "_l1").alias("component"))
    out = rows.select("doc_id", "n", "key").join(known, "key", "left")
    component = F.coalesce(F.col("component"), F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those that a smaller id of their component stands for; one row per id, all columns."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_llm_gone")).distinct()
    alone = "_llm_alone"
    while alone in docs.columns:
        alone += "_"
    left = docs.join(gone, docs["doc_id"] == F.col("_llm_gone"), "left_anti")
    left = left.withColumn(alone, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    return left.dropDuplicates(["doc_id", alone]).drop(alone)

"""Quality rules: counts per text, and perplexity under an n-gram model of the corpus' own languages.

The model predicts each character of the running text from the four before it, across word ends (every white space between
words is one sign), with modified Kneser-Ney smoothing. Its counts come from every document, per language: the number of
documents that hold a gram of five characters, then the lower orders' continuation counts. Counts, discounts, shares and
the probability of every gram of the corpus are Spark tables of any size; only a language's discounts are gathered.

A gram that was counted once is mostly the scored document's own, so it has no share of its own when documents are scored
and is as likely as its context's rest allows: garbled text can't teach the model to expect it.

The probabilities are sent out in parts by hash of at most about `PART_GRAMS` grams. A task sorts the distinct grams of a
slice of documents and looks them up part by part, holding one part at a time. No gram is cut off.

A document's log perplexity is its mean negative log probability per character. Each language has a band around the median
of its documents that pass the base rules: `BELOW` and `ABOVE` times the robust standard deviation of the lower and of the
upper half. Documents outside of it are rejected: text that is too surprising above, text that is too predictable below.

Null and empty texts have no words and fail the base rules. A null language is a language of its own. A half's deviation is
one `BIN` of the histogram at least, its resolution. Rows without an id and repeated rows are judged like others;
other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.common import Words, as_bytes, map_slices, mix, window_hashes, word_hash
from engram.session import materialise, scratch_path

ORDER = 5
BELOW, ABOVE, BIN = 5.0, 5.0, 0.001
PART_GRAMS, ROWS_PER_PART = 2_000_000, 500_000
MOST_LANGUAGES = 10_000  # bands that are broadcast
FEWEST_WORDS, MOST_REPEATED = 50, 50  # words; percent of words

_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(b for b in range(256) if b not in _SYMBOLS)
#: White space, and the bytes that continue a character: what is left has one byte per character.
_NOT_FIRST = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))
_START, _END = "\x02", "\x03"


def text_counts(text: bytes, hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text whose words have these hashes."""
    seen, same = set(), 0
    for line in text.split(b"\n"):
        if line.split(None, 1):
            same += line in seen
            seen.add(line)
    triples = window_hashes(hashes, 3)
    repeated = 0
    if len(triples):
        _, which, counts = np.unique(triples, return_inverse=True, return_counts=True)
        at = np.flatnonzero(counts[which] > 1)
        covered = np.zeros(len(hashes), bool)
        for k in range(3):
            covered[at + k] = True
        repeated = int(covered.sum())
    return len(hashes), len(text.translate(None, _NOT_FIRST)), len(text.translate(None, _NOT_SYMBOL)), same, repeated


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < FEWEST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def running(words: list, order: int = ORDER) -> str:
    """The words as one text with a sign after each, padded at its start."""
    return _START * (order - 1) + _END.join(w.decode("utf-8", "replace") for w in words) + _END


def places_of(texts: list, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the running texts one after the other, where grams start in them, and how many each text has."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    inside = np.ones(len(codes), bool)
    for k in range(order - 1):  # grams that would reach into the next text
        inside[np.cumsum(sizes) - 1 - k] = False
    return codes, np.flatnonzero(inside), sizes - (order - 1)


def numbered(texts: list, language: str, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of the running texts' grams, the number of each place's one, one gram of each, and grams per text."""
    codes, at, sizes = places_of(texts, order)
    grams = np.lib.stride_tricks.sliding_window_view(codes, order)
    found = pa.array(gram_hashes(grams, language)[at]).dictionary_encode()
    which = found.indices.to_numpy()
    one = np.empty(len(found.dictionary), np.int64)
    one[which] = at
    return found.dictionary.to_numpy(), which, grams[one], sizes


def grams_of(words: list, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Code points of every gram of the words as one running text, and the number of the word each predicts a character of."""
    codes, at, _ = places_of([running(words, order)], order)
    return np.lib.stride_tricks.sliding_window_view(codes, order)[at], np.repeat(np.arange(len(words)), [len(w.decode("utf-8", "replace")) + 1 for w in words])


def gram_hashes(grams: np.ndarray, language: str) -> np.ndarray:
    h = np.full(len(grams), word_hash(language.encode(), seed=grams.shape[1]), np.uint64)
    for k in range(grams.shape[1]):
        h = h * np.uint64(0x9E3779B97F4A7C15) + grams[:, k] + np.uint64(1)
    return mix(h)


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """language, gram (UTF-32 code points), c: how many documents hold it."""

    def run(batches):
        for b in batches:
            languages, texts = b.column("language").to_pylist(), as_bytes(b.column("text"))
            for language in sorted(set(languages)):
                own = [running(w, order) for w in (t.split() for x, t in zip(languages, texts, strict=True) if x == language and t) if w]
                if not own:
                    continue
                _, which, grams, sizes = numbered(own, language, order)
                ends = np.cumsum(sizes)
                which = np.concatenate([np.sort(which[e - n : e]) for e, n in zip(ends, sizes, strict=True)])
                new = np.ones(len(which), bool)  # once a document
                new[1:] = which[1:] != which[:-1]
                new[ends[:-1]] = True
                c = np.bincount(which[new], minlength=len(grams))
                data = pa.py_buffer(np.ascontiguousarray(grams).tobytes())
                fixed = pa.Array.from_buffers(pa.binary(4 * order), len(grams), [None, data]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(grams), pa.string()), fixed, pa.array(c.astype(np.int64))], names=["language", "gram", "c"])

    return map_slices(docs, run, "language string, gram binary, c bigint", limit=8 << 20).groupBy("language", "gram").agg(F.sum("c").alias("c"))


class Model:
    """A table per order: language, gram, c, context, share (discounted), left (what the context leaves to the order below)."""

    def __init__(self, order: int):
        self.order, self.tables = order, {}

    def log_probabilities(self, grams: np.ndarray, language: str) -> np.ndarray:
        """Of a few grams, seen or not."""
        size = self.tables[1].where(F.col("language") == language).count()
        p = np.full(len(grams), 1.0 / max(size, 1))
        for k in range(1, self.order + 1):
            own = [g.tobytes() for g in np.ascontiguousarray(grams[:, self.order - k :])]
            rows = self.tables[k].where(F.col("language") == language)
            share = {bytes(r.gram): r.share for r in rows.where(F.col("gram").isin(sorted(set(own)))).collect()}
            left = {bytes(r.context): r.left for r in rows.where(F.col("context").isin(sorted({g[:-4] for g in own}))).select("context", "left").distinct().collect()}
            p = np.array([share.get(g, 0.0) for g in own]) + np.array([left.get(g[:-4], 1.0) for g in own]) * p
        return np.log(np.maximum(p, 1e-12))

    def probabilities(self) -> DataFrame:
        """language, gram, p of every gram of the highest order; grams counted once have no share of their own."""
        one = F.count("*").over(Window.partitionBy("language"))  # a row per character
        known = self.tables[1].select("language", "gram", (F.col("share") + F.col("left") / one).alias("p"))
        for k in range(2, self.order + 1):
            below = known.select("language", F.col("gram").alias("suffix"), F.col("p").alias("low"))
            rows = self.tables[k].withColumn("suffix", F.expr("substring(gram, 5)")).join(below, ["language", "suffix"])
            known = rows.select("language", "gram", (F.when(F.col("c") > 1, F.col("share")).otherwise(0.0) + F.col("left") * F.col("low")).alias("p"))
        return known


def fit(docs: DataFrame, order: int = ORDER) -> Model:
    """The model of all documents of `docs` (columns language and text)."""
    spark, model, counts = docs.sparkSession, Model(order), count_grams(docs, order)
    for k in range(order, 0, -1):
        if k < order:  # continuation counts: before how many different grams it stands
            counts = counts.groupBy("language", F.expr("substring(gram, 5)").alias("gram")).agg(F.count("*").alias("c"))
        counts = materialise(counts)
        counts = counts.coalesce(1 + counts.count() // ROWS_PER_PART)  # a small table in many parts costs files, not work
        kinds = counts.groupBy("language").agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()  # a row per language
        less = spark.createDataFrame([(r.language, *discounts(r.n1, r.n2, r.n3, r.n4)) for r in kinds], "language string, d1 double, d2 double, d3 double")
        rows = counts.join(F.broadcast(less), "language").withColumn("context", F.expr(f"substring(gram, 1, {4 * (k - 1)})"))
        rows = rows.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        after = Window.partitionBy("language", "context")  # rows of a context: characters at most
        rows = rows.withColumn("total", F.sum("c").over(after)).withColumn("left", F.sum("d").over(after) / F.col("total"))
        model.tables[k] = materialise(rows.select("language", "gram", "c", "context", ((F.col("c") - F.col("d")) / F.col("total")).alias("share"), "left"))
    return model


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken off counts of one, two, and three or more, from how many grams have counts of one to four."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    pairs = ((1, n1, n2), (2, n2, n3), (3, n3, n4))
    return tuple(min(max(i - (i + 1) * y * (b / a), 0.0), float(i)) if a else i / 2 for i, a, b in pairs)


def sent_out(model: Model) -> tuple[int, list]:
    """Bits of a hash that number its part, and each part sent to the executors: sorted hashes and log probabilities."""

    def hashed(batches):
        for b in batches:
            languages, grams = b.column("language").to_pylist(), b.column("gram").to_pylist()
            codes = np.frombuffer(b"".join(grams), np.uint32).reshape(len(grams), model_order)
            h = np.zeros(len(grams), np.uint64)
            for language in set(languages):
                at = np.array([x == language for x in languages])
                h[at] = gram_hashes(codes[at], language)
            p = np.log(np.maximum(b.column("p").to_numpy(), 1e-12)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(p)], names=["h", "p"])

    model_order, n = model.order, model.tables[model.order].count()
    spark, bits, parts = model.tables[1].sparkSession, int(n // PART_GRAMS).bit_length(), []
    path = scratch_path(spark, "grams")
    known = model.probabilities().mapInArrow(hashed, "h bigint, p float")
    part = F.expr(f"shiftrightunsigned(h, {64 - bits})") if bits else F.lit(0).cast("bigint")
    known.coalesce(1 + n // ROWS_PER_PART).withColumn("part", part).write.partitionBy("part").parquet(path) if n else None
    for k in range(1 << bits if n else 0):  # one at a time passes through the driver
        rows = spark.read.parquet(path).where(F.col("part") == k).select("h", "p").toArrow()
        h, p = rows.column("h").to_numpy().view(np.uint64), rows.column("p").to_numpy()
        at = np.argsort(h)
        parts.append(spark.sparkContext.broadcast((h[at], p[at])))
    return bits, parts


def looked_up(h: np.ndarray, bits: int, parts: list) -> np.ndarray:
    """Log probabilities of sorted hashes."""
    out = np.empty(len(h), np.float64)
    ends = np.searchsorted(h >> np.uint64(64 - bits), np.arange(1, len(parts)).astype(np.uint64)) if bits else []
    for part, a, b in zip(parts, [0, *ends], [*ends, len(h)], strict=True):
        if a < b:
            have, p = part.value
            at = np.minimum(np.searchsorted(have, h[a:b]), len(have) - 1)
            if not (have[at] == h[a:b]).all():
                raise ValueError("a gram that the model was not fitted on")
            out[a:b] = p[at]
            if bits:  # the next part takes its place
                del have, p
                part.__dict__.pop("_value", None)
    return out


def with_perplexity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, language, the counts of each text and log_perplexity (null without words)."""
    order, (bits, parts) = model.order, sent_out(model)

    def run(batches):
        words = Words(word_hash)
        for b in batches:
            texts = [t or b"" for t in as_bytes(b.column("text"))]
            split, languages = [t.split() for t in texts], b.column("language").to_pylist()
            hashes = words.values([w for ws in split for w in ws])
            ends = np.cumsum([0, *map(len, split)])
            counts = [text_counts(t, hashes[i:j]) for t, i, j in zip(texts, ends, ends[1:], strict=False)]
            surprise = [None] * len(texts)
            for language in set(languages):
                own = [k for k, x in enumerate(languages) if x == language and split[k]]
                if own:
                    h, which, _, sizes = numbered([running(split[k], order) for k in own], language, order)
                    at, logs = np.argsort(h), np.empty(len(h))
                    logs[at] = looked_up(h[at], bits, parts)
                    logs = logs[which]
                    sums = np.add.reduceat(logs, np.cumsum(sizes) - sizes) / sizes
                    for k, x in zip(own, sums.tolist(), strict=True):
                        surprise[k] = -x
            columns = list(zip(*counts, strict=True))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("language"), *(pa.array(c, pa.int64()) for c in columns), pa.array(surprise, pa.float64())], names=_NAMES)

    return map_slices(docs, run, "doc_id bigint, language string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, log_perplexity double")


_NAMES = ["doc_id", "language", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity"]


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, log_perplexity, kept."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("language"), F.col("text").cast("string").alias("text"))
    scored = materialise(with_perplexity(rows, fit(rows.select("language", "text"))).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))))
    bins = scored.where("not base_failed and log_perplexity is not null").groupBy("language", F.round(F.col("log_perplexity") / BIN).alias("bin")).agg(F.count("*").alias("n"))
    low, middle, high = (F.expr(f"percentile(bin, {q}, n)") * BIN for q in (0.25, 0.5, 0.75))  # of a histogram of some thousand bins
    half = lambda width: F.greatest(width / 0.6745, F.lit(BIN))
    bands = bins.groupBy("language").agg((middle - BELOW * half(middle - low)).alias("least"), (middle + ABOVE * half(high - middle)).alias("most"))
    inside = F.col("log_perplexity").between(F.col("least"), F.col("most"))
    bands = materialise(bands)
    few = bands.count() <= MOST_LANGUAGES  # a row per language; beyond that Spark picks the join
    out = scored.join(F.broadcast(bands) if few else bands, "language", "left")
    return out.select(*[c for c in _NAMES if c not in ("language", "log_perplexity")], "base_failed", "log_perplexity", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))

"""Fill-in-middle transformation: texts are cut at token borders and put in prefix-suffix-middle or suffix-prefix-middle order.

The borders of a text are kept in a set laid out like a Roaring bitmap: offsets with the same upper bits share a container
of 2^16 places, which is a sorted array of 16-bit numbers (up to 4096 of them), a bitmap of 8 kB, or a list of runs,
whichever is smallest; the containers' cumulative cardinalities stand beside them. Drawing the k-th border is a binary
search over the cardinalities and a select within one container, so a cut costs the same wherever it falls, and the set
stays small for a text of any length.

Units are white space followed by anything else, or white space at the end; their borders are in code points. The draws
come from a hash of the seed and the document's number, so they are the same on every executor and after every retry.
Texts that hold one of the marks, and those not drawn, stay plain. `restore` gives the exact text back from output and form.

Null texts count as empty, which stay plain. A null id is hashed as no digits. Rows that share an id are cut by the same
draws, repeated rows give the same row. An empty table gives no rows, other columns are ignored. Each row is treated on its
own, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from engram.llm.common import map_slices

P, S, M = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80  # of 100 texts 50 are cut, of 100 of those 80 are suffix first
SPAN, MOST_LISTED = 1 << 16, 4096


class Sparse:
    """Sorted 16-bit numbers."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])

    def nbytes(self) -> int:
        return self.low.nbytes


class Bits:
    """A bit for each of 2^16 places, with the number of set bits before each word of 64."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        counts = bits.reshape(-1, 64).sum(1, dtype=np.int64)
        self.before = np.cumsum(counts) - counts

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        left = int(self.words[word])
        for _ in range(k - int(self.before[word])):
            left &= left - 1  # drop the lowest set bit
        return 64 * word + (left & -left).bit_length() - 1

    def nbytes(self) -> int:
        return self.words.nbytes


class Runs:
    """Runs of consecutive numbers: their starts, and how many numbers lie before each."""

    def __init__(self, low: np.ndarray):
        first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        self.start, self.before = low[first].astype(np.uint16), first

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.start[run]) + k - int(self.before[run])

    def nbytes(self) -> int:
        return 4 * len(self.start)


def _container(low: np.ndarray):
    runs = int((np.diff(low) != 1).sum()) + 1
    if 4 * runs < min(2 * len(low), SPAN // 8):
        return Runs(low)
    return Sparse(low) if len(low) <= MOST_LISTED else Bits(low)


class BoundarySet:
    """A set of offsets in ascending order, with selection by rank."""

    def __init__(self, offsets: np.ndarray):
        offsets = np.asarray(offsets, np.int64)
        high = offsets >> 16
        first = np.flatnonzero(np.diff(high, prepend=-1))
        ends = np.append(first[1:], len(offsets))[: len(first)]
        self.high = high[first].tolist()
        self.containers = [_container(offsets[a:b] & (SPAN - 1)) for a, b in zip(first, ends, strict=True)]
        self.upto = list(accumulate((int(b - a) for a, b in zip(first, ends, strict=True)), initial=0))

    def __len__(self) -> int:
        return self.upto[-1]

    def select(self, k: int) -> int:
        """The offset with k smaller ones."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = bisect_right(self.upto, k) - 1
        return (self.high[at] << 16) + self.containers[at].select(k - self.upto[at])


def boundaries(text: str) -> BoundarySet:
    """The ends of the text's units."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    white = (points == 32) | ((points >= 9) & (points <= 13))
    last = np.empty(len(points), bool)  # a unit ends where other characters do, and with the text
    last[:-1] = ~white[:-1] & white[1:]
    last[-1:] = True
    return BoundarySet(np.flatnonzero(last) + 1)


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4]) for k in (0, 4, 8, 12)]


def transform(text: str, h: list[int], rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[str, str, int, int | None, int | None]:
    """Output, form, number of units, and the lengths of prefix and middle (None if plain)."""
    borders = boundaries(text)
    n = len(borders)
    if not text or P in text or S in text or M in text or h[2] % 100 >= rate:
        return text, "plain", n, None, None
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (borders.select(k - 1) if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_rate:
        return f"{S}{suffix}{P}{prefix}{M}{middle}", "spm", n, len(prefix), len(middle)
    return f"{P}{prefix}{S}{suffix}{M}{middle}", "psm", n, len(prefix), len(middle)


def restore(output: str, form: str) -> str:
    """The text of an output. A text that was cut holds no mark, so the first place of each mark is the one that was set."""
    if form == "plain":
        return output
    one, two = (P, S) if form == "psm" else (S, P)
    first, rest = output[len(one) :].split(two, 1)
    second, middle = rest.split(M, 1)
    return first + middle + second if form == "psm" else second + middle + first


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output."""
    return _mapped(docs, seed, rate, spm_rate, "output string", lambda out, form: [out])


def round_trip(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """As `fill_in_middle`, with digests of the output and of the text restored from it instead of the output."""

    def sha(t: str) -> str:
        return hashlib.sha256(t.encode()).hexdigest()

    return _mapped(docs, seed, rate, spm_rate, "output_sha256 string, restored_sha256 string", lambda out, form: [sha(out), sha(restore(out, form))])


def _mapped(docs: DataFrame, seed: int, rate: int, spm_rate: int, columns: str, finish) -> DataFrame:
    schema = f"doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, {columns}"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").cast(pa.int64())
            rows = []
            for i, text in zip(ids.to_pylist(), b.column("text").cast(pa.string()).to_pylist(), strict=True):
                out, form, n, prefix, middle = transform(text or "", draws(i, seed), rate, spm_rate)
                rows.append((n, form, prefix, middle, *finish(out, form)))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * (len(names) - 5)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *columns], names)

    return map_slices(docs.select("doc_id", "text"), run, schema)

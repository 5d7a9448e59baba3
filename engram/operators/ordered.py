"""Ordered scans that stay balanced when one key holds most of the rows.

`Window.partitionBy(key)` sends a whole key to one task. Here the rows are range partitioned on (keys, order) instead, so a
hot key is spread over many sorted *runs*. A prefix scan in two phases follows:

1. Every run is read once, in order, where it lies: prefix values per key, from the rows of the run alone. The run's first
   row and its last row are marked; the last one carries what the run knows about its last key.
2. A run can only continue the key that ended the run before it, so two rows per run are enough to find what it has to be
   given: the carry table has one row per run, which makes its broadcast safe.

The range exchange is the only one that moves rows. Columns that the scan doesn't need can stay out of it (`carry`) and are
joined back by keys and order.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from engram.session import materialise


@dataclass(frozen=True)
class Prefix:
    """A value computed from the rows before the current one within its key."""

    kind: str  # lag | count | sum | max | last
    col: str | None = None

    def type(self, df: DataFrame) -> T.DataType:
        if self.kind == "count":
            return T.LongType()
        own = df.schema[self.col].dataType
        if self.kind == "sum":
            if not isinstance(own, (T.IntegralType, T.DoubleType, T.FloatType)):
                raise ValueError(f"sums are taken of whole or real numbers, not of {own.simpleString()}")
            return T.DoubleType() if isinstance(own, (T.DoubleType, T.FloatType)) else T.LongType()
        return own

    def fold(self, tail: str, earlier) -> Column:
        """What the tails of the earlier runs of a key say together."""
        if self.kind in ("count", "sum"):
            return F.sum(tail).over(earlier)
        if self.kind == "max":
            return F.max(tail).over(earlier)
        if self.kind == "lag":
            return F.last(F.when(F.col("_tail"), F.struct(F.col(tail).alias("v"))), ignorenulls=True).over(earlier)["v"]
        return F.last(tail, ignorenulls=True).over(earlier)

    def merge(self, local: Column, carry: Column) -> Column:
        if self.kind == "count":
            return local + F.coalesce(carry, F.lit(0))
        if self.kind == "sum":
            return F.when(local.isNull() & carry.isNull(), None).otherwise(
                F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
            )
        if self.kind == "max":
            return F.greatest(local, carry)
        if self.kind == "lag":
            return F.when(F.col("_nth") == 0, carry).otherwise(local)
        return F.coalesce(local, carry)


def lag(col: str) -> Prefix:
    return Prefix("lag", col)


def rows_before() -> Prefix:
    return Prefix("count")


def sum_before(col: str) -> Prefix:
    return Prefix("sum", col)


def max_before(col: str) -> Prefix:
    return Prefix("max", col)


def last_before(col: str) -> Prefix:
    """Last non-null value before the row."""
    return Prefix("last", col)


def sorted_runs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Range partition and sort by `cols`; adds `_run`, the number of the run.

    The range bounds are sampled, so the result is checkpointed: every later use must see the same runs.
    `cols` should end in a unique column, otherwise equal rows cannot be split between runs.
    """
    return materialise(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_run", F.spark_partition_id()))


# ---------------------------------------------------------------- one run, batch by batch


def _changes(batch: pa.RecordBatch, keys: Sequence[str], before: list) -> np.ndarray:
    """Whether each row's key differs from the row before it; `before` has the key of the row before the batch."""
    out = np.zeros(batch.num_rows, bool)
    for k, last in zip(keys, before, strict=True):
        col = batch.column(k)
        both = pa.concat_arrays([last, col])
        a, b = both.slice(0, len(col)), both.slice(1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out |= differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return out


def _dense(col: pa.Array, real: bool) -> tuple[np.ndarray, np.ndarray]:
    """Values with nulls as 0, and where values are."""
    there = col.is_valid().to_numpy(zero_copy_only=False)
    return pc.fill_null(col.cast(pa.float64() if real else pa.int64()), 0).to_numpy(zero_copy_only=False), there


class _Scan:
    """One output over the batches of a run. `state` is what holds after the last row, for the key of that row."""

    def __init__(self, prefix: Prefix, kind: pa.DataType):
        self.kind, self.col, self.type = prefix.kind, prefix.col, kind
        self.reset()

    def reset(self) -> None:
        self.state = pa.nulls(1, self.type)

    def step(self, batch: pa.RecordBatch, first: np.ndarray, nth: np.ndarray) -> pa.Array:
        """Values before each row. `first`: number of the row that starts each row's key in this batch, -1 if an earlier batch does."""
        n = batch.num_rows
        rows = np.arange(n)
        if self.kind == "count":
            self.state = pa.array([int(nth[-1]) + 1], self.type)
            return pa.array(nth, self.type)
        col = batch.column(self.col)
        if self.kind in ("lag", "last"):
            both = pa.concat_arrays([self.state, col])  # row i is number i + 1
            if self.kind == "lag":
                source, none, end = rows, first == rows, n
            else:
                latest = np.maximum.accumulate(np.where(col.is_valid().to_numpy(zero_copy_only=False), rows + 1, 0))
                source = np.concatenate([[0], latest[:-1]])
                none = source < first + 1  # from an earlier key
                end = int(latest[-1]) if latest[-1] >= first[-1] + 1 else -1
            out = both.take(pa.array(np.where(none, 0, source), pa.int64(), mask=none))
            self.state = both.slice(end, 1) if end >= 0 else pa.nulls(1, self.type)
            return out
        own = first >= 0
        before = self.state[0].as_py()
        if self.kind == "sum":
            values, there = _dense(col, pa.types.is_floating(self.type))
            seen = _counted(there.astype(np.int64), first)
            if pa.types.is_floating(self.type):
                total = _added(values, first)
            else:
                total = _counted(values, first)
            if before is not None:
                total, seen = np.where(own, total, total + before), np.where(own, seen, seen + 1)
            upto, any_ = total + values, seen + there
            self.state = pa.array([upto[-1].item() if any_[-1] else None], self.type)
            return pa.array(total, self.type, mask=seen == 0)
        return self._most(col, first, before)

    def _most(self, col: pa.Array, first: np.ndarray, before) -> pa.Array:
        out, best = [], before
        for i, (v, f) in enumerate(zip(col.to_pylist(), first.tolist(), strict=True)):
            if f == i:
                best = None
            out.append(best)
            if v is not None and (best is None or v > best):
                best = v
        self.state = pa.array([best], self.type)
        return pa.array(out, self.type)


def _counted(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of whole numbers before each row since its key's first row in the batch."""
    before = np.cumsum(values) - values
    return before - np.where(first >= 0, before[np.maximum(first, 0)], 0)


def _added(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The same for real numbers, added key by key, so that no other key's rounding gets in."""
    out = np.zeros(len(values))
    edges = np.flatnonzero(np.diff(first, prepend=first[0] - 1))
    for a, b in zip(edges, [*edges[1:], len(values)], strict=True):
        if b - a > 1:
            out[a + 1 : b] = np.cumsum(values[a : b - 1])
    return out


_MARKS = "_run int, _lead boolean, _head boolean, _tail boolean, _nth bigint, _copy bigint"


def _scanner(keys: Sequence[str], outputs: Mapping[str, Prefix], by: Sequence[str] = ()):
    """Marks of a row: run, whether its key is the run's first, whether it is the run's first or last row, its number within
    its key, and its number among rows that agree in all of `by`."""
    keys, names, by = list(keys), list(outputs), list(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        scans, held, before, lead, head, base, copies, twin = None, None, None, True, True, 0, 0, None

        def close(batch: pa.RecordBatch, tail: bool) -> pa.RecordBatch:
            """The batch with marks of the tail and what the run says of its last key, on its last row."""
            n = batch.num_rows
            last = np.zeros(n, bool)
            last[-1] = tail
            at = batch.schema.get_field_index("_tail")
            batch = batch.set_column(at, "_tail", pa.array(last))
            for name, s in zip(names, scans, strict=True):
                ends = pa.concat_arrays([pa.nulls(n - 1, s.type), s.state]) if tail else pa.nulls(n, s.type)
                batch = batch.append_column(f"_t_{name}", ends)
            return batch

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if scans is None:
                scans = [_Scan(outputs[x], _kind(outputs[x], batch.schema)) for x in names]
                before, twin = [batch.column(k).slice(0, 1) for k in keys], [batch.column(k).slice(0, 1) for k in by]
                fresh = True
            else:
                yield close(held, False)
                fresh = False
            changed = _changes(batch, keys, before)
            new = _changes(batch, by, twin) if by else np.ones(n, bool)
            if fresh:
                changed[0] = new[0] = True
            first, nth = _numbered(changed, base)
            _, copy = _numbered(new, copies)
            base, copies = int(nth[-1]) + 1, int(copy[-1]) + 1
            if fresh:
                leading = first == 0
            else:
                leading = (first < 0) & lead
            lead = bool(leading[-1])
            values = [s.step(batch, first, nth) for s in scans]
            marks = np.zeros(n, bool)
            marks[0], head = head, False
            before, twin = [batch.column(k).slice(n - 1, 1) for k in keys], [batch.column(k).slice(n - 1, 1) for k in by]
            held = pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, number, np.int32)), pa.array(leading), pa.array(marks), pa.array(np.zeros(n, bool)), pa.array(nth), pa.array(copy), *values],
                [*batch.schema.names, "_run", "_lead", "_head", "_tail", "_nth", "_copy", *[f"_l_{x}" for x in names]],
            )
        if held is not None:
            yield close(held, True)

    return run


def _numbered(starts: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's group starts in the batch (-1: in an earlier one, which has `base` rows of it), and its number in it."""
    rows = np.arange(len(starts))
    first = np.maximum.accumulate(np.where(starts, rows, -1))
    return first, rows - np.where(first >= 0, first, -base)


def _kind(prefix: Prefix, schema: pa.Schema) -> pa.DataType:
    if prefix.kind == "count":
        return pa.int64()
    own = schema.field(prefix.col).type
    return own if prefix.kind != "sum" else pa.float64() if pa.types.is_floating(own) else pa.int64()


# ---------------------------------------------------------------- the whole scan


def ordered_scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], outputs: Mapping[str, Prefix], carry: Sequence[str] | None = None
) -> DataFrame:
    """Add prefix values per key (of atomic type) in the given order (`order` should end in a unique column).

    `carry`: the columns that go through the sort besides keys, order and what the outputs read; None means all. The others
    (texts) are joined back by keys and order. Rows that agree in keys and order are taken in the order of a hash of the
    columns that are read; fully equal ones get the values of one another's places.
    """
    keys, order, names = list(keys), list(order), list(outputs)
    read = [outputs[n].col for n in names if outputs[n].col]
    through = df.columns if carry is None else list(dict.fromkeys([*keys, *order, *read, *carry]))
    rest = [c for c in df.columns if c not in through]
    tie = F.xxhash64(*read) if read else F.lit(0)
    narrow = df.select(*through, *([tie.alias("_tie")] if rest else []))
    by = [*keys, *order, *(["_tie"] if rest else [])]

    schema = T.StructType(narrow.schema.fields + T._parse_datatype_string(_MARKS).fields)
    for lead in ("_l_", "_t_"):
        for n in names:
            schema = schema.add(f"{lead}{n}", outputs[n].type(df))
    runs = materialise(narrow.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_scanner(keys, outputs, by if rest else ()), schema))

    # the first and the last row of every run: a run is given what the earlier tails of its first key add up to
    ends = runs.filter("_head OR _tail").select(
        "_run", F.explode(F.filter(F.array(
            F.when(F.col("_head"), F.struct(F.lit(0).alias("side"), *[F.lit(None).cast(outputs[n].type(df)).alias(f"_t_{n}") for n in names])),
            F.when(F.col("_tail"), F.struct(F.lit(1).alias("side"), *[F.col(f"_t_{n}") for n in names])),
        ), lambda x: x.isNotNull())).alias("e"), *keys,
    ).select("_run", *keys, "e.*").withColumn("_tail", F.col("side") == 1)
    by_run = (W.partitionBy(*keys) if keys else W).orderBy("_run", "side")
    earlier = by_run.rowsBetween(W.unboundedPreceding, -1)
    given = ends.select("_run", "side", *[outputs[n].fold(f"_t_{n}", earlier).alias(f"_c_{n}") for n in names]).filter("side = 0").drop("side")
    joined = runs.join(F.broadcast(given), "_run", "left")
    merged = [outputs[n].merge(F.col(f"_l_{n}"), F.when(F.col("_lead"), F.col(f"_c_{n}"))).alias(n) for n in names]
    if not rest:
        return joined.select(*df.columns, *merged)
    scanned = joined.select(*by, *[c for c in through if c not in by], "_copy", *merged)
    twins = not runs.filter("_copy > 0").isEmpty()
    return _back(df.withColumn("_tie", tie), scanned, by, rest, twins).select(*df.columns, *names)


def _back(df: DataFrame, scanned: DataFrame, by: list[str], rest: list[str], twins: bool) -> DataFrame:
    """The scanned rows with the columns that stayed out. Equal rows, if there are any, are numbered on this side too."""
    places = [f"_b{i}" for i in range(len(by))]
    wide = df.select(*[F.col(c).alias(p) for c, p in zip(by, places, strict=True)], *rest)
    same = F.lit(True)
    for c, p in zip(by, places, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(p))
    if twins:
        wide = wide.withColumn("_twin", F.row_number().over(W.partitionBy(*places).orderBy(F.lit(0))) - 1)
        same = same & (F.col("_copy") == F.col("_twin"))
    return scanned.join(wide, same)


def ordinals(df: DataFrame, order: Sequence[str], name: str = "ordinal", keys: Sequence[str] = (), carry: Sequence[str] | None = None) -> DataFrame:
    """0-based row number, over everything or within `keys`."""
    return ordered_scan(df, keys, order, {name: rows_before()}, carry)


def last_n_pairs(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, carry: Sequence[str]
) -> DataFrame:
    """Pair each row with the `n` rows before it in its key: columns of the earlier row are prefixed `prev_`.

    Rows are numbered, cut into buckets of `n` numbers, and joined with the bucket itself and the one after:
    every join group has at most n x 2n rows, so no key can become hot.
    """
    numbered = ordinals(df.select(*dict.fromkeys([*keys, *order, *carry])), order, "_rn", keys)
    bucket = F.floor(F.col("_rn") / n)
    current = numbered.withColumn("_bucket", bucket)
    earlier = numbered.select(
        *keys,
        *[F.col(c).alias(f"prev_{c}") for c in carry],
        F.col("_rn").alias("_prev_rn"),
        F.explode(F.array(bucket, bucket + 1)).alias("_bucket"),
    )
    gap = F.col("_rn") - F.col("_prev_rn")
    return (
        current.join(earlier, [*keys, "_bucket"])
        .filter((gap >= 1) & (gap <= n))
        .select(*keys, *[F.col(c) for c in dict.fromkeys([*carry, *order]) if c not in keys],
                *[f"prev_{c}" for c in carry], gap.alias("gap"))
    )

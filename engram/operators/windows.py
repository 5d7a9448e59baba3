"""Ordered operators. Everything that follows a key in order runs on `ordered.ordered_scan`.

Only keys, order and the columns an operator reads go through its sort. `carry` names others that go along (None: all);
the rest, texts among them, is joined back by keys and order, so a caller that needs no text selects it away first.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from engram.operators import ordered as o
from engram.functions.text import token_count


def significant_changes(ex: DataFrame, keys: Sequence[str] = ("source_file",), order: Sequence[str] = ("timestamp", "id"), v: float = 0.3, a: float = 0.3, carry: Sequence[str] | None = ()) -> DataFrame:
    """Keep rows that differ enough from the previous row of their file."""
    cur = F.struct(
        F.col("timestamp"), F.col("auteur"), F.try_element_at("tags_roget", F.lit(1)).alias("tag"),
        F.coalesce("emotion_valence", F.lit(0.0)).alias("val"),
        # a missing or zero activation counts as 0.5
        F.coalesce(F.nullif(F.col("emotion_activation"), F.lit(0.0)), F.lit(0.5)).alias("act"),
    )
    scanned = o.ordered_scan(ex.withColumn("_cur", cur), keys, order, {"_prev": o.lag("_cur")}, carry)
    c, p = F.col("_cur"), F.col("_prev")
    changed = (
        p.isNull() | (c["timestamp"] != p["timestamp"]) | (c["auteur"] != p["auteur"])
        | F.coalesce(c["tag"] != p["tag"], F.lit(False))
        | (F.abs(c["val"] - p["val"]) > v) | (F.abs(c["act"] - p["act"]) > a)
    )
    return scanned.filter(changed).drop("_cur", "_prev")


def token_offsets(ex: DataFrame, keys: Sequence[str] = ("conv_id",), order: Sequence[str] = ("turn",), count: str | None = None, carry: Sequence[str] | None = ()) -> DataFrame:
    """Token start and end of each exchange: the counts of the exchanges before it in its file."""
    counted = ex if count else ex.withColumn("token_count", token_count(F.col("text")))
    name = count or "token_count"
    out = o.ordered_scan(counted, keys, order, {"token_start": o.sum_before(name)}, carry)
    start = F.coalesce("token_start", F.lit(0)).cast("long")
    return out.withColumn("token_start", start).withColumn("token_end", start + F.col(name))


def carry_block_id(ex: DataFrame, order: Sequence[str] = ("batch", "id"), keys: Sequence[str] = (), carry: Sequence[str] | None = ()) -> DataFrame:
    """Highest block id seen before each row, so that a new batch continues the numbering."""
    return o.ordered_scan(ex, keys, order, {"last_gr_id": o.max_before("gr_id")}, carry)


def dedup_keep_first(seg: DataFrame, keys: Sequence[str] = ("timestamp", "source_origine"), order: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows with the lowest `order` per key, and the others. The lowest comes from an aggregate, not a window."""
    best = seg.groupBy(*keys).agg(F.min(order).alias("_best"))
    first = best.select(F.col("_best").alias(order))
    return seg.join(first, order, "left_semi"), seg.join(first, order, "left_anti")


TRUNCATED = "\n[... contexte tronqué ...]\n"
CONTEXT_HEAD, CONTEXT_TAIL = "--- CONTEXTE MÉMOIRE ---\n", "\n--- FIN CONTEXTE ---\n"


def context_budget(ranked: DataFrame, max_tokens: int = 4000, by: str = "query_id", rank: str = "rank", block: str = "block", size: str | None = None) -> DataFrame:
    """Blocks in rank order until the first that would pass the budget (4 characters per token).

    Keeps rows with `chars_before` and `kept`; the first overflow ends the context, later short blocks do not fit in.
    `size` names a column with the blocks' lengths, which spares reading the blocks.
    """
    sized = ranked.withColumn("_len", F.col(size) if size else F.length(block))
    scanned = o.ordered_scan(sized, [by], [rank], {"_before": o.sum_before("_len")}, [size] if size else ())
    before = F.coalesce("_before", F.lit(0)) + len(CONTEXT_HEAD)
    # lengths only grow, so once a running total is past the budget every later one is past it too
    return scanned.withColumns({"chars_before": before.cast("long"), "kept": before + F.col("_len") <= max_tokens * 4}).drop("_before", "_len")


def format_context(budgeted: DataFrame, by: str = "query_id", rank: str = "rank", block: str = "block") -> DataFrame:
    """One context text per query; at most 4 characters x budget, so a query's text is small by construction."""
    body = F.array_join(F.sort_array(F.collect_list(F.when(F.col("kept"), F.struct(rank, block))))[block], "")
    cut = F.when(F.bool_and("kept"), "").otherwise(TRUNCATED)
    return budgeted.groupBy(by).agg(F.concat(F.lit(CONTEXT_HEAD), body, cut, F.lit(CONTEXT_TAIL)).alias("context"))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group. Spark cuts each partition to k rows per group before the shuffle."""
    rn = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn(rank, rn).filter(F.col(rank) <= k)


def topk(df: DataFrame, order: Sequence[Column], k: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(k)


def first_last(matches: DataFrame, by: Sequence[str] = (), order: Sequence[str] = ("timestamp",), what: Sequence[str] = ("file_name", "context")) -> DataFrame:
    """First and last mention and the number of others; the last one only when there are two."""
    key, row = F.struct(*order), F.struct(*order, *what)
    out = matches.groupBy(*by).agg(
        F.min_by(row, key).alias("first"), F.max_by(row, key).alias("last"), F.count(F.lit(1)).alias("n")
    )
    return out.filter("n > 0").withColumns(
        {"last": F.when(F.col("n") > 1, F.col("last")), "others": F.greatest(F.col("n") - 2, F.lit(0))}
    )


def recent_documents(chunks: DataFrame, n: int = 100) -> DataFrame:
    return chunks.filter("chunk_index = 0").orderBy(F.desc("indexed_at"), "doc_id").limit(n)


def merge_short(ex: DataFrame, keys: Sequence[str] = ("conv_id",), order: Sequence[str] = ("turn",), min_len: int = 10) -> DataFrame:
    """Join very short exchanges to the previous kept one with a space.

    An island starts at the first row of a file and at each row that is long enough. A file may be one endless
    run of short rows, so the pieces are joined per (file, island, slice of the order) first; only the slices
    of one resulting text meet in the end.
    """
    # a first row that is short opens island 0, every long row opens the next one
    flagged = ex.withColumn("_long", (F.length("text") >= min_len).cast("long"))
    scanned = o.ordered_scan(flagged, keys, order, {"_no": o.rows_before(), "_before": o.sum_before("_long")}, ())
    islands = scanned.withColumn("_island", F.coalesce("_before", F.lit(0)) + F.col("_long"))
    pieces = islands.groupBy(*keys, "_island", F.floor(F.col("_no") / 1000).alias("_slice")).agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("_no", "text")))["text"], " ").alias("text"),
        F.min_by(F.struct(*[c for c in ex.columns if c not in keys and c != "text"]), "_no").alias("head"),
        F.count(F.lit(1)).alias("n_merged"),
    )
    return (
        pieces.groupBy(*keys, "_island")
        .agg(
            F.array_join(F.sort_array(F.collect_list(F.struct("_slice", "text")))["text"], " ").alias("text"),
            F.min_by("head", "_slice").alias("head"), F.sum("n_merged").alias("n_merged"),
        )
        .select(*keys, "head.*", "text", "n_merged")
    )


CHUNK_THRESHOLD, CHUNK_OVERLAP = 30_000, 7_500


#: A token with the white space before it; white space at the end is one of its own.
_TOKEN = re.compile(r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+\Z")


def chunk_ends(text: str, size: int) -> list[tuple[int, int]]:
    """(tokens, end in the text) of every chunk. A cut falls before the last token after a line break in the chunk's second half, if there is one."""
    ends, breaks = [0], []
    for i, m in enumerate(_TOKEN.finditer(text)):
        ends.append(m.end())
        if "\n" in m.group():
            breaks.append(i)
    n, half = len(ends) - 1, max(1, size // 2)
    if n <= size:
        return [(n, len(text))]
    out, start = [], 0
    while start < n:
        limit = start + size
        cut = n
        if limit < n:
            at = bisect_right(breaks, limit) - 1
            cut = breaks[at] if at >= 0 and breaks[at] > start + half else limit
        out.append((cut - start, ends[cut]))
        start = cut
    return out


def chunk_tokens(docs: DataFrame, size: int = CHUNK_THRESHOLD - CHUNK_OVERLAP, text: str = "text") -> DataFrame:
    """Chunks of at most `size` white-space tokens; a chunk ends at the last newline of its second half if there is one.

    Tokens keep the white space before them, so chunks joined give the text back. A null text has no chunk. The work grows
    with the text's length, however many lines it has.
    """
    keep = [c for c in docs.columns if c != text]
    schema = T.StructType([docs.schema[c] for c in keep]).add("chunk_index", T.IntegerType()).add("n_tokens", T.IntegerType()).add("content", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, counts, parts = [], [], [], []
            for row, t in enumerate(batch.column(text).cast(pa.string()).to_pylist()):
                begin = 0
                for k, (n, end) in enumerate(chunk_ends(t, size) if t is not None else ()):
                    rows.append(row)
                    numbers.append(k)
                    counts.append(n)
                    parts.append(t[begin:end])
                    begin = end
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(at) for c in keep], pa.array(numbers, pa.int32()), pa.array(counts, pa.int32()), pa.array(parts, pa.string())],
                [*keep, "chunk_index", "n_tokens", "content"],
            )

    return docs.select(*keep, text).mapInArrow(run, schema)


def overlap_tail(text: Column, tokens: int = CHUNK_OVERLAP) -> Column:
    """Last tokens of a text."""
    parts = F.regexp_extract_all(text, F.lit(r"\s*\S+|\s+$"), F.lit(0))
    n = F.size(parts)
    return F.when(n <= tokens, text).otherwise(F.array_join(F.slice(parts, n - tokens + 1, F.lit(tokens)), ""))


def batch_no(df: DataFrame, order: Sequence[str], size: int = 5, keys: Sequence[str] = (), carry: Sequence[str] | None = ()) -> DataFrame:
    """Number of the annotation batch of each row."""
    return o.ordinals(df, order, "_no", keys, carry).withColumn("batch", F.floor(F.col("_no") / size)).drop("_no")


FALLBACK_SUMMARY = "[Extraction échouée - contexte précédent]"


def fallback_fill(ann: DataFrame, order: Sequence[str], keys: Sequence[str] = (), ok: str = "ok", fields: Sequence[str] = (), carry: Sequence[str] | None = ()) -> DataFrame:
    """Failed rows take the fields of the last successful row before them; without one they stay null (defaults follow)."""
    state = F.when(F.col(ok), F.struct(*fields))
    scanned = o.ordered_scan(ann.withColumn("_s", state), keys, order, {"_last": o.last_before("_s")}, carry)
    fill = {f: F.when(F.col(ok), F.col(f)).otherwise(F.col("_last")[f]) for f in fields}
    fill["resume_texte"] = F.when(F.col(ok), F.col("resume_texte")).otherwise(F.lit(FALLBACK_SUMMARY))
    return scanned.withColumns(fill).drop("_s", "_last")

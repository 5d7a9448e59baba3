"""Object listings: sizes per folder, difference of two listings, name patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from engram.functions.text import glob_regex


def prefix_sizes(inventory: DataFrame, path: str = "path", size: str = "size", exclude: Sequence[str] = ()) -> DataFrame:
    """Bytes and objects of every folder on every level, and the total (prefix `total`).

    Paths are reduced to their direct folder before the levels are spread, so the explode works on folders, not on
    objects.
    """
    for pattern in exclude:
        inventory = inventory.filter(~F.col(path).rlike(pattern))
    folder = F.regexp_extract(path, r"^(.*/)[^/]*$", 1)
    per_folder = inventory.groupBy(folder.alias("folder")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("objects"))
    parts = F.split(F.regexp_replace("folder", r"/$", ""), "/")
    levels = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))
    )
    named = F.filter(levels, lambda p: ~p.rlike("^/?$"))
    rows = per_folder.select(F.explode(F.array_append(named, F.lit("total"))).alias("prefix"), "bytes", "objects")
    return rows.groupBy("prefix").agg(F.sum("bytes").alias("bytes"), F.sum("objects").alias("objects"))


def sync_plan(
    src: DataFrame, dst: DataFrame, key: str = "path", ignore_existing: bool = False, skip_older: bool = False,
    use_hashes: bool = True, delete_extra: bool = False,
) -> DataFrame:
    """What makes the target listing equal to the source: COPY, REMOVE, SET_MTIME or NONE per path.

    Listings have `key`, size and optionally mtime, md5, crc32c. Without hashes in use and with both times present,
    time and size decide; otherwise size, then md5, then crc32c.
    """
    def shaped(df: DataFrame, side: str) -> DataFrame:
        col = lambda c, t: (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(f"{side}_{c}")
        return df.select(key, F.lit(True).alias(f"{side}_here"), col("size", "long"), col("mtime", "long"), col("md5", "string"), col("crc32c", "string"))

    both = shaped(src, "s").join(shaped(dst, "d"), key, "full_outer")
    c = F.col
    times = c("s_mtime").isNotNull() & c("d_mtime").isNotNull()
    differs = F.when(c("s_size") != c("d_size"), True)
    for digest in ("md5", "crc32c"):
        differs = differs.when(c(f"s_{digest}").isNotNull() & c(f"d_{digest}").isNotNull(), c(f"s_{digest}") != c(f"d_{digest}"))
    differs = differs.otherwise(False)
    if not use_hashes:
        differs = F.when(times, (c("s_mtime") != c("d_mtime")) | (c("s_size") != c("d_size"))).otherwise(differs)
    if skip_older:
        differs = F.when(times & (c("s_mtime") < c("d_mtime")), False).otherwise(differs)
    if ignore_existing:
        differs = F.lit(False)
    action = (
        F.when(c("d_here").isNull(), "COPY")
        .when(c("s_here").isNull(), "REMOVE" if delete_extra else "NONE")
        .when(differs, "COPY")
        .when(c("s_mtime").isNotNull() & c("d_mtime").isNull(), "SET_MTIME")
        .otherwise("NONE")
    )
    return both.select(key, action.alias("action"), F.when(action == "COPY", c("s_size")).alias("bytes"))


def glob_filter(inventory: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """Paths that match a wildcard pattern."""
    return inventory.filter(F.col(path).rlike(glob_regex(pattern)))

"""Reading segments and exchange logs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from engram import schema
from engram.functions import dates
from engram.functions.text import TS, neutralise_markers, strip
from engram.functions.vector import json_vector
from engram.operators.filters import in_scope


def json_list(col: Column) -> Column:
    """List of names from stored JSON: strings, lists (their first item) or objects (their `tag`); bad JSON is empty."""
    items = F.from_json(col, "array<string>")
    one = lambda x: (
        F.when(x.startswith("["), F.from_json(x, "array<string>")[0])
        .when(x.startswith("{"), F.get_json_object(x, "$.tag"))
        .otherwise(x)
    )
    empty = F.array().cast("array<string>")
    return F.coalesce(F.filter(F.transform(items, one), lambda x: x.isNotNull()), empty)


def conform_segments(df: DataFrame) -> DataFrame:
    """Any stored version to the segment schema: text lists parsed, times as instants, missing columns null."""
    out = []
    for field in [*schema.SEGMENTS, *schema.SEGMENTS_V1_EXTRA]:
        if field.name not in df.columns:
            if field in schema.SEGMENTS.fields:
                out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        col, have = F.col(field.name), df.schema[field.name].dataType
        if isinstance(field.dataType, T.ArrayType) and isinstance(have, T.StringType):
            col = json_list(col)
        elif isinstance(field.dataType, T.MapType) and isinstance(have, T.StringType):
            col = json_vector(col)
        elif isinstance(field.dataType, T.TimestampType) and isinstance(have, T.StringType):
            col = dates.iso_to_ts(col)
        else:
            col = col.cast(field.dataType)
        out.append(col.alias(field.name))
    return df.select(*out)


def unify(versions: Sequence[DataFrame]) -> DataFrame:
    """Segments of several schema versions in one frame."""
    out = conform_segments(versions[0])
    for df in versions[1:]:
        out = out.unionByName(conform_segments(df), allowMissingColumns=True)
    return out


def read_segments(spark: SparkSession, *paths: str) -> DataFrame:
    return unify([spark.read.parquet(p) for p in paths])


def scan_archive(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Dated text files below a folder, one row per file; files without a date drop out once a range is set.

    With a range, only those of the archive's year folders that lie in it are listed.
    """
    roots = [path]
    if start or end:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
        years = [f.getPath().getName() for f in found if f.isDirectory() and re.fullmatch(r"\d{4}", f.getPath().getName())]
        if years:
            roots = [f"{path}/{y}" for y in sorted(years) if (start or "0")[:4] <= y <= (end or "9999")[:4]]
    if not roots:
        return spark.createDataFrame([], "file_path string, file_name string, text string")
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt")
    files = reader.text(roots, wholetext=True).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text")
    )
    return in_scope(files, start, end)


ROLES = ["human", "assistant", "user", "utilisateur"]
HUMAN = ["human", "user", "utilisateur"]


def parse_exchanges(files: DataFrame, key: str = "file_name", text: str = "text", names: Sequence[str] = ()) -> DataFrame:
    """Exchanges of log texts: (key, no, source, ts, auteur, text).

    `[SOURCE:x]` is optional, a broken marker at the end of a piece is trimmed, a text without any marker is one
    human exchange. Empty exchanges drop out; short ones are joined by `windows.merge_short`. `names` are further
    speaker names the assistant goes by. Token offsets of archived lines (`15|[…`) belong to the format and go first.
    """
    roles = "|".join(re.escape(n) for n in [*ROLES, *names])
    head = rf"(?i)(?:\[SOURCE:(\w+)\])?\[({TS})\]\s*({roles})\s*:\s*"
    clean = neutralise_markers(F.regexp_replace(text, r"(?m)^\d+\|(?=\[)", ""))
    rows = files.select(key, clean.alias("_t"))
    heads = F.regexp_extract_all("_t", F.lit(f"({head})"), F.lit(1))
    bodies = F.split("_t", head, -1)
    split = rows.select(
        key, "_t", F.posexplode(F.when(F.size(heads) > 0, F.arrays_zip(heads.alias("h"), F.slice(bodies, 2, F.size(bodies)).alias("b")))
                               .otherwise(F.array(F.struct(F.lit("").alias("h"), F.col("_t").alias("b"))))).alias("no", "e")
    )
    h = F.col("e.h")
    part = lambda i: F.regexp_extract(h, head, i)
    body = F.col("e.b")
    for broken in (r"\[$", r"\[SOURCE:\w*\]?$", r"\[\d{4}-\d{2}-\d{2}T?\d{0,2}:?\d{0,2}:?\d{0,2}[^\]]*$"):
        body = F.regexp_replace(strip(body), broken, "")
    role = F.lower(part(3))
    return split.select(
        key, "no", F.nullif(part(1), F.lit("")).alias("source"), dates.iso_to_ts(F.nullif(part(2), F.lit(""))).alias("timestamp"),
        F.when((h == "") | role.isin(*HUMAN), "human").otherwise("assistant").alias("auteur"), strip(body).alias("text"),
    ).filter("text <> ''")


def fuse_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Exchanges of several daily sources, tagged with their source and day."""
    out = None
    for name, df in sources.items():
        part = df.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.withColumn("day", F.to_date("timestamp"))

"""Files: research documents, inventories, URIs, web pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from engram.functions import lexicon as lx
from engram.functions.text import file_ext, html_text, short_hash


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def read_files(spark: SparkSession, path: str, extensions: Sequence[str] = lx.RESEARCH_EXTENSIONS, min_chars: int = 100) -> DataFrame:
    """Readable research files: SHA-256, text as UTF-8 or else Latin-1; texts under 100 characters drop out.

    The extension filter runs on the listing, before any content is read.
    """
    listed = _binary(spark, path).withColumn("extension", file_ext(F.col("path"))).filter(F.col("extension").isin(*extensions))
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return (
        listed.select("path", "extension", "length", "modificationTime", F.sha2("content", 256).alias("file_hash"), text.alias("text"))
        .filter(F.length(F.trim("text")) >= min_chars)
    )


EXCLUDED_DIRS = ["node_modules", "__pycache__", ".git", "venv"]


def file_inventory(spark: SparkSession, path: str, with_hash: bool = True, excluded: Sequence[str] = EXCLUDED_DIRS) -> DataFrame:
    """Name, extension, size, time and short hash of the files below a folder, hidden and excluded folders left out.

    Without the hash the listing alone is read, not the contents.
    """
    rel = F.regexp_replace("path", r"^[a-z0-9+.-]+:/*", "/")
    out = _binary(spark, path).withColumn("path_display", rel)
    hidden = F.col("path_display").rlike(r"/\.[^/]")
    skip = F.lit(False)
    for name in excluded:
        skip = skip | F.contains("path_display", F.lit(f"/{name}/"))
    cols = [
        "path_display", F.regexp_extract("path_display", r"([^/]+)$", 1).alias("name"), file_ext(F.col("path_display")).alias("extension"),
        F.col("length").alias("size"), F.col("modificationTime").alias("server_modified"),
    ]
    if with_hash:
        cols.append(short_hash(F.col("content")).alias("content_hash"))
    return out.filter(~hidden & ~skip).select(*cols)


# scheme prefix, source type, whether the prefix stays (fixed values)
SCHEMES = [("dropbox://", "dropbox", False), ("gdrive://", "gdrive", False), ("file://", "local", False),
           ("http://", "url", True), ("https://", "url", True), ("/", "local", True), ("~", "local", True)]


def classify_uri(uri: Column, default: str = "dropbox") -> tuple[Column, Column]:
    """(source type, path) of a URI; a relative path belongs to the default source."""
    uri = F.trim(uri)
    kind, path = F, F
    for prefix, name, keep in SCHEMES:
        hit = uri.startswith(prefix)
        kind = kind.when(hit, name)
        path = path.when(hit, uri if keep else F.substring(uri, F.lit(len(prefix) + 1), F.length(uri)))
    return kind.otherwise(default), path.otherwise(uri)


def file_parts(df: DataFrame, column: str, files: int, groups: int = 16) -> DataFrame:
    """Rows dealt out so that `write.partitionBy(column)` gives `files` files per value, each written by a task that has
    no other file of this value."""
    group, file = F.pmod(F.xxhash64(column), F.lit(groups)), F.pmod(F.monotonically_increasing_id(), F.lit(files))
    return df.repartitionById(groups * files, (group * files + file).cast("int"))


def html_to_text(pages: DataFrame, html: str = "html") -> DataFrame:
    return pages.withColumn("text", html_text(F.col(html)))


def document_chunks(chunks: DataFrame, doc_id: str | None = None) -> DataFrame:
    """Chunks with an id, of one document or all, in reading order within their document."""
    cols = ["doc_id", "chunk_id", "chunk_index", "section_title", "page_start", "page_end", "content_tokens", "roget_codes", "summary"]
    out = chunks.filter("chunk_id IS NOT NULL")
    if doc_id is not None:
        out = out.filter(F.col("doc_id") == doc_id)
    return out.select(*[c for c in cols if c in chunks.columns]).orderBy("doc_id", "chunk_index")

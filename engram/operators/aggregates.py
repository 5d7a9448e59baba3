"""Aggregations. All of them combine on the map side; none collects a group."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from engram.functions import dates
from engram.functions.dates import at
from engram.functions.text import content_class
from engram.operators.filters import AuditFilters, daily_window

def n_rows() -> Column:
    return F.count(F.lit(1)).alias("n")


def corpus_stats(seg: DataFrame) -> DataFrame:
    """One row: size, time range, rounded emotion means."""
    return seg.agg(
        F.count(F.lit(1)).alias("total"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
        F.round(F.avg("emotion_valence"), 3).alias("avg_valence"), F.round(F.avg("emotion_activation"), 3).alias("avg_activation"),
    )


def count_by(df: DataFrame, *cols) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def counts_by_day(seg: DataFrame) -> DataFrame:
    return count_by(seg, F.to_date("timestamp").alias("day"))


def quality_metrics(seg: DataFrame, filters: AuditFilters = AuditFilters()) -> DataFrame:
    """One pass over the filtered segments: gaps and the mean valence."""
    empty = lambda c: F.col(c).isNull() | (F.size(c) == 0)
    return seg.filter(filters.predicate()).agg(
        F.count_if(F.col("resume_texte").isNull() | (F.length("resume_texte") < 10)).alias("without_summary"),
        F.count_if(empty("tags_roget")).alias("without_tags"),
        F.count_if(empty("personnes")).alias("without_persons"),
        F.round(F.avg("emotion_valence"), 3).alias("avg_valence"),
    )


def top_values(seg: DataFrame, col: str, k: int = 10, filters: AuditFilters = AuditFilters()) -> DataFrame:
    """Most frequent values of a column."""
    counted = seg.filter(filters.predicate()).groupBy(col).agg(n_rows())
    return counted.orderBy(F.desc("n"), F.asc_nulls_first(col)).limit(k)


def repeated_summaries(seg: DataFrame, k: int = 5, filters: AuditFilters = AuditFilters()) -> DataFrame:
    """Examples of summaries that occur more than once."""
    counted = seg.filter(filters.predicate() & (F.col("resume_texte") != "")).groupBy("resume_texte").agg(n_rows())
    return counted.filter("n > 1").orderBy(F.desc("n"), "resume_texte").limit(k)


def find_duplicates(seg: DataFrame, keys: Sequence[str] = ("timestamp", "source_origine")) -> DataFrame:
    """Keys that occur more than once, most frequent first."""
    return seg.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("keep_id")).filter("n > 1")


def duplicate_totals(seg: DataFrame, keys: Sequence[str] = ("timestamp", "source_origine")) -> DataFrame:
    dup = find_duplicates(seg, keys)
    return dup.agg(
        F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("involved"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("to_delete"),
    )


def documents_view(chunks: DataFrame) -> DataFrame:
    """Chunk and token totals per document, attributes of its first chunk."""
    attrs = F.struct("filename", "source_uri", "domain", "project", "indexed_at")
    return (
        chunks.groupBy("doc_id")
        .agg(
            F.min_by(attrs, "chunk_index").alias("a"), F.count(F.lit(1)).alias("chunk_count"),
            F.sum("content_tokens").alias("total_tokens"),
        )
        .select("doc_id", "a.*", "chunk_count", "total_tokens")
    )


def group_view(chunks: DataFrame, by: str = "domain", approximate: bool = False) -> DataFrame:
    """Documents and tokens per domain or project.

    The distinct count aggregates per (group, document) first, so a group with most of the documents spreads out.
    """
    if approximate:
        return chunks.groupBy(by).agg(
            F.approx_count_distinct("doc_id").alias("document_count"), F.sum("content_tokens").alias("total_tokens")
        )
    per_doc = chunks.groupBy(by, "doc_id").agg(F.sum("content_tokens").alias("_t"))
    return per_doc.groupBy(by).agg(F.count("doc_id").alias("document_count"), F.sum("_t").alias("total_tokens"))


def file_stats(files: DataFrame, k: int = 10) -> DataFrame:
    """Counts by status and by domain, and the most frequent extensions, as (dimension, value, n)."""
    part = lambda name, df: df.select(F.lit(name).alias("dimension"), F.col(df.columns[0]).alias("value"), "n")
    extensions = files.groupBy("extension").agg(n_rows()).orderBy(F.desc("n"), "extension").limit(k)
    return (
        part("status", files.groupBy("status").agg(n_rows()))
        .unionByName(part("domain", files.groupBy("domain").agg(n_rows())))
        .unionByName(part("extension", extensions))
    )


def extension_sizes(files: DataFrame, k: int = 20) -> DataFrame:
    """Count and bytes of the largest extensions and the grand total (extension null), one rollup."""
    sizes = files.rollup("extension").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.grouping("extension").alias("is_total")
    )
    top = sizes.filter("is_total = 0").orderBy(F.desc("n"), F.asc_nulls_first("extension")).limit(k)
    return top.unionByName(sizes.filter("is_total = 1"))


def daily_digest(seg: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """One row over the last hours: segments per author class and the emotion range."""
    day = seg.filter(F.col("timestamp") > at(now) - F.expr(f"INTERVAL {int(hours)} HOURS"))
    human, assistant = F.col("auteur") == "human", F.col("auteur") == "assistant"
    return day.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(human).alias("human"), F.count_if(assistant).alias("assistant"),
        F.count_if(~human & ~assistant).alias("internal"),
        F.min("emotion_valence").alias("valence_min"), F.max("emotion_valence").alias("valence_max"),
        F.min("emotion_activation").alias("activation_min"), F.max("emotion_activation").alias("activation_max"),
    )


def digest_entities(seg: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """Distinct people, projects and natures of the last hours with their counts."""
    day = daily_window(seg, now, hours)
    parts = F.array(
        F.struct(F.lit("personne").alias("kind"), F.col("personnes").alias("names")),
        F.struct(F.lit("projet").alias("kind"), F.col("projets").alias("names")),
        F.struct(F.lit("nature").alias("kind"), F.array("source_nature").alias("names")),
    )
    rows = day.select(F.inline(parts)).select("kind", F.explode("names").alias("name"))
    return rows.groupBy("kind", "name").agg(n_rows())


def fact_stats(facts: DataFrame) -> DataFrame:
    """Total, per domain and per importance with the last update: grouping sets in one pass."""
    level = F.when(F.grouping("domaine") == 0, "domaine").when(F.grouping("importance") == 0, "importance").otherwise("total")
    return facts.groupingSets(
        [[F.col("domaine")], [F.col("importance")], []], F.col("domaine"), F.col("importance")
    ).agg(level.alias("level"), F.count(F.lit(1)).alias("n"), F.max("derniere_maj").alias("last_update"))


def failure_histogram(texts: DataFrame, text: str = "text") -> DataFrame:
    """Content classes of failed segments and their share; a missing text is an error."""
    cls = F.when(F.col(text).isNull(), "erreur").otherwise(content_class(F.col(text)))
    counts = texts.groupBy(cls.alias("content_class")).agg(n_rows())
    total = texts.agg(F.count(F.lit(1)).alias("_total"))
    # six classes at most against a single total row
    return counts.join(F.broadcast(total), F.lit(True)).select(
        "content_class", "n", F.round(F.col("n") * 100.0 / F.col("_total"), 2).alias("percent")
    )


def link_histogram(result: DataFrame) -> DataFrame:
    return result.groupBy("link_type").agg(n_rows())


def merge_stats(exports: Sequence[DataFrame]) -> DataFrame:
    """Totals, unique ones and duplicates of merged exports."""
    rows = None
    for df in exports:
        rows = df.select("uuid", "chat_messages") if rows is None else rows.unionByName(df.select("uuid", "chat_messages"))
    conv = rows.groupBy("uuid").agg(n_rows()).agg(
        F.sum("n").alias("conversations_total"), F.count(F.lit(1)).alias("conversations_unique")
    )
    msgs = rows.select(F.explode("chat_messages").alias("m")).groupBy("m.uuid").agg(n_rows()).agg(
        F.sum("n").alias("messages_total"), F.count(F.lit(1)).alias("messages_unique")
    )
    # both sides are one row
    return conv.join(F.broadcast(msgs), F.lit(True)).withColumns(
        {
            "conversations_duplicates": F.col("conversations_total") - F.col("conversations_unique"),
            "messages_duplicates": F.col("messages_total") - F.col("messages_unique"),
        }
    )


def messages_per_day(exchanges: DataFrame, after: datetime | None = None) -> DataFrame:
    """Messages per business day: total, skipped (not after the mark, or empty) and processed."""
    fresh = F.col("timestamp") > at(after) if after else F.lit(True)
    usable = fresh & (F.length(F.trim("text")) > 0)
    return exchanges.groupBy(dates.business_day(F.col("timestamp")).alias("day")).agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(~usable).alias("skipped"), F.count_if(usable).alias("processed")
    )


def fusion_stats(fused: DataFrame) -> DataFrame:
    """Exchanges per date and the sources that met there (few names, no row lists)."""
    day = F.to_date("timestamp").alias("day")
    return fused.groupBy(day, "source").agg(F.count(F.lit(1)).alias("_n")).groupBy("day").agg(
        F.sum("_n").alias("exchanges"), F.count(F.lit(1)).alias("n_sources"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
    )


def summary_lines(df: DataFrame, order: str, line: Column, n: int = 5) -> DataFrame:
    """The first n rows as one bullet text."""
    first = df.orderBy(order).limit(n).select(order, F.concat(F.lit("- "), line).alias("line"))
    return first.agg(F.array_join(F.sort_array(F.collect_list(F.struct(order, "line")))["line"], "\n").alias("text"))


def catalog_profile(spark: SparkSession, sample: int = 5) -> list[dict]:
    """For every table or view: columns, row count and a sample, newest first when a time column exists."""
    out = []
    for table in spark.catalog.listTables():
        df = spark.table(table.name)
        by = next((c for c in df.columns if any(k in c.lower() for k in ("date", "time", "created"))), None)
        page = df.orderBy(F.desc(by)) if by else df
        out.append({"table": table.name, "columns": df.columns, "rows": df.count(), "sample": page.limit(sample).collect()})
    return out


def import_report(status: DataFrame) -> DataFrame:
    """Files and exchanges per outcome and reason."""
    return status.groupBy("outcome", F.coalesce("reason", F.lit("")).alias("reason")).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("exchanges"), F.lit(0)).alias("exchanges")
    )


def corpus_profile(docs: DataFrame, paragraphs: DataFrame, text: str = "text") -> DataFrame:
    """Files, characters and kept paragraphs."""
    base = docs.agg(F.count(F.lit(1)).alias("files"), F.sum(F.length(text)).alias("chars"))
    return base.join(F.broadcast(paragraphs.agg(F.count(F.lit(1)).alias("paragraphs"))), F.lit(True))



"""Writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def append_segments(seg: DataFrame, path: str) -> None:
    """Append by event date; rows of a day are spread by id, so one busy day is written by many tasks."""
    out = seg.withColumn("event_date", F.to_date("timestamp"))
    out.repartitionByRange("event_date", "id").write.mode("append").partitionBy("event_date").parquet(path)


def write_edges(edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per link type, sorted by source inside, so a walk reads the wanted types and few row groups."""
    edges.repartitionByRange("type", "source_id", "target_id").sortWithinPartitions("type", "source_id").write.mode(mode).partitionBy(
        "type"
    ).parquet(path)


def swap(df: DataFrame, path: str, spark: SparkSession) -> None:
    """Replace a table by a version that may have been computed from it: write beside it, then rename.

    The old version stays until the new one is complete.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    target, fresh, old = (hadoop.Path(path + s) for s in ("", ".new", ".old"))
    fs = target.getFileSystem(conf)
    df.write.mode("overwrite").parquet(path + ".new")
    if fs.exists(old):
        fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
    if fs.exists(old):
        fs.delete(old, True)


def write_daily_archive(entries: DataFrame, path: str, day: str = "day", order: str = "timestamp", line: str = "line") -> None:
    """Text archive `YYYY/MM/<date>-<part>.txt`, entries sorted by time; `segments.scan_archive` reads it.

    Entries are range partitioned by (day, time): a day that holds most of them becomes several files whose numbers
    keep the time order, instead of one task that writes everything. The files are written aside and then renamed.
    """
    spark = entries.sparkSession
    date = F.date_format(F.col(day).cast("date"), "yyyy-MM-dd")
    aside = f"{path}/.new-{uuid.uuid4().hex}"
    entries.repartitionByRange(day, order).sortWithinPartitions(day, order).select(date.alias("_day"), F.col(line).alias("value")).write.partitionBy("_day").text(aside)
    hadoop = spark._jvm.org.apache.hadoop.fs
    source = hadoop.Path(aside)
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in sorted(fs.listStatus(source), key=lambda f: f.getPath().getName()):
        name = folder.getPath().getName()
        if not name.startswith("_day="):
            continue
        date_ = name.removeprefix("_day=")
        target = hadoop.Path(f"{path}/{date_[:4]}/{date_[5:7]}")
        fs.mkdirs(target)
        for old in fs.listStatus(target):
            if old.getPath().getName().startswith(date_):
                fs.delete(old.getPath(), False)
        for n, part in enumerate(sorted(p.getPath().getName() for p in fs.listStatus(folder.getPath()) if p.getPath().getName().startswith("part-"))):
            fs.rename(hadoop.Path(folder.getPath(), part), hadoop.Path(target, f"{date_}-{n:05d}.txt"))
    fs.delete(source, True)


def archive_lines(messages: DataFrame) -> DataFrame:
    """Entry text of each message: time, author, text; conversation headers where a conversation starts in a day."""
    when = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.concat(F.lit("["), when, F.lit("] "), F.col("auteur"), F.lit(":\n"), F.col("text"), F.lit("\n"))
    rule = "=" * 50
    heads = messages.groupBy("day", "conv").agg(F.min("timestamp").alias("timestamp"), F.min_by("title", "timestamp").alias("title"))
    head = F.concat(F.lit(f"\n{rule}\n=== Conversation: "), F.col("title"), F.lit(" ("), F.substring(F.sha1("conv"), 1, 8), F.lit(f") ===\n{rule}\n\n"))
    return messages.select("day", "timestamp", F.lit(1).alias("no"), body.alias("line")).unionByName(
        heads.select("day", "timestamp", F.lit(0).alias("no"), head.alias("line"))
    )


def write_results(df: DataFrame, path: str, meta: dict[str, str]) -> None:
    """Search results as JSON lines with the run's parameters in every row."""
    info = F.create_map(*[F.lit(x) for pair in meta.items() for x in pair]) if meta else F.create_map()
    df.withColumn("meta", info).write.mode("overwrite").json(path)

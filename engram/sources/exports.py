"""Chat exports: message trees and flat messages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from engram import schema
from engram.functions import dates
from engram.functions.text import clean_flat_artefacts, clean_tree_artefacts
from engram.session import materialise


def content_text(content: Column) -> Column:
    """Text of a tree message by its content type."""
    kind, text = content["content_type"], F.coalesce(content["text"], F.lit(""))
    parts = F.array_join(F.filter(F.coalesce(content["parts"], F.array().cast("array<string>")), lambda p: p.isNotNull() & (p != "")), "\n")
    return (
        F.when(content.isNull() | (kind == "user_editable_context"), "")
        .when((kind == "code") & (F.contains(text, F.lit("\\u")) | (text == "")), "")
        .when(kind == "code", F.concat(F.lit("[Code]\n"), text))
        .when((kind == "execution_output") & (text == ""), "")
        .when(kind == "execution_output", F.concat(F.lit("[Output]\n"), text))
        .otherwise(clean_tree_artefacts(parts))
    )


def reachable_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes reachable from the root of their conversation (conv, node, is_root, children).

    A conversation may be one long chain, so the closure doubles its reach per round (pointer jumping towards the
    root): a chain of n messages needs log2(n) joins, each on (conversation, node).
    """
    conv = ["conv"]
    roots = nodes.groupBy("conv").agg(
        F.coalesce(F.min(F.when(F.col("is_root"), F.col("node"))), F.min("node")).alias("root")
    )
    every = nodes.select("conv", F.col("node").alias("parent"), F.explode("children").alias("node"))
    # the first pointer goes to the smallest parent; other parents count where that one leads nowhere
    links = every.groupBy("conv", "node").agg(F.min("parent").alias("up"))
    joined = nodes.select("conv", "node").join(links, [*conv, "node"], "left").join(roots, conv)
    own = F.when(F.col("node") == F.col("root"), F.col("node")).otherwise(F.col("up"))
    start = materialise(joined.select("conv", "node", own.alias("up"), "root"))
    while True:
        at = _jumped(start)
        reached = at.filter("up = root").select("conv", "node")
        known = reached.withColumnRenamed("node", "parent")
        lost = at.join(reached, [*conv, "node"], "left_anti").select("conv", "node")
        found = materialise(every.join(lost, [*conv, "node"]).join(known, [*conv, "parent"], "left_semi").select("conv", "node", F.lit(True).alias("_found")).distinct())
        if found.isEmpty():
            return reached
        start = start.join(found, [*conv, "node"], "left").select("conv", "node", F.when(F.col("_found"), F.col("root")).otherwise(F.col("up")).alias("up"), "root")
        start = materialise(start)


def _jumped(at: DataFrame) -> DataFrame:
    """Pointers doubled until no further node arrives at its root."""
    arrived = at.filter("up = root").count()
    while True:
        up = at.select("conv", F.col("node").alias("up"), F.col("up").alias("_to"))
        at = materialise(at.join(up, ["conv", "up"], "left").select("conv", "node", F.when(F.col("up") == F.col("root"), F.col("root")).otherwise(F.col("_to")).alias("up"), "root"))
        now = at.filter("up = root").count()
        # depths along a chain have no gaps: a round without arrivals was the last one
        if now == arrived:
            return at
        arrived = now


def tree_messages(export: DataFrame, after: datetime | None = None) -> DataFrame:
    """Visible user and assistant messages of a tree export, in time order within their conversation by `ts`.

    `export` has the layout of `schema.TREE_EXPORT` plus a unique `conv`.
    """
    nodes = export.select("conv", "title", F.explode("mapping").alias("node", "n")).select(
        "conv", "title", "node", F.col("n.parent").isNull().alias("is_root"),
        F.coalesce("n.children", F.array().cast("array<string>")).alias("children"), F.col("n.message").alias("m"),
    )
    reached = reachable_nodes(nodes.select("conv", "node", "is_root", "children"))
    role = F.col("m.author.role")
    visible = (
        F.col("m").isNotNull() & ~F.coalesce(F.col("m.metadata.is_visually_hidden_from_conversation"), F.lit(False))
        & role.isin("user", "assistant") & (F.coalesce("m.create_time", F.lit(0.0)) != 0)
    )
    rows = nodes.filter(visible).join(reached, ["conv", "node"], "left_semi").select(
        "conv", "title", "node", dates.unix_to_ts(F.col("m.create_time")).alias("timestamp"),
        F.when(role == "user", "human").otherwise("assistant").alias("auteur"), F.trim(content_text(F.col("m.content"))).alias("text"),
    ).filter("text <> ''")
    if after:
        rows = rows.filter(F.col("timestamp") > dates.at(after))
    return rows.withColumn("day", dates.business_day(F.col("timestamp")))


def read_tree_export(spark: SparkSession, path: str, after: datetime | None = None) -> DataFrame:
    raw = spark.read.schema(schema.TREE_EXPORT).json(path, multiLine=True)
    return tree_messages(raw.withColumn("conv", F.concat_ws("|", "title", F.col("create_time").cast("string"), F.xxhash64(F.to_json("mapping")).cast("string"))), after)


def message_text(m: Column) -> Column:
    """Text of a flat message: its text blocks, else the old text field."""
    blocks = F.filter(F.coalesce(m["content"], F.array().cast("array<struct<type:string,text:string>>")),
                      lambda b: (b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != ""))
    joined = F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n")
    return F.when(F.size(blocks) > 0, joined).otherwise(F.coalesce(m["text"], F.lit("")))


def flat_messages(export: DataFrame, after: datetime | None = None) -> DataFrame:
    """Messages of a flat export with conversation and business day."""
    rows = export.select(F.col("uuid").alias("conv"), F.col("name").alias("title"), F.explode("chat_messages").alias("m"))
    out = rows.select(
        "conv", "title", F.col("m.uuid").alias("uuid"), dates.iso_to_ts(F.col("m.created_at")).alias("timestamp"),
        F.when(F.lower(F.coalesce("m.sender", F.lit("human"))).isin("human", "user"), "human").otherwise("assistant").alias("auteur"),
        clean_flat_artefacts(message_text(F.col("m"))).alias("text"),
    ).filter("text <> '' AND timestamp IS NOT NULL")
    if after:
        out = out.filter(F.col("timestamp") > dates.at(after))
    return out.withColumn("day", dates.business_day(F.col("timestamp")))


def read_flat_export(spark: SparkSession, path: str, after: datetime | None = None) -> DataFrame:
    return flat_messages(spark.read.schema(schema.FLAT_EXPORT).json(path, multiLine=True), after)

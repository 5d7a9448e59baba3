"""Queries: table jobs, listings, annotation, streaming."""

from __future__ import annotations

from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import functions as F

from engram.functions import lexicon as lx
from engram.operators import annotate as ann, graph, listings, tables
from engram.plans.queries_graph import PERSON_SQL
from engram.plans.registry import query
from engram.session import scratch_path
from engram.sources import sql as guarded
from engram.streaming import jobs


# --- table jobs ------------------------------------------------------------------------------------------------
@query("sdk1_load_csv", "SELECT o_orderkey, CAST(NULLIF(o_orderstatus, 'F') AS VARCHAR) AS o_orderstatus, o_totalprice FROM orders")
def _(d):
    path = scratch_path(d.spark, "csv")
    rows = d.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "NULLED").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice")
    tables.extract(rows, path, "csv", compression="gzip", delimiter="|")
    return tables.load_table(d.spark, path, "csv", "o_orderkey LONG, o_orderstatus STRING, o_totalprice DOUBLE", delimiter="|", skip_rows=1, null_marker="NULLED")


@query("sdk1_load_bad_rows", "SELECT CAST(o_orderkey AS BIGINT) AS k, o_totalprice AS price FROM orders WHERE o_orderkey % 1000 <> 0")
def _(d):
    path = scratch_path(d.spark, "badcsv")
    line = F.when(F.col("o_orderkey") % 1000 == 0, F.lit("not a number,zzz")).otherwise(F.concat_ws(",", "o_orderkey", "o_totalprice"))
    d.orders.select(line.alias("value")).write.text(path)
    return tables.load_table(d.spark, path, "csv", "k LONG, price DOUBLE", max_bad=1_000_000_000)


@query("sdk1_load_json", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(d):
    path = scratch_path(d.spark, "json")
    tables.extract(d.customer, path, "json")
    return tables.load_table(d.spark, path, "json", "c_custkey LONG, c_name STRING, c_acctbal DOUBLE")


@query("sdk1_load_orc", "SELECT p_partkey, p_brand FROM part")
def _(d):
    path = scratch_path(d.spark, "orc")
    d.part.write.orc(path)
    return tables.load_table(d.spark, path, "orc").select("p_partkey", "p_brand")


@query(
    "sdk2_layout",
    """SELECT strftime(o_orderdate, '%Y') AS year, CASE WHEN o_custkey >= 0 AND o_custkey < 1000 THEN CAST(CAST(floor(o_custkey / 100) * 100 AS BIGINT) AS VARCHAR) ELSE '__UNPARTITIONED__' END AS bucket, count(*) AS n FROM orders GROUP BY ALL""",
)
def _(d):
    out, parts = tables.layout(d.orders, "o_orderdate", "YEAR", "o_custkey,0,1000,100", cluster=["o_orderkey"])
    path = scratch_path(d.spark, "layout")
    out.write.partitionBy(*parts).parquet(path)
    back = tables.discover(d.spark, path, "STRINGS")
    return back.groupBy(F.col("_part_time").alias("year"), F.col("_part_range").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("sdk3_append_evolve", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 2 = 1")
def _(d):
    new = d.orders.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_orderpriority")
    return tables.append_evolve(d.orders.filter("o_orderkey % 2 = 1").select("o_orderkey"), new, allow_new=True, relax=True)


@query("sdk4_discover_manifest", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def _(d):
    path, manifest = scratch_path(d.spark, "parts"), scratch_path(d.spark, "manifest")
    d.customer.repartition(4, "c_custkey").write.parquet(path)
    names = d.spark.read.parquet(path).select(F.input_file_name().alias("value")).distinct()
    names.coalesce(1).write.text(manifest)
    return tables.discover(d.spark, manifest, "MANIFEST").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("sdk4_discover_hive", "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, CAST(sum(c_nationkey) AS BIGINT) AS nations FROM customer GROUP BY c_mktsegment")
def _(d):
    path = scratch_path(d.spark, "hive")
    d.customer.repartition("c_nationkey").write.partitionBy("c_nationkey").parquet(path)
    return tables.discover(d.spark, path, "AUTO").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("c_nationkey").alias("nations"))


@query("sdk5_extract", "SELECT s_suppkey, s_name FROM supplier")
def _(d):
    path = scratch_path(d.spark, "extract")
    tables.extract(d.supplier, path, "parquet", compression="zstd")
    return d.spark.read.parquet(path).select("s_suppkey", "s_name")


@query("sdk6_copy", "SELECT s_suppkey, count(*) AS n FROM (SELECT s_suppkey FROM supplier UNION ALL SELECT s_suppkey FROM supplier UNION ALL SELECT s_suppkey FROM supplier) GROUP BY s_suppkey")
def _(d):
    a, b = scratch_path(d.spark, "a"), scratch_path(d.spark, "b")
    d.supplier.write.parquet(a)
    tables.copy_table(d.spark, [a, a], b, "overwrite")
    tables.copy_table(d.spark, [a], b, "append")
    tables.copy_table(d.spark, [a], b, "no_clobber")
    return d.spark.read.parquet(b).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("sdk7_merge_shards", "SELECT strftime(o_orderdate, '%Y') AS partition_id, count(*) AS n FROM orders GROUP BY 1")
def _(d):
    root = scratch_path(d.spark, "shards")
    name = F.concat(F.when(F.col("o_orderkey") % 100 == 0, "other_").otherwise("orders_"), F.year("o_orderdate"))
    d.orders.withColumn("shard", F.concat(F.lit("orders_"), F.year("o_orderdate"))).unionByName(d.orders.filter("o_orderkey % 100 = 0").withColumn("shard", name)).write.partitionBy("shard").parquet(root)
    return tables.read_shards(d.spark, root, "orders_").groupBy("partition_id").agg(F.count(F.lit(1)).alias("n"))


@query("sdk8_head", "SELECT o_orderkey, o_totalprice AS o_price FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 250")
def _(d):
    nested = d.orders.select("o_orderkey", F.struct(F.col("o_totalprice").alias("price")).alias("o"))
    return tables.head(nested, ["o_orderkey"], 250, 100, ["o_orderkey", "o.price"])


@query(
    "sdk9_prefix_sizes",
    """WITH f AS (SELECT string_split(path_display, '/') AS p, size FROM files WHERE NOT contains(path_display, '/es/'))
    SELECT prefix, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS objects FROM (SELECT concat('/', p[2], '/') AS prefix, size FROM f UNION ALL SELECT concat('/', p[2], '/', p[3], '/'), size FROM f UNION ALL SELECT 'total', size FROM f) GROUP BY prefix""",
)
def _(d):
    return listings.prefix_sizes(d.files, "path_display", "size", exclude=["/es/"])


@query(
    "sdk10_sync_plan",
    """WITH s AS (SELECT doc_id, md5(text) AS md5, n_chars AS size FROM documents WHERE doc_id % 7 <> 0), t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE md5(text) END AS md5, n_chars AS size FROM documents WHERE doc_id % 11 <> 0)
    SELECT coalesce(s.doc_id, t.doc_id) AS doc_id, CASE WHEN t.doc_id IS NULL THEN 'COPY' WHEN s.doc_id IS NULL THEN 'REMOVE' WHEN s.md5 <> t.md5 THEN 'COPY' ELSE 'NONE' END AS action FROM s FULL JOIN t ON s.doc_id = t.doc_id""",
)
def _(d):
    rows = d.documents.select("doc_id", F.md5("text").alias("md5"), F.col("n_chars").alias("size"))
    dst = rows.filter("doc_id % 11 <> 0").withColumn("md5", F.when(F.col("doc_id") % 5 == 0, "changed").otherwise(F.col("md5")))
    return listings.sync_plan(rows.filter("doc_id % 7 <> 0"), dst, "doc_id", delete_extra=True).select("doc_id", "action")


@query(
    "sdk10_sync_by_time",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'SET_MTIME' WHEN doc_id % 4 = 1 THEN 'NONE' WHEN doc_id % 4 = 2 THEN 'COPY' ELSE 'NONE' END AS action FROM documents""",
)
def _(d):
    k = F.col("doc_id") % 4
    src = d.documents.select("doc_id", F.col("n_chars").alias("size"), F.lit(1000).alias("mtime"))
    dst = d.documents.select("doc_id", F.col("n_chars").alias("size"), F.when(k == 1, 1000).when(k == 2, 900).when(k == 3, 2000).alias("mtime"))
    return listings.sync_plan(src, dst, "doc_id", skip_older=True, use_hashes=False).select("doc_id", "action")


@query(
    "sdk11_wildcards",
    r"""SELECT 'a' AS pattern, id FROM files WHERE regexp_matches(path_display, '^/src1[0-3]/.*/doc.*5\.txt$') UNION ALL
    SELECT 'b', id FROM files WHERE regexp_matches(path_display, '^/src?/.*$') OR regexp_matches(path_display, '^/src./.*$')""",
)
def _(d):
    f = d.files
    a = listings.glob_filter(f, "/src1[0-3]/**/doc*5.txt", "path_display").select(F.lit("a").alias("pattern"), "id")
    return a.unionByName(listings.glob_filter(f, "/src?/*", "path_display").select(F.lit("b").alias("pattern"), "id"))


@query(
    "sdk12_latency",
    """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type""",
)
def _(d):
    out = tables.latency_summary(d.events, "value", ["event_type"])
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "stddev", "p50", "p90")])


@query("sdk13_parameters", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 200000.5 AND o_orderstatus = 'O' AND o_orderkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233)")
def _(d):
    sql = "SELECT o_orderkey, o_orderstatus FROM p_orders WHERE o_totalprice > :low AND o_orderstatus = :status AND array_contains(:keys, o_orderkey)"
    return guarded.query(d.spark, sql, ["low:FLOAT64:200000.5", "status::O", "keys:ARRAY<BIGINT>:[1,2,3,5,8,13,21,34,55,89,144,233]"], {"p_orders": d.orders})


@query("sdk13_positional", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000 AND o_orderpriority = '1-URGENT'")
def _(d):
    return guarded.query(d.spark, "SELECT count(*) AS n FROM p_orders WHERE o_totalprice > ? AND o_orderpriority = ?", [":INT64:100000", "::1-URGENT"], {"p_orders": d.orders})


@query("sdk14_policy", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey < 5")
def _(d):
    policies = {
        "by_segment": {"grantees": ["ana", "bo"], "predicate": "c_mktsegment = 'BUILDING'"},
        "by_nation": {"grantees": ["ana"], "predicate": "c_nationkey < 5"},
        "other": {"grantees": ["bo"], "predicate": "true"},
    }
    return tables.policy_view(d.customer, policies, "ana").select("c_custkey")


@query("sdk15_materialised_view", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def _(d):
    d.orders.createOrReplaceTempView("mv_orders")
    sql = "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM mv_orders GROUP BY o_orderstatus"
    return tables.make_view(d.spark, "order_totals", sql, scratch_path(d.spark, "mv"))


@query(
    "sdk15_incremental_view",
    "SELECT o_orderstatus, count(*) AS n, round(sum(CASE WHEN o_orderkey % 4 = 3 THEN o_totalprice * 2 ELSE o_totalprice END), 2) AS total FROM orders WHERE year(o_orderdate) <> 1993 GROUP BY o_orderstatus",
)
def _(d):
    # refreshed after every change: an append, a partition written anew, and one that goes
    table, view = scratch_path(d.spark, "orders"), scratch_path(d.spark, "view")
    rows = d.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("year"))
    write = lambda df, mode: df.repartition("year").write.mode(mode).partitionBy("year").option("partitionOverwriteMode", "dynamic").parquet(table)
    fresh = lambda: tables.refresh_view(d.spark, table, view, "year", ["o_orderstatus"], ["o_totalprice"])
    write(rows.filter("year <> 1993 AND o_orderkey % 4 < 2"), "append")
    fresh()
    write(rows.filter("year <> 1993 AND o_orderkey % 4 = 2"), "append")
    fresh()
    late = rows.filter("year <> 1993 AND o_orderkey % 4 = 3").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    write(late, "append")
    return fresh().select("o_orderstatus", "n", F.round("sum_o_totalprice", 2).alias("total"))


def _json_rows(d):
    k = F.col("event_id") % 5
    text = (
        F.when(k == 0, F.concat(F.lit('{"id": '), F.col("event_id"), F.lit(', "v": "x"}'))).when(k == 1, F.concat(F.lit('{"id": '), F.col("event_id"), F.lit(', "extra": 1}')))
        .when(k == 2, "{broken").when(k == 3, F.lit('{"id": "text"}')).otherwise(F.concat(F.lit('{"id": '), F.col("event_id"), F.lit("}")))
    )
    rows = d.events.select(F.col("event_id").cast("string").alias("insert_id"), text.alias("json"))
    return rows.unionByName(rows)


@query("sdk16_insert_rows", "SELECT CAST(event_id AS VARCHAR) AS insert_id, event_id AS id FROM events WHERE event_id % 5 IN (0, 4)")
def _(d):
    return tables.insert_rows(_json_rows(d), "id LONG, v STRING")[0].select("insert_id", "id")


@query(
    "sdk16_rejected_rows",
    "SELECT CASE event_id % 5 WHEN 1 THEN 'unknown field' WHEN 2 THEN 'not JSON' ELSE 'wrong type' END AS reason, 2 * count(*) AS n FROM events WHERE event_id % 5 IN (1, 2, 3) GROUP BY 1",
)
def _(d):
    return tables.insert_rows(_json_rows(d), "id LONG, v STRING")[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# --- annotation ---------------------------------------------------------------------------------------------------
def count_words(texts: pd.Series) -> pd.DataFrame:
    """Example annotator: the summary is the number of words."""
    return pd.DataFrame({"resume_texte": texts.str.split().str.len().astype(str), "confidence_score": 0.9})


@query("udf1_normalize_search", "SELECT lang, count(*) AS n FROM (SELECT lang, lower(translate(text, '{a}', '{u}')) AS t FROM documents) WHERE contains(t, 'ee') GROUP BY lang".replace("{a}", lx.ACCENTED).replace("{u}", lx.UNACCENTED))
def _(d):
    ann.register_functions(d.spark)
    d.documents.createOrReplaceTempView("udf_documents")
    return d.spark.sql("SELECT lang, count(*) AS n FROM udf_documents WHERE contains(normalize_search(text), 'ee') GROUP BY lang")


@query("udf2_annotate", "SELECT doc_id AS id, 0.9::DOUBLE AS confidence_score FROM documents")
def _(d):
    return ann.annotate(d.documents.select(F.col("doc_id").alias("id"), "text"), count_words).select("id", "confidence_score")


@query("udf2_rule_annotation")
def _(d):
    out = ann.rule_annotation(d.documents.select(F.col("doc_id").alias("id"), "text"))
    return out.select("id", "indexable", F.size("personnes").alias("n_persons"), "emotion_valence")


@query("udf3_backfill_column", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE length(text) END AS n_letters FROM documents")
def _(d):
    docs = d.documents.withColumn("n_letters", F.when(F.col("doc_id") % 3 == 0, F.lit(-1).cast("long")))
    return ann.backfill_column(docs, "n_letters", "INTEGER", 0, lambda t: t.str.len()).select("doc_id", "n_letters")


@query("udf4_retry_failed", "SELECT id, 0.9::DOUBLE AS confidence_score FROM segments")
def _(d):
    seg = d.segments
    return ann.retry_failed(seg, seg.select("id", F.col("resume_texte").alias("text")), count_words).select("id", "confidence_score")


@query("udf5_find_matches", "SELECT doc_id, len(regexp_extract_all(lower(text), 'nter')) AS n FROM documents WHERE contains(lower(text), 'nter')")
def _(d):
    ann.register_functions(d.spark)
    d.documents.createOrReplaceTempView("udf_documents")
    return d.spark.sql("SELECT doc_id, count(*) AS n FROM udf_documents, LATERAL find_matches(text, 'nter') WHERE contains(lower(text), 'nter') GROUP BY doc_id")


# --- streaming -----------------------------------------------------------------------------------------------------
def live_segments(d, copies: int = 1):
    """The events table as a stream of segments; `copies` reads every file that often."""
    raw = jobs.file_stream(d.spark, d.sf_dir, d.spark.read.parquet(f"{d.sf_dir}/events.parquet").schema, "events.parquet")
    out = raw.select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("source_origine"),
        F.when(F.col("event_id") % 3 == 0, "human").otherwise("assistant").alias("auteur"),
        ((F.floor(F.col("value") * 100) % 201 - 100) / 100.0).alias("emotion_valence"),
        F.array(F.concat(F.lit("person"), F.col("user_id") % 7), F.concat(F.lit("person"), F.col("event_id") % 11)).alias("personnes"),
        F.concat(F.lit("u"), F.col("user_id") % 5, F.lit(".txt")).alias("source_file"), F.concat(F.col("event_type"), F.lit(" props "), F.col("props")).alias("text"),
    )
    return out


def _out(d, name):
    return scratch_path(d.spark, name), scratch_path(d.spark, name + "-ckpt")


@query("str1_ingest", "SELECT event_id AS id, 0.7::DOUBLE AS confidence_score FROM events")
def _(d):
    path, ckpt = _out(d, "ingest")
    live = live_segments(d).drop("emotion_valence", "personnes")
    jobs.start_ingest(live, ann.rule_annotation, path, ckpt)
    return d.spark.read.parquet(path).select("id", "confidence_score")


IDLE = "source STRING, received LONG"


@query("str2_idle_monitor", "SELECT source_file AS source, count(*) AS received FROM segments GROUP BY source_file")
def _(d):
    # timers need a running query: it ends once every source was reported quiet
    path, ckpt = _out(d, "idle")
    want = d.segments.select("source_file").distinct().count()

    def reported() -> bool:
        return d.spark.read.schema(IDLE).parquet(path).count() >= want

    jobs.run_until(jobs.idle_monitor(live_segments(d), "source_file", 1.0), path, ckpt, reported)
    return d.spark.read.schema(IDLE).parquet(path)


@query("str3_rolling_window")
def _(d):
    path, ckpt = _out(d, "rolling")
    raw = jobs.file_stream(d.spark, d.sf_dir, d.spark.read.parquet(f"{d.sf_dir}/conversations.parquet").schema, "conversations.parquet")
    jobs.run_once(jobs.rolling_window(raw, limit=400, overlap=100), path, ckpt)
    return d.spark.read.parquet(path)


@query("str4_dedup", "SELECT min(event_id) AS id FROM events GROUP BY event_type, ts")
def _(d):
    path, ckpt = _out(d, "dedup")
    live = live_segments(d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    jobs.run_once(jobs.dedup_stream(live), path, ckpt)
    return d.spark.read.parquet(path).select("id")


@query("str5_arrivals", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS received FROM events GROUP BY 1")
def _(d):
    path, ckpt = _out(d, "arrivals")
    parts = []
    jobs.run_batches(jobs.arrivals_stream(live_segments(d)), lambda df, n: parts.append(df.write.mode("overwrite").parquet(f"{path}/n={n}")), ckpt, "update")
    # each batch holds the windows that changed; the last one of a window counts
    last = d.spark.read.parquet(path).groupBy("window_start").agg(F.max_by("received", "n").alias("received"))
    return last.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "received")


@query("str5_live_counters", "SELECT count(*) AS received, CAST(count_if(event_id % 4 < 2) AS BIGINT) AS processed, CAST(count_if(event_id % 4 >= 2) AS BIGINT) AS pending, true AS idle FROM events")
def _(d):
    # the stream takes what is there, then more files come
    root, (path, ckpt) = scratch_path(d.spark, "inbox"), _out(d, "counters")
    parts = d.spark.read.parquet(f"{d.sf_dir}/events.parquet").withColumn("part", F.col("event_id") % 4)
    write = lambda which: parts.filter(which).repartition(3).write.mode("append").parquet(root)
    write("part < 2")
    stream = jobs.file_stream(d.spark, root, parts.schema, files_per_trigger=2)
    jobs.run_once(stream, path, ckpt)
    write("part >= 2")
    row = jobs.live_counters(d.spark, root, ckpt, datetime.now(timezone.utc))
    return row.select("received", "processed", "pending", (F.col("idle_seconds") > 0).alias("idle"))


DAY_SQL = "SELECT strftime(ts - INTERVAL 8 HOURS, '%Y-%m-%d') AS day, count(*) AS total, count_if(event_id % 3 = 0) AS human FROM events GROUP BY 1"


@query("str6_daily_digest", f"SELECT * FROM ({DAY_SQL}) WHERE day < (SELECT max(strftime(ts - INTERVAL 1 DAY - INTERVAL 8 HOURS, '%Y-%m-%d')) FROM events)")
def _(d):
    # append mode gives the windows the watermark has closed
    path, ckpt = _out(d, "digest")
    jobs.run_once(jobs.digest_stream(live_segments(d)), path, ckpt)
    rows = d.spark.read.parquet(path)
    return rows.select(F.date_format(F.col("window_start") - F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd").alias("day"), "total", "human")


@query("str6_batch_digest", "SELECT strftime(ts - INTERVAL 8 HOURS, '%Y-%m-%d') AS day, count(*) AS total FROM events GROUP BY 1")
def _(d):
    out = jobs.business_day_counts(d.segments)
    return out.select(F.date_format(F.col("window_start") - F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd").alias("day"), "total")


@query(
    "str6_sessions",
    """WITH g AS (SELECT concat('u', user_id % 5, '.txt') AS source_file, ts, ts - lag(ts) OVER (PARTITION BY user_id % 5 ORDER BY ts) AS gap FROM events),
    s AS (SELECT source_file, ts, count_if(gap IS NULL OR gap > INTERVAL 300 SECOND) OVER (PARTITION BY source_file ORDER BY ts) AS no FROM g)
    SELECT source_file, count(*) AS n FROM s GROUP BY source_file, no HAVING max(ts) + INTERVAL 300 SECOND <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
)
def _(d):
    path, ckpt = _out(d, "sessions")
    jobs.run_once(jobs.session_stream(live_segments(d), "source_file"), path, ckpt)
    return d.spark.read.parquet(path).select("source_file", "n")


@query("str7_entity_chain", PERSON_SQL.replace(", arg_min(e, pos) AS label", ""))
def _(d):
    edges, state = scratch_path(d.spark, "chain"), scratch_path(d.spark, "chain-state")
    _, ckpt = _out(d, "chain")
    jobs.run_batches(live_segments(d), jobs.entity_chain_batches("personnes", "LIEN_PERSONNE", edges, state), ckpt)
    return d.spark.read.parquet(edges).select("source_id", "target_id", "type", "poids")


@query("str7_entity_chain_batch", PERSON_SQL.replace(", arg_min(e, pos) AS label", ""))
def _(d):
    return graph.weave_entities(d.segments).select("source_id", "target_id", "type", "poids")


@query("str8_resume_files", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(d):
    # two runs over one checkpoint: the second finds nothing new
    path, ckpt = _out(d, "resume")
    for _ in range(2):
        jobs.run_once(live_segments(d).select("id", F.col("source_origine").alias("event_type")), path, ckpt)
    return d.spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))

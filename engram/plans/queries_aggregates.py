"""Queries: aggregates, ordered operators, sets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from engram.functions import formats, vector as vec
from engram.operators import aggregates as agg, embeddings as emb, windows as win
from engram.functions.text import token_count
from engram.operators.filters import AuditFilters
from engram.operators.joins import new_only
from engram.operators.search import ranked_union
from engram.plans.queries_filters import NOW, STAMP
from engram.plans.registry import query
from engram.sources.segments import fuse_sources


# --- aggregates ------------------------------------------------------------------------------------
@query(
    "agg1_corpus_stats",
    """SELECT count(*) AS total, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last_ts,
    round(avg(emotion_valence), 3) AS avg_valence, round(avg(emotion_activation), 3) AS avg_activation FROM segments""",
)
def _(d):
    out = agg.corpus_stats(d.segments)
    return out.withColumns({c: F.date_format(c, STAMP) for c in ("first_ts", "last_ts")})


@query("agg1_counts_by_nature", "SELECT source_nature, count(*) AS n FROM segments GROUP BY source_nature")
def _(d):
    return agg.count_by(d.segments, "source_nature")


@query("agg2_counts_by_day", "SELECT strftime(timestamp, '%Y-%m-%d') AS day, source_origine, count(*) AS n FROM segments GROUP BY ALL")
def _(d):
    return agg.count_by(d.segments, F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "source_origine")


@query(
    "agg3_quality_metrics",
    """SELECT count_if(resume_texte IS NULL OR length(resume_texte) < 10) AS without_summary, count_if(len(tags_roget) = 0) AS without_tags,
    count_if(len(personnes) = 0) AS without_persons, round(avg(emotion_valence), 3) AS avg_valence FROM segments WHERE auteur = 'assistant'""",
)
def _(d):
    return agg.quality_metrics(d.segments, AuditFilters(auteur="assistant"))


@query("agg3_top_authors", "SELECT auteur, count(*) AS n FROM segments GROUP BY auteur ORDER BY n DESC, auteur LIMIT 10")
def _(d):
    return agg.top_values(d.segments, "auteur")


@query(
    "agg3_repeated_summaries",
    "SELECT resume_texte, count(*) AS n FROM segments GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, resume_texte LIMIT 5",
)
def _(d):
    return agg.repeated_summaries(d.segments)


def _doubled(seg):
    """Segments as a live path and a batch path would store them: some arrive twice."""
    return seg.unionByName(seg.filter("source_origine = 'view'").withColumn("id", F.col("id") + 1_000_000_000))


DOUBLED = "(SELECT id, timestamp, source_origine FROM segments UNION ALL SELECT id + 1000000000, timestamp, source_origine FROM segments WHERE source_origine = 'view')"


@query(
    "agg4_duplicates",
    f"SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS ts, source_origine, count(*) AS n, min(id) AS keep_id FROM {DOUBLED} GROUP BY timestamp, source_origine HAVING count(*) > 1",
)
def _(d):
    dup = agg.find_duplicates(_doubled(d.segments))
    return dup.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "source_origine", "n", "keep_id")


@query(
    "agg4_duplicate_totals",
    f"""SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS involved, CAST(sum(n - 1) AS BIGINT) AS to_delete
    FROM (SELECT count(*) AS n FROM {DOUBLED} GROUP BY timestamp, source_origine HAVING count(*) > 1)""",
)
def _(d):
    return agg.duplicate_totals(_doubled(d.segments))


@query(
    "agg5_documents_view",
    """SELECT doc_id, arg_min(source_uri, chunk_index) AS source_uri, arg_min(domain, chunk_index) AS domain, count(*) AS chunk_count,
    CAST(sum(content_tokens) AS BIGINT) AS total_tokens FROM chunks GROUP BY doc_id""",
)
def _(d):
    return agg.documents_view(d.chunks).select("doc_id", "source_uri", "domain", "chunk_count", "total_tokens")


@query(
    "agg6_by_domain",
    "SELECT domain, count(DISTINCT doc_id) AS document_count, CAST(sum(content_tokens) AS BIGINT) AS total_tokens FROM chunks GROUP BY domain",
)
def _(d):
    return agg.group_view(d.chunks, "domain")


@query(
    "agg6_by_project",
    "SELECT project, count(DISTINCT doc_id) AS document_count, CAST(sum(content_tokens) AS BIGINT) AS total_tokens FROM chunks GROUP BY project",
)
def _(d):
    return agg.group_view(d.chunks, "project")


@query(
    "agg7_file_stats",
    """SELECT 'status' AS dimension, status AS value, count(*) AS n FROM files GROUP BY 2 UNION ALL SELECT 'domain', domain, count(*) FROM files GROUP BY 2
    UNION ALL (SELECT 'extension', extension, count(*) AS n FROM files GROUP BY 2 ORDER BY n DESC, extension LIMIT 10)""",
)
def _(d):
    return agg.file_stats(d.files)


@query(
    "agg8_extension_sizes",
    """SELECT extension, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, CAST(grouping(extension) AS BIGINT) AS is_total FROM files
    GROUP BY ROLLUP (extension)""",
)
def _(d):
    return agg.extension_sizes(d.files).withColumn("is_total", F.col("is_total").cast("long"))


@query(
    "agg9_daily_digest",
    """SELECT count(*) AS total, count_if(auteur = 'human') AS human, count_if(auteur = 'assistant') AS assistant, count_if(auteur = 'internal') AS internal,
    min(emotion_valence) AS valence_min, max(emotion_valence) AS valence_max, min(emotion_activation) AS activation_min, max(emotion_activation) AS activation_max
    FROM segments WHERE timestamp > TIMESTAMP '2024-01-30'""",
)
def _(d):
    return agg.daily_digest(d.segments, NOW, 24)


@query(
    "agg9_digest_entities",
    """WITH day AS (SELECT * FROM segments WHERE timestamp > TIMESTAMP '2024-01-30')
    SELECT 'personne' AS kind, name, count(*) AS n FROM (SELECT unnest(personnes) AS name FROM day) GROUP BY name
    UNION ALL SELECT 'projet', name, count(*) FROM (SELECT unnest(projets) AS name FROM day) GROUP BY name
    UNION ALL SELECT 'nature', source_nature, count(*) FROM day GROUP BY source_nature""",
)
def _(d):
    return agg.digest_entities(d.segments, NOW, 24)


@query(
    "agg10_fact_stats",
    """SELECT domaine, CAST(importance AS BIGINT) AS importance, count(*) AS n, strftime(max(derniere_maj), '%Y-%m-%d') AS last_update
    FROM facts GROUP BY GROUPING SETS ((domaine), (importance), ())""",
)
def _(d):
    out = agg.fact_stats(d.facts)
    return out.select("domaine", F.col("importance").cast("long"), "n", F.date_format("last_update", "yyyy-MM-dd").alias("last_update"))


CLASS_SQL = r"""CASE WHEN length(t) < 20 THEN 'court' WHEN code > 2 AND talk > 2 THEN 'mixte' WHEN code > 2 AND (t[1] = '{' OR t[1] = '[') THEN 'json'
  WHEN code > 2 THEN 'code' ELSE 'texte' END"""
SIGNS_SQL = r"""SELECT doc_id, x, trim(x, ' ' || chr(10)) AS t,
  CAST(starts_with(trim(x), '{') AND ends_with(trim(x), '}') AS INT) + CAST(starts_with(trim(x), '[') AND ends_with(trim(x), ']') AS INT)
  + CAST(contains(x, '```') AS INT) + CAST(contains(x, 'def ') AND contains(x, ':') AS INT) + CAST(contains(x, 'function ') AS INT)
  + CAST(contains(x, 'import ') AS INT) + CAST(contains(x, 'class ') AND contains(x, ':') AS INT) + CAST(contains(lower(x), 'curl ') AS INT)
  + CAST(contains(x, '"action":') AS INT) + CAST(contains(x, '"status":') AS INT) AS code,
  CAST(contains(lower(x), 'je ') AS INT) + CAST(contains(lower(x), 'tu ') AS INT) + CAST(contains(lower(x), 'nous ') AS INT)
  + CAST(contains(lower(x), 'merci') AS INT) + CAST(contains(lower(x), 'bonjour') AS INT) + CAST(contains(x, '?') AS INT) + CAST(contains(x, '!') AS INT) AS talk
  FROM s"""
MIXED_SQL = """s AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat('{"action": "x", "status": 1, "t": "', text, 'import "}')
   WHEN 1 THEN concat('def f(x): class A: import os; ', text) WHEN 2 THEN concat('Bonjour ! je tu nous ? def f(x): class A: import os function g ', text)
   WHEN 3 THEN substring(text, 1, 12) ELSE text END AS x FROM documents)"""


def mixed_texts(d):
    """Documents dressed up as code, JSON, talk and short answers."""
    t, k = F.col("text"), F.col("doc_id") % 5
    x = (
        F.when(k == 0, F.concat(F.lit('{"action": "x", "status": 1, "t": "'), t, F.lit('import "}')))
        .when(k == 1, F.concat(F.lit("def f(x): class A: import os; "), t))
        .when(k == 2, F.concat(F.lit("Bonjour ! je tu nous ? def f(x): class A: import os function g "), t))
        .when(k == 3, F.substring(t, 1, 12))
        .otherwise(t)
    )
    return d.documents.select("doc_id", x.alias("text"))


@query(
    "agg11_failure_histogram",
    f"""WITH {MIXED_SQL}, g AS ({SIGNS_SQL}), c AS (SELECT {CLASS_SQL} AS content_class FROM g)
    SELECT content_class, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM c), 2) AS percent FROM c GROUP BY 1""",
)
def _(d):
    return agg.failure_histogram(mixed_texts(d))


@query(
    "agg13_corpus_profile",
    """SELECT count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS chars,
    (SELECT count(*) FROM (SELECT unnest(string_split(text, chr(10) || chr(10))) AS p FROM documents) WHERE length(p) > 50) AS paragraphs FROM documents""",
)
def _(d):
    docs = d.documents
    kept = docs.select(F.explode(F.split("text", "\n\n")).alias("p")).filter(F.length("p") > 50)
    return agg.corpus_profile(docs, kept)


@query(
    "agg15_messages_per_day",
    """SELECT strftime(timestamp - INTERVAL 8 HOURS, '%Y-%m-%d') AS day, count(*) AS messages, count_if(NOT (timestamp > TIMESTAMP '2024-01-04')) AS skipped,
    count_if(timestamp > TIMESTAMP '2024-01-04') AS processed FROM segments GROUP BY 1""",
)
def _(d):
    out = agg.messages_per_day(d.segments.withColumnRenamed("resume_texte", "text"), datetime(2024, 1, 4))
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "agg16_fusion_stats",
    """SELECT strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS exchanges, count(DISTINCT source_origine) AS n_sources,
    string_agg(DISTINCT source_origine, ',' ORDER BY source_origine) AS sources FROM segments GROUP BY 1""",
)
def _(d):
    out = agg.fusion_stats(d.segments.withColumnRenamed("source_origine", "source"))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "exchanges", "n_sources", "sources")


@query(
    "agg17_vector_stats",
    """SELECT 1 AS position, count(*) AS n, round(avg(round(emotion_valence, 3)), 6) AS mean_value FROM segments WHERE emotion_valence <> 0
    UNION ALL SELECT 2, count(*), round(avg(round(emotion_activation, 3)), 6) FROM segments WHERE emotion_activation <> 0""",
)
def _(d):
    stats = vec.vector_stats(vec.vectorise(d.wide("segments"))).filter("position <= 2")
    return stats.select("position", "n", F.round("mean_value", 6).alias("mean_value"))


@query(
    "agg18_summary_lines",
    """SELECT string_agg(concat('- ', resume_texte), chr(10) ORDER BY id) AS text FROM (SELECT id, resume_texte FROM segments WHERE auteur = 'human' ORDER BY id LIMIT 5)""",
)
def _(d):
    return agg.summary_lines(d.segments.filter("auteur = 'human'"), "id", F.col("resume_texte"))


@query(
    "agg20_import_report",
    """SELECT CASE WHEN doc_id % 7 = 0 THEN 'skipped' WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'processed' END AS outcome,
    CASE WHEN doc_id % 7 = 0 THEN 'indexed' WHEN doc_id % 11 = 0 THEN lang ELSE '' END AS reason, count(*) AS files,
    CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS exchanges FROM documents GROUP BY ALL""",
)
def _(d):
    k = F.col("doc_id")
    status = d.documents.select(
        F.when(k % 7 == 0, "skipped").when(k % 11 == 0, "failed").otherwise("processed").alias("outcome"),
        F.when(k % 7 == 0, F.lit("indexed")).when(k % 11 == 0, F.col("lang")).alias("reason"),
        F.size(F.split("text", "\n")).alias("exchanges"),
    )
    return agg.import_report(status)


# --- ordered operators -------------------------------------------------------------------------------
@query(
    "win1_significant_changes",
    """WITH p AS (SELECT *, lag(timestamp) OVER w AS pt, lag(auteur) OVER w AS pa, lag(tags_roget[1]) OVER w AS pg, lag(emotion_valence) OVER w AS pv,
      lag(coalesce(nullif(emotion_activation, 0), 0.5)) OVER w AS pc, row_number() OVER w AS rn
      FROM (SELECT id, source_file, CAST(timestamp AS DATE) AS timestamp, auteur, [substring(tags_roget[1], 1, 2)] AS tags_roget, emotion_valence, emotion_activation FROM segments)
      WINDOW w AS (PARTITION BY source_file ORDER BY id))
    SELECT id FROM p WHERE rn = 1 OR timestamp <> pt OR auteur <> pa OR tags_roget[1] <> pg OR abs(emotion_valence - pv) > 0.3::DOUBLE
      OR abs(coalesce(nullif(emotion_activation, 0), 0.5) - pc) > 0.3::DOUBLE""",
)
def _(d):
    seg = d.segments.select(
        "id", "source_file", F.to_date("timestamp").alias("timestamp"), "auteur", F.array(F.substring(F.col("tags_roget")[0], 1, 2)).alias("tags_roget"),
        "emotion_valence", "emotion_activation",
    )
    return win.significant_changes(seg, order=("id",), carry=None).select("id")


@query(
    "win2_token_offsets",
    """SELECT conv_id, turn, CAST(floor(length(text) / 4.0) AS BIGINT) AS token_count,
    CAST(coalesce(sum(CAST(floor(length(text) / 4.0) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS token_start,
    CAST(sum(CAST(floor(length(text) / 4.0) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS token_end FROM exchanges""",
)
def _(d):
    counts = d.exchanges.select("conv_id", "turn", token_count(F.col("text")).alias("token_count"))
    return win.token_offsets(counts, count="token_count").select("conv_id", "turn", "token_count", "token_start", "token_end")


@query(
    "win3_carry_block_id",
    "SELECT id, max(gr_id) OVER (ORDER BY timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_gr_id FROM segments",
)
def _(d):
    return win.carry_block_id(d.segments.select("id", "timestamp", "gr_id"), order=("timestamp", "id")).select("id", "last_gr_id")


@query(
    "win4_dedup_keep_first",
    f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY timestamp, source_origine ORDER BY id) AS rn FROM {DOUBLED}) WHERE rn = 1",
)
def _(d):
    return win.dedup_keep_first(_doubled(d.segments))[0].select("id")


@query(
    "win4_dedup_removed",
    f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY timestamp, source_origine ORDER BY id) AS rn FROM {DOUBLED}) WHERE rn > 1",
)
def _(d):
    return win.dedup_keep_first(_doubled(d.segments))[1].select("id")


@query(
    "win5_context_budget",
    """SELECT source_file, id, CAST(25 + coalesce(sum(length(resume_texte)) OVER (PARTITION BY source_file ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars_before,
    25 + sum(length(resume_texte)) OVER (PARTITION BY source_file ORDER BY id) <= 4000 AS kept FROM segments""",
)
def _(d):
    sizes = d.segments.select("source_file", "id", F.length("resume_texte").alias("size"))
    out = win.context_budget(sizes, 1000, by="source_file", rank="id", size="size")
    return out.select("source_file", "id", "chars_before", "kept")


@query(
    "win6_top_k_per_group",
    """SELECT source_file, id, rank FROM (SELECT source_file, id, row_number() OVER (PARTITION BY source_file ORDER BY emotion_valence DESC, id) AS rank FROM segments) WHERE rank <= 5""",
)
def _(d):
    out = win.top_k(d.segments, ["source_file"], [F.desc("emotion_valence"), F.asc("id")], 5)
    return out.select("source_file", "id", F.col("rank").cast("long"))


@query(
    "win7_first_last",
    """SELECT source_origine, arg_min(id, (timestamp, id)) AS first_id, CASE WHEN count(*) > 1 THEN arg_max(id, (timestamp, id)) END AS last_id, count(*) AS n,
    greatest(count(*) - 2, 0) AS others FROM segments GROUP BY source_origine""",
)
def _(d):
    out = win.first_last(d.segments, ["source_origine"], ["timestamp", "id"], ["resume_texte"])
    return out.select("source_origine", F.col("first.id").alias("first_id"), F.col("last.id").alias("last_id"), "n", "others")


@query("win8_recent_documents", "SELECT doc_id, chunk_id FROM chunks WHERE chunk_index = 0 ORDER BY indexed_at DESC, doc_id LIMIT 100")
def _(d):
    return win.recent_documents(d.chunks).select("doc_id", "chunk_id")


@query(
    "win9_merge_short",
    """WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 OR conv_id % 5 = 0 THEN substring(text, 1, 7) ELSE text END AS text FROM exchanges),
    k AS (SELECT *, sum(CASE WHEN length(text) >= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM l)
    SELECT conv_id, min(turn) AS turn, md5(string_agg(text, ' ' ORDER BY turn)) AS digest, count(*) AS n_merged FROM k GROUP BY conv_id, island""",
)
def _(d):
    short = (F.col("turn") % 3 == 2) | (F.col("conv_id") % 5 == 0)
    ex = d.exchanges.withColumn("text", F.when(short, F.substring("text", 1, 7)).otherwise(F.col("text")))
    out = win.merge_short(ex.select("conv_id", "turn", "text"))
    return out.select("conv_id", "turn", F.md5("text").alias("digest"), "n_merged")


@query(
    "win10_last_n_pairs",
    """WITH r AS (SELECT source_origine, id, row_number() OVER (PARTITION BY source_origine ORDER BY timestamp, id) AS rn FROM segments)
    SELECT a.id, b.id AS prev_id, a.rn - b.rn AS gap FROM r a JOIN r b ON a.source_origine = b.source_origine AND a.rn - b.rn BETWEEN 1 AND 3""",
)
def _(d):
    from engram.operators.ordered import last_n_pairs

    return last_n_pairs(d.segments, ["source_origine"], ["timestamp", "id"], 3, ["id"]).select("id", "prev_id", "gap")


@query(
    "win11_chunk_sizes",
    r"""WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '\s*\S+|\s+$')) AS n, length(text) AS chars FROM documents)
    SELECT doc_id, n AS n_tokens, chars FROM t""",
)
def _(d):
    # chunks must give every text back whole
    chunks = win.chunk_tokens(d.wide("documents").select("doc_id", "text"), size=400)
    return chunks.groupBy("doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"), F.sum(F.length("content")).cast("long").alias("chars")
    )


@query(
    "win11_overlap_tail",
    r"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '\s*\S+|\s+$') AS w FROM documents)
    SELECT doc_id, md5(CASE WHEN len(w) <= 100 THEN text ELSE array_to_string(w[-100:], '') END) AS digest FROM t""",
)
def _(d):
    return d.documents.select("doc_id", F.md5(win.overlap_tail(F.col("text"), 100)).alias("digest"))


@query(
    "win12_batch_no",
    "SELECT id, CAST(floor((row_number() OVER (PARTITION BY source_file ORDER BY timestamp, id) - 1) / 5) AS BIGINT) AS batch FROM segments",
)
def _(d):
    return win.batch_no(d.segments.select("id", "timestamp", "source_file"), ["timestamp", "id"], 5, ["source_file"]).select("id", "batch")


@query(
    "win13_fallback_fill",
    """SELECT id, CASE WHEN ok THEN emotion_valence ELSE last_value(CASE WHEN ok THEN emotion_valence END IGNORE NULLS) OVER
      (PARTITION BY source_file ORDER BY timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS emotion_valence,
    CASE WHEN ok THEN resume_texte ELSE '[Extraction échouée - contexte précédent]' END AS resume_texte FROM (SELECT *, id % 3 <> 0 AS ok FROM segments)""",
)
def _(d):
    ann = d.segments.select("id", "timestamp", "source_file", "emotion_valence", "tags_roget", "resume_texte", (F.col("id") % 3 != 0).alias("ok"))
    out = win.fallback_fill(ann, ["timestamp", "id"], ["source_file"], fields=["emotion_valence", "tags_roget"])
    return out.select("id", "emotion_valence", "resume_texte")


@query("topk1_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def _(d):
    return win.topk(d.orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 25, 10).select("o_orderkey", "o_totalprice")


# --- sets ----------------------------------------------------------------------------------------------
@query(
    "set1_fuse_sources",
    """SELECT conv_id, turn, CASE WHEN auteur = 'human' THEN 'chat' ELSE 'mail' END AS source FROM exchanges""",
)
def _(d):
    ex = d.exchanges.withColumn("timestamp", F.timestamp_seconds(F.col("conv_id") * 3600 + F.col("turn")))
    return fuse_sources({"chat": ex.filter("auteur = 'human'"), "mail": ex.filter("auteur <> 'human'")}).select("conv_id", "turn", "source")


@query(
    "set3_ranked_union",
    """WITH h AS (SELECT id, timestamp, 0 AS r FROM segments WHERE contains(resume_texte, 'error') UNION ALL SELECT id, timestamp, 1 FROM segments WHERE contains(resume_texte, 'user 1')),
    b AS (SELECT id, min(r) AS term_rank, max(timestamp) AS t FROM h GROUP BY id) SELECT id, term_rank FROM b ORDER BY term_rank, t DESC, id LIMIT 2500""",
)
def _(d):
    s = d.segments
    hits = s.filter(F.contains("resume_texte", F.lit("error"))).withColumn("term_rank", F.lit(0)).unionByName(
        s.filter(F.contains("resume_texte", F.lit("user 1"))).withColumn("term_rank", F.lit(1))
    )
    return ranked_union(hits, 2500).select("id", "term_rank")


@query("set4_pending", "SELECT id FROM files WHERE content_hash NOT IN (SELECT content_hash FROM files WHERE status = 'enriched')")
def _(d):
    return new_only(d.files, d.files.filter("status = 'enriched'"), ["content_hash"]).select("id")


@query("set5_distinct_entities", "SELECT DISTINCT unnest(personnes) AS name FROM segments UNION SELECT DISTINCT unnest(projets) FROM segments")
def _(d):
    return d.segments.select(F.explode(F.array_union("personnes", "projets")).alias("name")).distinct()


@query(
    "fn9_human_size",
    """SELECT id, CASE WHEN v = 0 THEN '?' WHEN v < 1024 THEN concat(CAST(v AS VARCHAR), ' o') WHEN v < 1048576 THEN format('{:.1f} Ko', v / 1024.0::DOUBLE)
    WHEN v < 1073741824 THEN format('{:.1f} Mo', v / 1048576.0::DOUBLE) WHEN v < 1099511627776 THEN format('{:.1f} Go', v / 1073741824.0::DOUBLE)
    ELSE format('{:.1f} To', v / 1099511627776.0::DOUBLE) END AS size FROM (SELECT id, CAST(size * (id % 4) * (id % 4) * (id % 3) * size * 7 AS BIGINT) AS v FROM files)""",
)
def _(d):
    k = F.col("id")
    v = F.col("size") * (k % 4) * (k % 4) * (k % 3) * F.col("size") * 7
    return d.files.select("id", formats.human_size(v).alias("size"))


@query(
    "emb1_corpus",
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(translate(text, '{a}', '{u}'), '[^\x00-\x7F]', '', 'g')), '[a-z0-9]+') AS w FROM documents WHERE length(text) > 50),
    k AS (SELECT doc_id, list_filter(w, lambda x: length(x) > 2 AND NOT list_contains([{stop}], x)) AS w FROM t)
    SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS digest FROM k WHERE len(w) > 5""".replace("{a}", emb.lx.ACCENTED)
    .replace("{u}", emb.lx.UNACCENTED).replace("{stop}", ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(emb.lx.CORPUS_STOPWORDS)))),
)
def _(d):
    corpus = emb.build_corpus(d.wide("documents"), "doc_id")
    return corpus.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest"))

"""Queries: graph, search, text features, scalar functions."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from engram.functions import lexicon as lx, records as rec, scores, text as tx, vector as vec
from engram.operators import embeddings as emb, fulltext as fts, grams, graph, profiles, search, wordvectors
from engram.operators.filters import get_pillars
from engram.operators.mutations import EDGE_KEY
from engram.plans.queries_aggregates import CLASS_SQL, MIXED_SQL, SIGNS_SQL, mixed_texts
from engram.plans.queries_filters import NOW
from engram.plans.registry import query
from engram.session import materialise, scratch_path, stored

ENTITY_SQL = """SELECT prev_id AS source_id, id AS target_id, '{kind}' AS type, 1.5::DOUBLE AS poids, arg_min(e, pos) AS label FROM (
  SELECT id, e, pos, lag(id) OVER (PARTITION BY e ORDER BY timestamp, id) AS prev_id FROM (
    SELECT id, timestamp, e, min(pos) AS pos FROM (SELECT id, timestamp, unnest({col}) AS e, generate_subscripts({col}, 1) AS pos FROM segments) GROUP BY id, timestamp, e))
  WHERE prev_id IS NOT NULL GROUP BY prev_id, id"""
PERSON_SQL = ENTITY_SQL.format(kind="LIEN_PERSONNE", col="personnes")
PROJECT_SQL = ENTITY_SQL.format(kind="LIEN_PROJET", col="projets")
EMOTION_SQL = """SELECT b.id AS source_id, a.id AS target_id, 'RESONANCE_EMOTION' AS type, 1.2::DOUBLE AS poids, CAST(round(a.v, 2) AS VARCHAR) AS label FROM p a JOIN p b ON a.rn - b.rn BETWEEN 1 AND 20
  WHERE sqrt((a.v - b.v) * (a.v - b.v) + (a.c - b.c) * (a.c - b.c)) < 0.10::DOUBLE"""
PEAKS_CTE = """p AS (SELECT id, emotion_valence AS v, coalesce(nullif(emotion_activation, 0), 0.5) AS c, row_number() OVER (ORDER BY timestamp, id) AS rn FROM segments WHERE abs(emotion_valence) >= 0.6)"""
BLOCK_SQL = """SELECT a.id AS source_id, b.id AS target_id, 'MEME_GROUPE' AS type, 1.8::DOUBLE AS poids, CAST(a.gr_id AS VARCHAR) AS label FROM segments a JOIN segments b ON a.gr_id = b.gr_id AND a.source_file = b.source_file
  AND (a.timestamp, a.id) < (b.timestamp, b.id)"""
TAG_CTE = """t AS (SELECT id, tags_roget[1] AS tag, row_number() OVER (PARTITION BY tags_roget[1] ORDER BY timestamp, id) AS rn FROM segments)"""
TAG_SQL = """SELECT b.id AS source_id, a.id AS target_id, 'TAGS_PARTAGES' AS type, 1.3::DOUBLE AS poids, a.tag AS label FROM t a JOIN t b ON a.tag = b.tag AND a.rn - b.rn BETWEEN 1 AND 10"""
ALL_EDGES_CTE = f"""{PEAKS_CTE}, {TAG_CTE}, edges AS ({PERSON_SQL} UNION ALL {PROJECT_SQL} UNION ALL {EMOTION_SQL} UNION ALL {BLOCK_SQL} UNION ALL {TAG_SQL})"""


def labelled(edges, key):
    return edges.select(*EDGE_KEY, "poids", F.col("metadata")[key].alias("label"))


@query("graph1_person_chain", PERSON_SQL)
def _(d):
    return labelled(graph.weave_entities(d.wide("segments"), "personnes", "LIEN_PERSONNE"), "sujet")


@query("graph1_project_chain", PROJECT_SQL)
def _(d):
    return labelled(graph.weave_entities(d.wide("segments"), "projets", "LIEN_PROJET"), "sujet")


@query("graph2_emotion_resonance", f"WITH {PEAKS_CTE} {EMOTION_SQL}")
def _(d):
    return labelled(graph.weave_emotions(d.wide("segments")), "val")


@query("graph3_block_edges", BLOCK_SQL)
def _(d):
    return labelled(graph.weave_blocks(d.wide("segments")), "gr_id")


@query(
    "graph3_large_block_members",
    """SELECT gr_id, source_file, id, count(*) OVER (PARTITION BY gr_id, source_file) AS size FROM (SELECT id % 7 AS gr_id, source_file, id FROM segments)""",
)
def _(d):
    # a few huge blocks: their pairs are never written out
    seg = d.segments.withColumn("gr_id", F.col("id") % 7)
    return graph.block_members(seg).select("gr_id", "source_file", "id", "size")


@query("graph4_shared_tags", f"WITH {TAG_CTE} {TAG_SQL}")
def _(d):
    return labelled(graph.weave_tags(d.wide("segments")), "tag")


@query("graph5_version_links", """SELECT a.id AS source_id, b.id AS target_id, 'LIEN_VERSION' AS type, 2.0::DOUBLE AS poids FROM segments a JOIN segments b ON b.id = a.id + 50 WHERE a.id % 50 < 5""")
def _(d):
    from engram.operators.joins import link_versions
    from engram.operators.mutations import insert_edges

    pairs = d.segments.filter("id % 50 < 5").select(F.col("id").alias("source_id"), (F.col("id") + 50).alias("target_id"))
    good = link_versions(pairs, d.segments)[0].withColumn("metadata", F.create_map().cast("map<string,string>"))
    stored = good.withColumn("poids", F.lit(1.0))
    return insert_edges(stored, good, "replace").select(*EDGE_KEY, "poids")


@query("graph6_rebuild", f"WITH {ALL_EDGES_CTE} SELECT source_id, target_id, type, poids FROM edges UNION ALL SELECT id, id + 1, 'CORRIGE_PAR', 1.0 FROM segments WHERE id % 100 = 0")
def _(d):
    manual = d.segments.filter("id % 100 = 0").select(
        F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"), F.lit("CORRIGE_PAR").alias("type"), F.lit(1.0).alias("poids"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )
    stale = manual.withColumn("type", F.lit("TAGS_PARTAGES"))
    seg = d.wide("segments")
    return graph.rebuild_graph(seg, manual.unionByName(stale)).unionByName(graph.weave_blocks(seg)).select(*EDGE_KEY, "poids")


@query("graph6_counts", f"WITH {ALL_EDGES_CTE} SELECT type, count(*) AS n FROM edges GROUP BY type")
def _(d):
    return graph.graph_counts(graph.rebuild_graph(d.wide("segments")), graph.block_members(d.wide("segments")))


@query("set2_union_edges", f"WITH {PEAKS_CTE}, u AS ({PERSON_SQL} UNION ALL {PROJECT_SQL} UNION ALL {EMOTION_SQL}) SELECT type, count(*) AS n FROM u GROUP BY type")
def _(d):
    seg = d.wide("segments")
    person, project = graph.weave_entities(seg), graph.weave_entities(seg, "projets", "LIEN_PROJET")
    return graph.graph_counts(graph.union_edges(person, project, person.withColumn("poids", F.lit(9.0)), graph.weave_emotions(seg)))


STARTS_SQL = "(SELECT min(id) AS start FROM segments GROUP BY source_file, source_origine)"


def starts(d):
    """One start per file and origin: as many as there are such pairs, not a fixed list."""
    return d.segments.groupBy("source_file", "source_origine").agg(F.min("id").alias("id"))


BOTH = "both_ways AS (SELECT source_id AS here, target_id AS there, type, poids FROM edges UNION ALL SELECT target_id, source_id, type, poids FROM edges)"


@query(
    "join1_neighbours",
    f"""WITH {ALL_EDGES_CTE}, {BOTH} SELECT s.start AS id, b.there AS linked_id, b.type AS link_type, b.poids FROM {STARTS_SQL} s JOIN both_ways b ON b.here = s.start WHERE b.type IN ('LIEN_PERSONNE', 'TAGS_PARTAGES', 'MEME_GROUPE')""",
)
def _(d):
    edges = materialise(graph.rebuild_graph(d.wide("segments")))
    members = graph.block_members(d.wide("segments"))
    return graph.neighbours(edges, d.segments, starts(d), ["LIEN_PERSONNE", "TAGS_PARTAGES", "MEME_GROUPE"], members).select("id", "linked_id", "link_type", "poids")


EXPLORE_SQL = f"""WITH {ALL_EDGES_CTE}, {BOTH},
  l1 AS (SELECT s.start, b.there AS node, max(b.poids) AS poids, 1 AS depth FROM {STARTS_SQL} s JOIN both_ways b ON b.here = s.start WHERE b.there <> s.start GROUP BY ALL),
  l2 AS (SELECT l1.start, b.there AS node, max(b.poids) AS poids, 2 AS depth FROM l1 JOIN both_ways b ON b.here = l1.node
         WHERE b.there <> l1.start AND NOT EXISTS (SELECT 1 FROM l1 v WHERE v.start = l1.start AND v.node = b.there) GROUP BY l1.start, b.there),
  a AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2),
  r AS (SELECT a.*, row_number() OVER (PARTITION BY start ORDER BY poids DESC, timestamp, node) AS rank FROM a JOIN segments s ON s.id = a.node)
  SELECT start AS id, node AS linked_id, poids, depth, rank FROM r WHERE rank <= 50"""


@query("graph7_explore_depth2", EXPLORE_SQL)
def _(d):
    edges = materialise(graph.rebuild_graph(d.wide("segments")))
    out = graph.explore_links(edges, d.segments, starts(d), depth=2, max_results=50, members=materialise(graph.block_members(d.wide("segments"))))
    return out.select("id", "linked_id", "poids", "depth", F.col("rank").cast("long").alias("rank"))


DEPTH3_SQL = EXPLORE_SQL.replace("  a AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2)", """  l3 AS (SELECT l2.start, b.there AS node, max(b.poids) AS poids, 3 AS depth FROM l2 JOIN both_ways b ON b.here = l2.node
         WHERE b.there <> l2.start AND NOT EXISTS (SELECT 1 FROM l1 v WHERE v.start = l2.start AND v.node = b.there) AND NOT EXISTS (SELECT 1 FROM l2 v WHERE v.start = l2.start AND v.node = b.there) GROUP BY l2.start, b.there),
  a AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)""")


@query("graph7_explore_stored", DEPTH3_SQL)
def _(d):
    # edges stored at both ends and read back, three hops
    path = scratch_path(d.spark, "adjacency")
    seg = d.wide("segments")
    graph.store_adjacency(graph.rebuild_graph(seg), path)
    out = graph.explore_links(graph.read_adjacency(d.spark, path), seg, starts(d), depth=3, max_results=50, members=materialise(graph.block_members(seg)))
    return out.select("id", "linked_id", "poids", "depth", F.col("rank").cast("long").alias("rank"))


@query(
    "graph7_explore_large_blocks",
    f"""WITH b AS (SELECT id, timestamp, id % 7 AS gr_id, source_file FROM segments),
    r AS (SELECT s.start, o.id AS node, row_number() OVER (PARTITION BY s.start ORDER BY o.timestamp, o.id) AS rank FROM {STARTS_SQL} s JOIN b m ON m.id = s.start
      JOIN b o ON o.gr_id = m.gr_id AND o.source_file = m.source_file AND o.id <> s.start)
    SELECT start AS id, node AS linked_id, 1.8::DOUBLE AS poids, rank FROM r WHERE rank <= 10""",
)
def _(d):
    seg = d.segments.withColumn("gr_id", F.col("id") % 7)
    members = graph.block_members(seg)
    edges = graph.weave_tags(seg)
    out = graph.explore_links(edges, seg, starts(d), types=["meme_groupe"], members=members)
    return out.select("id", "linked_id", "poids", F.col("rank").cast("long").alias("rank"))


@query("agg12_link_histogram", EXPLORE_SQL.replace("SELECT start AS id, node AS linked_id, poids, depth, rank FROM r WHERE rank <= 50", "SELECT depth, count(*) AS n FROM r WHERE rank <= 50 GROUP BY depth"))
def _(d):
    edges = materialise(graph.rebuild_graph(d.wide("segments")))
    out = graph.explore_links(edges, d.segments, starts(d), depth=2, max_results=50, members=materialise(graph.block_members(d.wide("segments"))))
    return out.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


TYPED_SQL = EXPLORE_SQL.replace("max(b.poids) AS poids,", "max(b.poids) AS poids, min({'w': -b.poids, 't': b.type}).t AS type,").replace(
    "SELECT start AS id, node AS linked_id, poids, depth, rank FROM r WHERE rank <= 50", "SELECT type AS link_type, count(*) AS n FROM r WHERE rank <= 50 GROUP BY type"
)


@query("agg12_link_types", TYPED_SQL)
def _(d):
    from engram.operators.aggregates import link_histogram

    edges = materialise(graph.rebuild_graph(d.wide("segments")))
    members = materialise(graph.block_members(d.wide("segments")))
    return link_histogram(graph.explore_links(edges, d.segments, starts(d), depth=2, max_results=50, members=members))


@query("graph8_typed_links", "SELECT id AS source_id, id + 2 AS target_id, CASE id % 3 WHEN 0 THEN 'GENEALOGIE' ELSE 'EVOLUE_VERS' END AS type FROM segments WHERE id % 3 < 2")
def _(d):
    k = F.col("id") % 3
    rows = d.segments.select(
        F.col("id").alias("source_id"), (F.col("id") + 2).alias("target_id"), F.when(k == 0, "GENEALOGIE").when(k == 1, "EVOLUE_VERS").otherwise("AUTRE").alias("type")
    )
    return graph.typed_links(rows).select(*EDGE_KEY)


@query(
    "graph9_latest_version",
    """SELECT id, max(id) OVER (PARTITION BY CASE WHEN id % 10 < 4 THEN id % 10 ELSE id + 100000 END) AS latest_id FROM segments""",
)
def _(d):
    # four chains through the whole table: id -> id + 10 for the last digits 0 to 3
    edges = d.segments.select(F.col("id").alias("source_id"), F.lead("id").over(_chain()).alias("target_id"), F.lit("LIEN_VERSION").alias("type"))
    linked = edges.filter("source_id % 10 < 4 AND target_id IS NOT NULL")
    return graph.latest_version(linked, d.segments)


def _chain():
    from pyspark.sql import Window as W

    return W.partitionBy(F.col("id") % 10).orderBy("id")


# --- search --------------------------------------------------------------------------------------------------
SEARCHES = [
    search.Query(1, "erreurs", keywords=["error", "user 1"], tags=["01-0060-0100", "03-0020-0000"], emotion=(0.7, 0.5)),
    search.Query(2, "person3", persons=["Person3", "person10"], weights={"tags_roget": 0.2, "emotion": 0.2, "timestamp": 0.2, "personnes": 0.4, "resume_texte": 0.0}, top_k=8),
    search.Query(3, "tout", start=datetime(2024, 1, 10), end=datetime(2024, 1, 20), emotion=(-0.7, 0.5), top_k=10),
]

PROXIMITY = """list_max([CASE WHEN split_part(q, '-', 1) <> split_part(tag, '-', 1) THEN 0.1 WHEN split_part(q, '-', 2) <> split_part(tag, '-', 2)
  THEN 0.3 + 0.3 * (1 - least(abs(CAST(split_part(q, '-', 2) AS INT) - CAST(split_part(tag, '-', 2) AS INT)) / 100.0, 1))
  ELSE 0.7 + 0.3 * (1 - least(abs(CAST(split_part(q, '-', 3) AS INT) - CAST(split_part(tag, '-', 3) AS INT)) / 100.0, 1)) END::DOUBLE FOR q IN tags])"""
COSINE = """CASE WHEN sqrt(v * v + a * a) * sqrt(ev * ev + ea * ea) = 0 THEN 0.5 ELSE ((v * ev + a * ea) / (sqrt(v * v + a * a) * sqrt(ev * ev + ea * ea)) + 1) / 2 END"""
# resonance: positions 1 and 2 hold valence and activation, the class of the only tag holds 0.8
SEARCH_CTE = f"""q(query_id, keywords, tags, persons, t0, t1, ev, ea, w_tags, w_emotion, w_time, w_persons, w_summary, top_k) AS (VALUES
  (1, ['error', 'user 1'], ['01-0060-0100', '03-0020-0000'], []::VARCHAR[], NULL::TIMESTAMP, NULL::TIMESTAMP, 0.7::DOUBLE, 0.5::DOUBLE, 0.3::DOUBLE, 0.3::DOUBLE, 0.3::DOUBLE, 0.0::DOUBLE, 0.1::DOUBLE, 5),
  (2, []::VARCHAR[], []::VARCHAR[], ['person3', 'person10'], NULL, NULL, NULL, NULL, 0.2, 0.2, 0.2, 0.4, 0.0, 8),
  (3, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-20', -0.7, 0.5, 0.3, 0.3, 0.3, 0.0, 0.1, 10)),
 s AS (SELECT id, timestamp, resume_texte, lower(resume_texte) AS low, sujets, projets, lieux, personnes, array_to_string(personnes, ' ') AS people, tags_roget[1] AS tag, emotion_valence AS v, emotion_activation AS a FROM segments),
 c AS (SELECT q.*, s.* FROM q JOIN s ON (q.t0 IS NULL OR s.timestamp >= q.t0) AND (q.t1 IS NULL OR s.timestamp <= q.t1)
   AND (len(q.keywords) = 0 OR len([k FOR k IN q.keywords IF contains(s.low, k) OR contains(s.sujets[1], k) OR contains(s.projets[1], k) OR contains(s.lieux[1], k)]) > 0)
   AND (len(q.tags) = 0 OR len([t FOR t IN q.tags IF contains(s.tag, t)]) > 0)
   AND (len(q.persons) = 0 OR len([p FOR p IN q.persons IF contains(s.people, p)]) > 0)),
 parts AS (SELECT *, CASE WHEN len(tags) > 0 THEN {PROXIMITY} ELSE 0.5 END AS s_tags, CASE WHEN ev IS NULL THEN 0.5 ELSE {COSINE} END AS s_emotion,
   greatest(0.1, 1.0 - floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(timestamp)) / 86400000000.0) / 365) AS s_time,
   CASE WHEN len([p FOR p IN persons IF contains(people, p)]) > 0 THEN least(1.0, 0.5 + 0.25 * len([p FOR p IN persons IF contains(people, p)])) ELSE 0.5 END AS s_persons,
   CASE WHEN len([k FOR k IN keywords IF contains(low, k)]) > 0 THEN least(1.0, 0.3 + 0.15 * len([k FOR k IN keywords IF contains(low, k)])) ELSE 0.5 END AS s_summary,
   round(v * w_emotion + a * w_emotion + 0.8 * w_tags, 4) / 5 AS res FROM c),
 scored AS (SELECT *, (w_tags * s_tags + w_emotion * s_emotion + w_time * s_time + w_persons * s_persons + w_summary * s_summary) * (1 + 0.2 * least(1.0, res)) AS score FROM parts),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored)"""


def stored_segments(d):
    """Segments with their vectors, as the ingest job stores them."""
    return stored(vec.vectorise(d.wide("segments")), "segments")


@query("srch1_hybrid_search", f"WITH {SEARCH_CTE} SELECT CAST(query_id AS BIGINT) AS query_id, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= top_k")
def _(d):
    seg = stored_segments(d)
    hits = search.hybrid_search(seg, SEARCHES, NOW)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("srch1a_scores", f"WITH {SEARCH_CTE} SELECT CAST(query_id AS BIGINT) AS query_id, count(*) AS n, round(sum(score), 4) AS total FROM scored GROUP BY query_id")
def _(d):
    pairs = search.score_pairs(stored_segments(d), SEARCHES, NOW)
    return pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query("join12_score_pairs", f"WITH {SEARCH_CTE} SELECT CAST(query_id AS BIGINT) AS query_id, id, round(score, 6) AS score FROM scored")
def _(d):
    pairs = search.score_pairs(stored_segments(d), SEARCHES, NOW)
    return pairs.select("query_id", "id", F.round("score", 6).alias("score"))


def _log(d):
    """One search per customer: a word, a person, a tag or a time range, in turn."""
    k = F.col("c_custkey")
    turn, text = k % 5, lambda c: c.cast("string")
    pad = lambda c, n: F.lpad(text(c), n, "0")
    none = F.array().cast("array<string>")
    only = lambda which, c: F.when(turn == which, F.array(c)).otherwise(none)
    start = F.when(turn == 3, F.timestamp_seconds(F.unix_seconds(F.lit(datetime(2024, 1, 1, tzinfo=timezone.utc))) + (k % 30) * 86_400))
    weights = search.query_table(d.spark, [search.Query(1)]).first().asDict()
    return d.customer.select(
        k.alias("query_id"), F.lit("").alias("text"),
        F.when(turn == 0, F.array(F.concat(F.lit("user "), text(k % 97)), F.concat(F.lit("absent"), text(k)))).when(turn == 4, F.array(F.lit("ou"))).otherwise(none).alias("keywords"),
        only(1, F.concat_ws("-", pad(1 + k % 6, 2), pad(10 * (k % 30), 4), pad(10 * (k % 40), 4))).alias("tags"), only(2, F.concat(F.lit("Person"), text(k % 11))).alias("persons"),
        start.alias("start"), (start + F.expr("INTERVAL 1 DAY")).alias("end"), F.lit(None).cast("double").alias("ev"), F.lit(None).cast("double").alias("ea"),
        *[F.lit(weights[w]).alias(w) for w in ("w_tags", "w_emotion", "w_time", "w_persons", "w_summary")],
        F.from_json(F.lit(json.dumps({str(p): v for p, v in weights["mask"].items()})), "map<string,double>").alias("_mask"), F.lit(3).alias("top_k"),
    ).withColumn("mask", F.transform_keys("_mask", lambda p, _: p.cast("int"))).drop("_mask")


LOG_CTE = SEARCH_CTE.replace(SEARCH_CTE[SEARCH_CTE.index("AS (VALUES"):SEARCH_CTE.index(",\n s AS (")], """AS (SELECT c_custkey,
  CASE c_custkey % 5 WHEN 0 THEN ['user ' || CAST(c_custkey % 97 AS VARCHAR), 'absent' || CAST(c_custkey AS VARCHAR)] WHEN 4 THEN ['ou'] ELSE []::VARCHAR[] END,
  CASE WHEN c_custkey % 5 = 1 THEN [concat(lpad(CAST(1 + c_custkey % 6 AS VARCHAR), 2, '0'), '-', lpad(CAST(10 * (c_custkey % 30) AS VARCHAR), 4, '0'), '-', lpad(CAST(10 * (c_custkey % 40) AS VARCHAR), 4, '0'))] ELSE []::VARCHAR[] END,
  CASE WHEN c_custkey % 5 = 2 THEN ['person' || CAST(c_custkey % 11 AS VARCHAR)] ELSE []::VARCHAR[] END,
  CASE WHEN c_custkey % 5 = 3 THEN TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 30 AS INT)) END, CASE WHEN c_custkey % 5 = 3 THEN TIMESTAMP '2024-01-02' + to_days(CAST(c_custkey % 30 AS INT)) END,
  NULL::DOUBLE, NULL::DOUBLE, 0.3::DOUBLE, 0.3::DOUBLE, 0.3::DOUBLE, 0.0::DOUBLE, 0.1::DOUBLE, 3 FROM customer)""")


@query("srch1_query_log", f"WITH {LOG_CTE} SELECT CAST(query_id AS BIGINT) AS query_id, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= top_k")
def _(d):
    # the postings are stored and read back; every customer's search is answered in one pass
    seg = stored_segments(d)
    path = scratch_path(d.spark, "postings")
    grams.write_postings(search.index_segments(seg), path)
    hits = search.hybrid_search(seg, _log(d), NOW, index=grams.read_postings(d.spark, path))
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("srch1_answer_context")
def _(d):
    return search.answer_context(search.hybrid_search(stored_segments(d), SEARCHES, NOW), max_tokens=200)


@query(
    "srch1_text_fallback",
    """WITH q(query_id, t, k) AS (VALUES (1, 'ertion', 5), (2, 'und die', 3)), h AS (SELECT q.query_id, q.k, concat('doc', doc_id, '.txt') AS file_name,
      [l FOR l IN string_split(text, chr(10)) IF contains(lower(l), q.t)][1] AS line, row_number() OVER (PARTITION BY q.query_id ORDER BY concat('doc', doc_id, '.txt')) AS rank
      FROM documents JOIN q ON contains(lower(text), q.t)) SELECT CAST(query_id AS BIGINT) AS query_id, file_name, substring(line, 1, 200) AS resume_texte, rank, 0.1::DOUBLE AS score FROM h WHERE rank <= k""",
)
def _(d):
    asked = [search.Query(1, "ERTION"), search.Query(2, "und die", top_k=3), search.Query(9, "answered")]
    docs = d.documents.select(F.concat(F.lit("doc"), "doc_id", F.lit(".txt")).alias("file_name"), "text")
    answered = d.spark.createDataFrame([(9,)], "query_id LONG")
    return search.text_fallback(docs, asked, answered, cut=200).withColumn("rank", F.col("rank").cast("long"))


@query(
    "srch1b_tag_proximity",
    """WITH p AS (SELECT a.n_nationkey AS k, a.n_nationkey % 3 AS c1, b.r_regionkey % 3 AS c2, 10 * (a.n_nationkey % 4) AS s1, 10 * b.r_regionkey AS s2, a.n_nationkey AS i1, 7 * b.r_regionkey AS i2, b.r_regionkey AS r FROM nation a JOIN region b ON a.n_regionkey = b.r_regionkey)
    SELECT CAST(k AS BIGINT) AS k, round(CASE WHEN k % 5 = 4 THEN 0.1 WHEN c1 <> c2 THEN 0.1 WHEN s1 <> s2 THEN 0.3 + 0.3 * (1 - least(abs(s1 - s2) / 100.0, 1)) ELSE 0.7 + 0.3 * (1 - least(abs(i1 - i2) / 100.0, 1)) END::DOUBLE, 6) AS proximity FROM p""",
)
def _(d):
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    k, r = F.col("n_nationkey"), F.col("r_regionkey")
    a = F.concat_ws("-", pad(k % 3, 2), pad(10 * (k % 4), 4), F.when(k % 5 == 4, "x").otherwise(pad(k, 4)))
    a = F.when(k % 5 == 4, F.concat_ws("-", pad(r % 3, 2), pad(10 * r, 4), F.lit("x"))).otherwise(a)
    b = F.concat_ws("-", pad(r % 3, 2), pad(10 * r, 4), pad(7 * r, 4))
    pairs = d.nation.join(d.region, F.col("n_regionkey") == r)
    return pairs.select(k.cast("long").alias("k"), F.round(scores.tag_proximity(a, b), 6).alias("proximity"))


@query(
    "srch1c_emotion_similarity",
    f"SELECT id, round({COSINE}, 6) AS similarity FROM (SELECT id, emotion_valence AS v, emotion_activation AS a, 0.3::DOUBLE AS ev, 0.2::DOUBLE AS ea FROM segments)",
)
def _(d):
    sim = scores.emotion_similarity(F.lit(0.3), F.lit(0.2), F.col("emotion_valence"), F.col("emotion_activation"))
    return d.segments.select("id", F.round(sim, 6).alias("similarity"))


@query(
    "srch1d_resonance",
    "SELECT id, round(least(1.0, round(emotion_valence * 0.5::DOUBLE + emotion_activation * 0.5::DOUBLE + 0.8::DOUBLE * 0.25::DOUBLE, 4) / 5), 6) AS resonance FROM segments",
)
def _(d):
    mask = scores.mask_of({"emotion": 0.5, "tags_roget": 0.25, "timestamp": 0.25})
    return stored_segments(d).select("id", F.round(scores.resonance_score(F.col("vecteur"), mask), 6).alias("resonance"))


@query(
    "srch2_emotion_top_k",
    f"""WITH n AS (SELECT id, emotion_valence AS v, coalesce(nullif(emotion_activation, 0), 0.5) AS a, -0.7::DOUBLE AS ev, 0.5::DOUBLE AS ea FROM segments ORDER BY timestamp DESC, id LIMIT 500)
    SELECT id, round({COSINE}, 6) AS score FROM n ORDER BY round({COSINE}, 9) DESC, id LIMIT 10""",
)
def _(d):
    return search.search_by_emotion(d.segments, -0.7, 0.5, prefilter_limit=500).select("id", F.round("score", 6).alias("score"))


@query(
    "srch2_emotion_all",
    f"""WITH n AS (SELECT id, emotion_valence AS v, coalesce(nullif(emotion_activation, 0), 0.5) AS a, -0.7::DOUBLE AS ev, 0.5::DOUBLE AS ea FROM segments)
    SELECT id, round({COSINE}, 6) AS score FROM n ORDER BY round({COSINE}, 9) DESC, id LIMIT 10""",
)
def _(d):
    return search.search_by_emotion(d.segments, -0.7, 0.5).select("id", F.round("score", 6).alias("score"))


FIELDS = ["path_display", "name", "summary"]
POSTINGS_CTE = f"""docs AS (SELECT id, regexp_extract_all(lower(translate(concat_ws(chr(10), path_display, name, summary), '{lx.ACCENTED}', '{lx.UNACCENTED}')), '[\\p{{L}}\\p{{N}}]+') AS w FROM files),
 postings AS (SELECT id AS doc_id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM docs) GROUP BY ALL), stats AS (SELECT id AS doc_id, len(w) AS length FROM docs)"""
BM25_CTE = POSTINGS_CTE + """, hits AS (SELECT doc_id, t, sum(tf) AS tf FROM postings JOIN (VALUES ('ouo'), ('the'), ('src1')) q(t) ON starts_with(term, t) GROUP BY ALL),
 n AS (SELECT count(*) AS n, avg(length) AS l FROM stats), df AS (SELECT t, count(*) AS df FROM hits GROUP BY t),
 idf AS (SELECT t, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM df, n),
 bm AS (SELECT h.doc_id, -sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * s.length / n.l))) AS rank FROM hits h JOIN idf USING (t) JOIN stats s USING (doc_id), n GROUP BY h.doc_id)"""


def index(d):
    files = d.wide("files")
    return fts.build_postings(files, "id", FIELDS), fts.build_doc_stats(files, "id", FIELDS)


@query("srch3_postings", f"WITH {POSTINGS_CTE} SELECT doc_id, term, tf FROM postings")
def _(d):
    return index(d)[0]


@query("srch3_bm25", f"WITH {BM25_CTE} SELECT doc_id, round(rank, 6) AS rank FROM bm")
def _(d):
    postings, stats = index(d)
    return fts.bm25(postings, stats, ["ouo", "the", "src1"]).select("doc_id", F.round("rank", 6).alias("rank"))


def stored_index(d, size=fts.DOCS_PER_BLOCK):
    """The index of the files, stored and read back."""
    path = scratch_path(d.spark, "index")
    fts.write_index(fts.build_index(d.wide("files"), "id", FIELDS, size), path)
    return fts.read_index(d.spark, path)


@query(
    "srch3_full_text",
    f"""WITH {BM25_CTE} SELECT f.id, f.importance, round(rank, 6) AS rank FROM bm JOIN files f ON f.id = bm.doc_id WHERE f.domain = 'fr' AND f.extension = '.md' AND f.importance >= 2
    ORDER BY bm.rank, f.importance DESC, f.id LIMIT 20""",
)
def _(d):
    hits = fts.search_index(stored_index(d), d.files, "\"Ouo\" the* src1", domain="FR", extension="MD", limit=20, min_importance=2)
    return hits.select("id", "importance", F.round("rank", 6).alias("rank"))


@query(
    "srch3_all_postings",
    f"""WITH {BM25_CTE} SELECT f.id, f.importance, round(rank, 6) AS rank FROM bm JOIN files f ON f.id = bm.doc_id WHERE f.domain = 'fr' AND f.extension = '.md' AND f.importance >= 2
    ORDER BY bm.rank, f.importance DESC, f.id LIMIT 20""",
)
def _(d):
    postings, stats = index(d)
    hits = fts.full_text_search(postings, stats, d.files, "\"Ouo\" the* src1", domain="FR", extension="MD", limit=20, min_importance=2)
    return hits.select("id", "importance", F.round("rank", 6).alias("rank"))


@query(
    "srch3_updated_index",
    f"""WITH {BM25_CTE.replace("summary), '", "CASE WHEN id % 5 = 0 THEN 'the new ouo text' ELSE summary END), '").replace("FROM files)", "FROM files WHERE id % 7 <> 0)")}
    SELECT f.id, f.importance, round(rank, 6) AS rank FROM bm JOIN files f ON f.id = bm.doc_id ORDER BY bm.rank, f.importance DESC, f.id LIMIT 40""",
)
def _(d):
    changed = d.files.filter("id % 5 = 0 AND id % 7 <> 0").withColumn("summary", F.lit("the new ouo text"))
    path = scratch_path(d.spark, "index")
    fts.write_index(fts.update_index(stored_index(d, 64), changed, "id", FIELDS, deleted=d.files.filter("id % 7 = 0")), path)
    hits = fts.search_index(fts.read_index(d.spark, path), d.files, "ouo the src1", limit=40)
    return hits.select("id", "importance", F.round("rank", 6).alias("rank"))


@query(
    "srch4_like_search",
    """SELECT id, importance FROM files WHERE (contains(lower(path_display), 'src1') OR contains(lower(name), 'src1') OR contains(lower(summary), 'src1')) AND importance >= 3
    ORDER BY importance DESC, id LIMIT 80""",
)
def _(d):
    return search.like_search(d.files, "SRC1", limit=80, min_importance=3).select("id", "importance")


@query(
    "srch5_update_postings",
    f"""WITH {POSTINGS_CTE.replace("summary), '", "CASE WHEN id % 5 = 0 THEN 'nouveau texte' ELSE summary END), '")} SELECT doc_id, term, tf FROM postings WHERE doc_id % 7 <> 0""",
)
def _(d):
    files = d.files
    changed = files.filter("id % 5 = 0 AND id % 7 <> 0").withColumn("summary", F.lit("nouveau texte"))
    return fts.update_postings(index(d)[0], changed, "id", FIELDS, deleted=files.filter("id % 7 = 0"))


@query(
    "srch4_by_trigrams",
    """SELECT id, importance FROM files WHERE (contains(lower(path_display), 'oui') OR contains(lower(name), 'oui') OR contains(lower(summary), 'oui')) AND importance >= 3
    ORDER BY importance DESC, id LIMIT 80""",
)
def _(d):
    path = scratch_path(d.spark, "blocks")
    grams.write_blocks(d.wide("files"), "id", F.concat_ws("\n", *FIELDS), path)
    found = grams.reading(grams.read_blocks(d.spark, path), ["OUI"])
    return search.like_search(found, "OUI", limit=80, min_importance=3).select("id", "importance")


@query("srch7_boolean_and", f"WITH {POSTINGS_CTE} SELECT doc_id FROM postings WHERE term IN ('the', 'and', 'of') GROUP BY doc_id HAVING count(DISTINCT term) = 3")
def _(d):
    return fts.boolean_search(index(d)[0], ["the", "and", "of"]).select("doc_id")


@query(
    "srch7_fact_search",
    """SELECT id, importance FROM facts WHERE list_contains(regexp_extract_all(lower(concat_ws(' ', sujet, information)), '[\\p{L}\\p{N}]+'), 'the')
    AND list_contains(regexp_extract_all(lower(concat_ws(' ', sujet, information)), '[\\p{L}\\p{N}]+'), 'of') ORDER BY importance DESC, id LIMIT 30""".replace("\\\\", "\\"),
)
def _(d):
    return fts.fact_search(d.facts, ["the", "of"], 30).select("id", "importance")


def _phrased(d):
    """The corpus with its phrases joined."""
    corpus = stored(emb.build_corpus(d.wide("documents"), "doc_id"), "corpus")
    phrases = stored(emb.detect_phrases(corpus).select("a", "b"), "phrases")
    return stored(emb.apply_phrases(corpus, phrases, ["doc_id", "par_no"]), "phrased")


def _model(d):
    return wordvectors.train_vectors(_phrased(d))


@query("srch6_expanded_search")
def _(d):
    vectors = materialise(_model(d))
    similar = lambda t: [(r["term"], r["score"]) for r in emb.most_similar(vectors, [t], 10, 0.0).collect()]
    seg = d.documents.select(
        F.col("doc_id").alias("id"), F.timestamp_seconds("doc_id").alias("timestamp"), F.col("text").alias("resume_texte"),
        *[F.array().cast("array<string>").alias(c) for c in ("sujets", "personnes", "projets")],
    )
    return search.expanded_search(seg, "thereand", similar, 40)


@query(
    "srch6_expanded_terms",
    """WITH t(r, w) AS (VALUES (0, 'error'), (1, 'user 7 '), (2, 'purchase')), h AS (SELECT r, id, timestamp, row_number() OVER (PARTITION BY r ORDER BY timestamp DESC, id) AS n FROM segments JOIN t ON contains(resume_texte, w) OR contains(sujets[1], w)),
    b AS (SELECT id, min(r) AS term_rank, max(timestamp) AS ts FROM h WHERE n <= 30 GROUP BY id) SELECT id, term_rank FROM b ORDER BY term_rank, ts DESC, id LIMIT 60""",
)
def _(d):
    return search.expanded_search(d.segments, "Error", lambda t: [("user_7_", 0.9), ("purchase", 0.8), ("view", 0.5)], 60, per_term=30).select("id", "term_rank")


@query(
    "srch8_widening_search",
    r"""WITH l AS (SELECT concat('doc', doc_id, '.txt') AS file_name, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
    h AS (SELECT file_name, line_no FROM l WHERE regexp_matches(line, '(?i)\bthe\b') ORDER BY file_name DESC, line_no LIMIT 50)
    SELECT CAST(3 AS INT) AS stage, concat(file_name, ':', line_no) AS ref FROM h""",
)
def _(d):
    docs = d.documents.select(F.concat(F.lit("doc"), "doc_id", F.lit(".txt")).alias("file_name"), "text")
    return search.widening_search(d.segments, docs, "absent", lambda t: [("missing", 0.9)], r"\bthe\b")


# --- embeddings -----------------------------------------------------------------------------------------------
CORPUS_SQL = r"""corpus AS (SELECT doc_id, list_filter(regexp_extract_all(lower(regexp_replace(translate(text, '{a}', '{u}'), '[^\x00-\x7F]', '', 'g')), '[a-z0-9]+'),
  lambda x: length(x) > 2 AND NOT list_contains([{stop}], x)) AS w FROM documents WHERE length(text) > 50), kept AS (SELECT * FROM corpus WHERE len(w) > 5)""".replace(
    "{a}", lx.ACCENTED).replace("{u}", lx.UNACCENTED).replace("{stop}", ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(lx.CORPUS_STOPWORDS))))


@query(
    "emb2_phrases",
    f"""WITH {CORPUS_SQL}, words AS (SELECT w, count(*) AS c FROM (SELECT unnest(w) AS w FROM kept) GROUP BY w),
    pairs AS (SELECT a, b, count(*) AS c_ab FROM (SELECT unnest(w[1:len(w) - 1]) AS a, unnest(w[2:]) AS b FROM kept) GROUP BY ALL),
    v AS (SELECT (SELECT count(*) FROM words) + (SELECT count(*) FROM pairs) AS n)
    SELECT concat(a, '_', b) AS phrase, c_ab, round((c_ab - 2) / x.c / y.c * n, 6) AS score FROM pairs JOIN words x ON x.w = a JOIN words y ON y.w = b, v
    WHERE c_ab >= 2 AND (c_ab - 2) / x.c / y.c * n > 5""",
)
def _(d):
    phrases = emb.detect_phrases(materialise(emb.build_corpus(d.wide("documents"), "doc_id")))
    return phrases.select("phrase", "c_ab", F.round("score", 6).alias("score"))


# paragraphs, their words by place, and which places start a phrase: of a run of overlapping pairs every second one counts
PHRASED_SQL = CORPUS_SQL.replace("AS (SELECT doc_id, list_filter", "AS (SELECT doc_id, par_no, list_filter").replace(
    "FROM documents WHERE length(text) > 50", "FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS text, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS par_no FROM documents) WHERE length(text) > 50") + """,
    places AS (SELECT doc_id, par_no, unnest(w) AS a, unnest(list_append(w[2:], NULL)) AS b, generate_subscripts(w, 1) AS i FROM kept), words AS (SELECT a AS w, count(*) AS c FROM places GROUP BY a),
    pairs AS (SELECT a, b, count(*) AS c_ab FROM places WHERE b IS NOT NULL GROUP BY ALL), v AS (SELECT (SELECT count(*) FROM words) + (SELECT count(*) FROM pairs) AS n),
    phrases AS (SELECT a, b FROM pairs JOIN words x ON x.w = a JOIN words y ON y.w = b, v WHERE c_ab >= 2 AND (c_ab - 2) / x.c / y.c * n > 5),
    hits AS (SELECT doc_id, par_no, i, i - row_number() OVER (PARTITION BY doc_id, par_no ORDER BY i) AS run FROM places JOIN phrases USING (a, b)),
    starts AS (SELECT doc_id, par_no, i FROM (SELECT *, min(i) OVER (PARTITION BY doc_id, par_no, run) AS first FROM hits) WHERE (i - first) % 2 = 0),
    joined AS (SELECT p.doc_id, p.par_no, p.i, CASE WHEN s.i IS NOT NULL THEN concat(p.a, '_', p.b) ELSE p.a END AS term FROM places p
      LEFT JOIN starts s ON s.doc_id = p.doc_id AND s.par_no = p.par_no AND s.i = p.i ANTI JOIN starts t ON t.doc_id = p.doc_id AND t.par_no = p.par_no AND t.i = p.i - 1)"""


@query(
    "emb2_apply_phrases",
    f"""WITH {PHRASED_SQL} SELECT doc_id, CAST(par_no AS INT) AS par_no, CAST(count(*) AS INT) AS n_tokens, CAST(count(*) FILTER (contains(term, '_')) AS INT) AS n_phrases, md5(string_agg(term, ' ' ORDER BY i)) AS digest
    FROM joined GROUP BY doc_id, par_no""",
)
def _(d):
    out = _phrased(d).withColumn("digest", F.md5(F.array_join("tokens", " ")))
    return out.select("doc_id", "par_no", "digest", F.size("tokens").alias("n_tokens"), F.size(F.filter("tokens", lambda w: F.contains(w, F.lit("_")))).alias("n_phrases"))


@query("emb3_word2vec", f"WITH {PHRASED_SQL} SELECT term, CAST(100 AS INT) AS dimensions FROM joined GROUP BY term HAVING count(*) >= 2")
def _(d):
    vectors = _model(d)
    return vectors.select("term", F.size("embedding").alias("dimensions"))


COSINE_EMB = "list_sum(list_transform(range(1, len(e.v) + 1), lambda i: e.v[i] * q.v[i])) / sqrt(list_sum(list_transform(e.v, lambda x: x * x)) * list_sum(list_transform(q.v, lambda x: x * x)))"


@query(
    "emb4_most_similar",
    f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id IN (0, 17, 256)),
    s AS (SELECT q.vec_id AS source, e.vec_id, {COSINE_EMB} AS score FROM e JOIN q ON e.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0.2)
    SELECT source, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""",
)
def _(d):
    out = emb.most_similar(d.embeddings, [0, 17, 256], 5, 0.2, key="vec_id")
    return out.select("source", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("emb5_expand_queries")
def _(d):
    vectors = materialise(_model(d))
    asked = d.benchmark.select(F.col("item_id").alias("query_id"), "text")
    near = emb.neighbour_table(vectors, emb.query_words(asked), n=5, minimum=0.5)
    return emb.expand_queries(asked, near, 15)


@query(
    "emb5_neighbour_table",
    f"""WITH e AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS term, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    s AS (SELECT q.term AS source, e.term, round({COSINE_EMB}, 9) AS score FROM e JOIN e q ON e.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, term) AS rank FROM s WHERE score >= 0.3)
    SELECT source, term, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""",
)
def _(d):
    vectors = d.embeddings.select(F.col("vec_id").cast("string").alias("term"), "embedding")
    return emb.neighbour_table(vectors, vectors, n=3, minimum=0.3).withColumn("score", F.round("score", 4))


@query("emb6_model_stats", "SELECT count(*) AS vocabulary, CAST(max(len(embedding)) AS INT) AS dimensions FROM embeddings")
def _(d):
    return emb.model_stats(d.embeddings)


@query("emb7_float_bytes", "SELECT vec_id, len(embedding) AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings")
def _(d):
    back = emb.decode_floats(emb.encode_floats("embedding"))
    total = F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return d.embeddings.select("vec_id", back.alias("e")).select("vec_id", F.size("e").cast("long").alias("n"), F.round(total, 5).alias("total"))


@query("emb8_suggest_terms", f"WITH {CORPUS_SQL} SELECT DISTINCT w AS term FROM (SELECT unnest(w) AS w FROM kept) WHERE contains(w, 'oth') ORDER BY term LIMIT 10")
def _(d):
    vocabulary = emb.build_corpus(d.wide("documents"), "doc_id").select(F.explode("tokens").alias("term")).distinct()
    return emb.suggest_terms(vocabulary, "OTH")


# --- vectors ----------------------------------------------------------------------------------------------------
def _kw_sql(text: str, pairs) -> str:
    return "\nUNION ALL ".join(
        f"SELECT id, {pos} AS position, 1.0::DOUBLE AS value FROM b WHERE " + " OR ".join(f"contains({text}, '{w}')" for w in words) for pos, words in pairs.items()
    )


CLASS_WORDS = [(61, "user"), (61, "props"), (64, "error"), (66, "person1"), (66, "view"), (66, "maison")]
VECTOR_SQL = (
    """WITH b AS (SELECT *, lower(lieux[1]) AS place, lower(concat_ws(' ', tags_roget[1], resume_texte, personnes[1], personnes[2], lieux[1], projets[1])) AS bag FROM segments),
    cls AS (SELECT id, 60 + CAST(substring(tags_roget[1], 2, 1) AS INT) AS tagged, len(string_split(bag, ' ')) AS n_words, bag FROM b),
    hits AS (SELECT id, p.pos, max(tagged = p.pos) AS tagged, coalesce(count_if(contains(bag, k.w)), 0) / CASE WHEN any_value(n_words) < 20 THEN 1 ELSE 3 END AS s FROM cls, (SELECT unnest(range(61, 67)) AS pos) p LEFT JOIN (VALUES """
    + ", ".join(f"({p}, '{w}')" for p, w in CLASS_WORDS)
    + """) k(pos, w) ON k.pos = p.pos GROUP BY id, p.pos)
    SELECT id, CAST(1 AS INT) AS position, round(emotion_valence, 3) AS value FROM b WHERE emotion_valence <> 0
    UNION ALL SELECT id, 2, round(emotion_activation, 3) FROM b WHERE emotion_activation <> 0
    UNION ALL """ + _kw_sql("place", lx.PLACE_KEYWORDS) + "\nUNION ALL " + _kw_sql("bag", lx.THEME_KEYWORDS)
    + """\nUNION ALL SELECT id, CAST(pos AS INT), greatest(least(1.0, round(s, 2)), CASE WHEN tagged THEN 0.8 ELSE 0 END) FROM hits WHERE s > 0 OR tagged"""
)


@query("vec1_vectorise", VECTOR_SQL)
def _(d):
    out = vec.vectorise(d.wide("segments"), class_keywords=CLASS_WORDS)
    return out.select("id", F.explode_outer("vecteur").alias("position", "value")).filter("position IS NOT NULL")


@query("vec2_bag_of_words", "SELECT id, lower(concat_ws(' ', tags_roget[1], resume_texte, personnes[1], personnes[2], lieux[1], projets[1])) AS bag FROM segments")
def _(d):
    return d.segments.select("id", vec.bag_of_words(d.segments).alias("bag"))


@query(
    "vec3_keyword_dim",
    """WITH t AS (SELECT lpad(CAST(p_size % 8 AS VARCHAR), 2, '0') AS class, lower(p_brand) AS tag_name, lower(p_name) AS keyword FROM part)
    SELECT DISTINCT 60 + CAST(class AS INT) AS position, keyword FROM t WHERE class BETWEEN '01' AND '06' UNION
    """ + " UNION ".join(
        f"SELECT {pos}, keyword FROM t WHERE class BETWEEN '01' AND '06' AND (" + " OR ".join(f"contains(keyword, '{w}') OR contains(tag_name, '{w}')" for w in words) + ")"
        for pos, words in lx.THEME_TRIGGERS.items()
    ),
)
def _(d):
    index_rows = d.part.select(F.lpad((F.col("p_size") % 8).cast("string"), 2, "0").alias("class"), F.col("p_brand").alias("tag_name"), F.col("p_name").alias("keyword"))
    return vec.keyword_dim(index_rows)


@query(
    "vec4_backfill",
    """SELECT id, CASE WHEN id % 2 = 0 THEN 9.0::DOUBLE ELSE CASE WHEN emotion_valence <> 0 THEN round(emotion_valence, 3) END END AS first_value FROM segments""",
)
def _(d):
    have = F.create_map(F.lit(1), F.lit(9.0))
    seg = d.segments.withColumn("vecteur", F.when(F.col("id") % 2 == 0, have).otherwise(F.create_map().cast(vec.VECTOR)))
    return vec.backfill_vectors(seg).select("id", F.try_element_at("vecteur", F.lit(1)).alias("first_value"))


@query(
    "vec5_describe",
    """SELECT id, concat_ws(' | ', CASE WHEN emotion_valence <> 0 THEN concat('Humeur:', CASE WHEN emotion_valence > 0.3::DOUBLE THEN 'positif' WHEN emotion_valence < -0.3::DOUBLE THEN 'négatif' ELSE 'neutre' END, '(', CAST(emotion_valence AS VARCHAR), ')') END,
    CASE WHEN id % 3 = 0 THEN 'Lieu:maison,travail' END, CASE WHEN id % 2 = 0 THEN 'Roget:Abstrait(0.8)' END, CASE WHEN id % 5 = 0 THEN 'Thèmes:Santé,Voyage' END) AS description
    FROM segments WHERE emotion_valence <> 0""",
)
def _(d):
    k = F.col("id")
    pairs = F.array(
        F.when(F.col("emotion_valence") != 0, F.struct(F.lit(1).alias("key"), F.col("emotion_valence").alias("value"))),
        *[F.when(k % m == 0, F.struct(F.lit(p).alias("key"), F.lit(v).alias("value"))) for p, m, v in [(41, 3, 1.0), (42, 3, 1.0), (61, 2, 0.8), (67, 5, 1.0), (75, 5, 1.0)]],
    )
    v = F.map_from_entries(F.filter(pairs, lambda e: e.isNotNull()))
    return d.segments.filter("emotion_valence <> 0").select("id", vec.describe_vector(v).alias("description"))


@query("fn17_vector_json", "SELECT id, CASE WHEN id % 9 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN id % 9 = 0 THEN NULL ELSE emotion_activation END AS second FROM segments")
def _(d):
    m = F.create_map(F.lit(1), F.col("emotion_valence"), F.lit(2), F.col("emotion_activation"))
    text = F.when(F.col("id") % 9 == 0, "{broken").otherwise(vec.vector_json(m))
    return d.segments.select("id", vec.json_vector(text).alias("m")).select("id", F.size("m").alias("n"), F.try_element_at("m", F.lit(2)).alias("second"))


# --- query log ---------------------------------------------------------------------------------------------------
QUERY_TEXT = """concat(CASE item_id % 4 WHEN 0 THEN 'Que dit Marie du code Python hier ' WHEN 1 THEN 'Question sur la semaine avec Jean triste 01-0020-0030 ' WHEN 2 THEN 'projet de travail content ' ELSE 'le mois de Paris calme ' END, substring(text, 1, 0))"""


def query_log(d):
    k = F.col("item_id") % 4
    text = (
        F.when(k == 0, "Que dit Marie du code Python hier ").when(k == 1, "Question sur la semaine avec Jean triste 01-0020-0030 ")
        .when(k == 2, "projet de travail content ").otherwise("le mois de Paris calme ")
    )
    return d.benchmark.select(F.col("item_id").alias("query_id"), F.concat(text, F.col("text")).alias("text"))


@query(
    "qry1_features",
    """SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN 'technique' WHEN 1 THEN NULL WHEN 2 THEN 'professionnel' ELSE NULL END AS domaine,
    CASE item_id % 4 WHEN 0 THEN NULL WHEN 1 THEN -0.7 WHEN 2 THEN 0.7 ELSE 0.3 END::DOUBLE AS valence, CASE item_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 7 WHEN 2 THEN NULL ELSE 30 END AS days,
    CASE item_id % 4 WHEN 0 THEN 'Marie' WHEN 1 THEN 'Question,Jean' ELSE '' END AS persons, CASE item_id % 4 WHEN 0 THEN 'dit,code,python,hier' WHEN 1 THEN 'semaine,triste'
      WHEN 2 THEN 'projet,travail,content' ELSE 'mois,paris,calme' END AS keywords, CASE item_id % 4 WHEN 1 THEN '01-0020-0030' ELSE '' END AS tags, CASE item_id % 4 WHEN 1 THEN 'question' END AS type_contenu FROM benchmark""",
)
def _(d):
    log = query_log(d).withColumn("text", F.regexp_extract("text", r"^(.*?(?:hier|0030|content|calme))", 1))
    out = profiles.featurise_queries(log, NOW)
    days = F.date_diff("date_fin", "date_debut").cast("long")
    return out.select(
        "query_id", "domaine", F.col("emotion_cible.valence").alias("valence"), days.alias("days"), F.array_join("personnes", ",").alias("persons"),
        F.array_join("mots_cles", ",").alias("keywords"), F.array_join("tags_explicites", ",").alias("tags"), "type_contenu",
    )


@query("qry1_features_whole_text")
def _(d):
    return profiles.featurise_queries(query_log(d), NOW).select("query_id", F.size("mots_cles").alias("n_keywords"), F.size("personnes").alias("n_persons"))


PROFILES_SQL = """p AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 0.8 ELSE 0.4 END AS wt, CASE WHEN item_id % 3 = 1 THEN 0.6 END AS wp FROM benchmark),
  f AS (SELECT item_id, coalesce(wt, 0.4) AS tags, 0.4 AS emotion, 0.2 AS time, coalesce(wp, 0.0) AS persons FROM p), t AS (SELECT *, tags + emotion + time + persons AS total FROM f)"""


def query_profiles(d):
    k = F.col("item_id") % 3
    weights = F.when(k == 1, F.create_map(F.lit("tags_roget"), F.lit(0.8), F.lit("personnes"), F.lit(0.6))).when(k == 2, F.create_map(F.lit("tags_roget"), F.lit(0.4)))
    return d.benchmark.select(
        F.col("item_id").alias("query_id"), weights.alias("weights"), F.col("item_id").cast("int").alias("top_k"), F.lit(None).cast("string").alias("intent"),
        (F.col("item_id") / 10.0).alias("confidence"), F.create_map(F.lit("domaine"), F.lit("technique")).alias("filters"),
    )


@query(
    "qry2_profiles",
    f"""WITH {PROFILES_SQL} SELECT item_id AS query_id, round(tags / CASE WHEN abs(total - 1) > 0.01 THEN total ELSE 1 END, 6)::DOUBLE AS w_tags, round(persons / CASE WHEN abs(total - 1) > 0.01 THEN total ELSE 1 END, 6)::DOUBLE AS w_persons,
    CAST(greatest(3, least(10, item_id)) AS INT) AS top_k, least(1.0, item_id / 10.0)::DOUBLE AS confidence, 'mixte' AS intent FROM t""",
)
def _(d):
    out = profiles.normalise_profiles(query_profiles(d))
    return out.select(
        "query_id", F.round(F.col("weights")["tags_roget"], 6).alias("w_tags"), F.round(F.col("weights")["personnes"], 6).alias("w_persons"), "top_k", "confidence", "intent"
    )


@query(
    "qry3_split_filters",
    "SELECT item_id AS query_id, 'technique' AS domaine, CASE WHEN item_id % 3 = 1 THEN 1 ELSE 0 END AS has_person_weight, 1 AS has_time_weight FROM benchmark",
)
def _(d):
    out = profiles.split_filters(profiles.normalise_profiles(query_profiles(d)))
    has = lambda key: F.map_contains_key("sql_filters", F.lit(key)).cast("int")
    return out.select("query_id", F.col("sql_filters")["domaine"].alias("domaine"), has("personnes_weight").alias("has_person_weight"), has("timestamp_weight").alias("has_time_weight"))


# --- scalar functions over texts and records ------------------------------------------------------------------------
@query(
    "fn3_clean_artefacts",
    r"""SELECT doc_id, md5(trim(text, ' ' || chr(10))) AS digest, md5(trim(text, ' ' || chr(10))) AS flat FROM documents""",
)
def _(d):
    t = F.col("text")
    tree = F.concat(t, F.lit("iturn0image12\n[Code]\nsearch(\"caf\\u00e9\")\nturn3search4\n\n\n\n"))
    flat = F.concat(F.lit("```\nThis block is not supported on your current device yet.\n```\n\n\n\n"), t)
    return d.documents.select("doc_id", F.md5(tx.clean_tree_artefacts(tree)).alias("digest"), F.md5(tx.clean_flat_artefacts(flat)).alias("flat"))


@query("fn3_clean_fused", r"SELECT doc_id, md5(regexp_replace(concat(text, chr(10), 'cite x '), '\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM documents")
def _(d):
    fused = F.concat(F.col("text"), F.lit("\nciteturn0search1 x "))
    return d.documents.select("doc_id", F.md5(tx.clean_fused_artefacts(F.replace(fused, F.lit("turn0search1"), F.lit("")))).alias("digest"))


FENCED_SQL = """SELECT doc_id, regexp_replace(concat(text, chr(10), '[CODE:python:START]', chr(10), 'x = 1', chr(10), '[CODE:python:END]', chr(10), '[CODE:python:START]', chr(10), 'import os', chr(10),
  'print(os)', chr(10), '[CODE:python:END]', chr(10), chr(10), 'Fin ', text, chr(10), '[CODE:sql:START]', chr(10), 'SELECT 1 FROM t', chr(10), '[CODE:sql:END]'), '\\n{3,}', chr(10) || chr(10), 'g') AS text FROM documents"""


@query("fn4_fence_code", FENCED_SQL)
def _(d):
    t = F.col("text")
    body = F.concat(t, F.lit("\n```python\nx = 1\n```\n[Code]\nimport os\nprint(os)\n\nFin "), t, F.lit("\n```\nSELECT 1 FROM t\n```"))
    return d.documents.select("doc_id", tx.fence_code(body).alias("text"))


@query(
    "fn5_code_language",
    """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'python' WHEN 1 THEN 'latex' WHEN 2 THEN 'html' WHEN 3 THEN 'sql' WHEN 4 THEN 'javascript' WHEN 5 THEN 'bash' WHEN 6 THEN 'json' ELSE 'code' END AS language FROM documents""",
)
def _(d):
    k = F.col("doc_id") % 8
    samples = ["def f(x): pass", "\\frac{a}{b}", "<DIV>x</DIV>", "SELECT A FROM T", "const f = (x) => x", "#!/bin/sh\nls", '{"a": [1, 2]}', "x = y"]
    code = F
    for i, s in enumerate(samples):
        code = code.when(k == i, F.concat(F.lit(s), F.repeat(F.lit(" "), (F.col("doc_id") % 3).cast("int"))))
    return d.documents.select("doc_id", tx.code_language(code.otherwise("")).alias("language"))


@query(
    "fn6_neutralise_markers",
    """SELECT doc_id, md5(concat('[SOURCE:a][2024-01-01T10:00:00Z] user : ', text, 'x «SOURCE:b» y «2024-01-01T10:00:00Z»')) AS digest FROM documents""",
)
def _(d):
    t = F.concat(F.lit("[SOURCE:a][2024-01-01T10:00:00Z] user : "), "text", F.lit("x [SOURCE:b] y [2024-01-01T10:00:00Z]"))
    return d.documents.select("doc_id", F.md5(tx.neutralise_markers(t)).alias("digest"))


@query(
    "fn7_strip_context",
    """SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN ltrim(text, ' ' || chr(10)) WHEN 1 THEN ltrim(replace(text, '---', '')) ELSE text END) AS digest FROM documents""",
)
def _(d):
    k, t = F.col("doc_id") % 3, F.col("text")
    plain = F.replace(t, F.lit("---"), F.lit(""))
    text = (
        F.when(k == 0, F.concat(F.lit("[SYSTEM_CONTEXT: v1]\nregles\n[/SYSTEM_CONTEXT]\nnote\n---\n\n"), t))
        .when(k == 1, F.concat(F.lit("[SYSTEM_CONTEXT: v1] regles [/SYSTEM_CONTEXT]  "), plain)).otherwise(t)
    )
    return d.documents.select("doc_id", F.md5(tx.strip_system_context(text)).alias("digest"))


@query(
    "fn10_fix_tag",
    """SELECT id, CASE id % 5 WHEN 0 THEN concat('01-', lpad(CAST(id % 100 AS VARCHAR), 4, '0'), '-0007') WHEN 1 THEN concat('02-', lpad(concat('1', CAST(id % 10 AS VARCHAR)), 4, '0'), '-', lpad(concat(CAST(id % 10 AS VARCHAR), '3'), 4, '0'))
    WHEN 2 THEN '03-0001-0002' WHEN 3 THEN NULL ELSE tags_roget[1] END AS tag FROM segments""",
)
def _(d):
    k = F.col("id") % 5
    raw = (
        F.when(k == 0, F.concat(F.lit(" 1-"), F.col("id") % 100, F.lit("-7"))).when(k == 1, F.concat(F.lit("2-1-"), F.col("id") % 10, F.lit("-3")))
        .when(k == 2, "3-1-2-9-9-9").when(k == 3, "12").otherwise(F.col("tags_roget")[0])
    )
    return d.segments.select("id", scores.fix_tag(raw).alias("tag"))


@query(
    "fn11_normalise_annotation",
    """SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE id % 100 END AS gr_id, CASE id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 0.25 END::DOUBLE AS confidence_score,
    2 AS n_tags, 5 AS n_subjects, CASE WHEN id % 2 = 0 THEN 803 ELSE length(resume_texte) END AS summary_length, coalesce(CASE WHEN id % 3 <> 0 THEN emotion_valence END, 0.0) AS emotion_valence FROM segments WHERE id % 11 <> 0""",
)
def _(d):
    k = F.col("id") % 3
    raw = d.segments.select(
        "id", F.when(F.col("id") % 11 == 0, False).alias("indexable"),
        F.when(k == 0, "none").otherwise((F.col("id") % 100).cast("string")).alias("gr_id"), F.when(k == 0, "?").when(k == 1, "7").otherwise("0.25").alias("confidence_score"),
        F.array(F.lit("1-2-3"), F.lit("bad"), F.col("tags_roget")[0]).alias("tags_roget"), F.array(*[F.lit(str(i)) for i in range(8)]).alias("sujets"),
        F.array(F.lit("Paris")).alias("lieux"), "personnes", "projets", F.when(k != 0, F.col("emotion_valence").cast("string")).otherwise("x").alias("emotion_valence"),
        F.lit(None).cast("double").alias("emotion_activation"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("x"), 900)).otherwise(F.col("resume_texte")).alias("resume_texte"),
    )
    out = rec.normalise_annotation(raw, most=5, letters=800, places=False)
    return out.select("id", "gr_id", "confidence_score", F.size("tags_roget").alias("n_tags"), F.size("sujets").alias("n_subjects"), F.length("resume_texte").cast("long").alias("summary_length"), "emotion_valence")


@query("fn12_repair_json", "SELECT CASE WHEN id % 6 = 5 THEN 'quarantine' ELSE 'good' END AS state, count(*) AS n FROM segments GROUP BY 1")
def _(d):
    k = F.col("id") % 6
    value = F.concat(F.lit('"'), F.col("auteur"), F.lit('"'))
    text = (
        F.when(k == 0, F.concat(F.lit('{"a": '), value, F.lit(', "n": 1}'))).when(k == 1, F.concat(F.lit("{'a': 'x', n: True,}")))
        .when(k == 2, F.concat(F.lit('{"a": '), value, F.lit('\n"n": None} // note'))).when(k == 3, F.concat(F.lit('{"a": '), value))
        .when(k == 4, F.lit('[{"a": "x"}, {"a": "y"}, {"a": "z')).otherwise("no json at all")
    )
    good, bad = rec.parse_or_quarantine(d.segments.select("id", text.alias("answer")), "answer", "a STRING, n STRING")
    return good.select("id", F.lit("good").alias("state")).unionByName(bad.select("id", F.lit("quarantine").alias("state"))).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("fn13_content_class", f"WITH {MIXED_SQL}, g AS ({SIGNS_SQL}) SELECT doc_id, {CLASS_SQL} AS content_class FROM g")
def _(d):
    return mixed_texts(d).select("doc_id", tx.content_class(F.col("text")).alias("content_class"))


@query(
    "fn14_quadrant",
    """SELECT id, CASE WHEN v < 0 AND a > 0.5 THEN 'Tension (stress, anxiété, colère)' WHEN v < 0 THEN 'Dépression (tristesse, épuisement)' WHEN v > 0 AND a > 0.5 THEN 'Excitation (joie, enthousiasme)'
    WHEN v > 0 THEN 'Sérénité (calme, détente)' WHEN a > 0.5 THEN 'Haute activation' ELSE 'Basse activation' END AS quadrant FROM (SELECT id, emotion_valence AS v, emotion_activation AS a FROM segments)""",
)
def _(d):
    return d.segments.select("id", scores.quadrant(F.col("emotion_valence"), F.col("emotion_activation")).alias("quadrant"))


@query("fn18_pillar_stars", "SELECT id, concat(repeat('★', importance), repeat('☆', 3 - importance)) AS stars FROM pillars WHERE importance >= 1")
def _(d):
    from engram.functions.formats import stars

    return get_pillars(d.pillars, min_importance=1).select("id", stars(F.col("importance")).alias("stars"))


@query("fn19_extract_json", "SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE concat('{\"k\": ', id, '}') END AS json FROM segments")
def _(d):
    text = F.when(F.col("id") % 4 == 0, "nothing").otherwise(F.concat(F.lit("Voici:\n```json\n{\"k\": "), F.col("id"), F.lit("}\n``` fin")))
    return d.segments.select("id", rec.extract_json(text).alias("json"))


@query(
    "fn20_coerce_record",
    "SELECT id, CASE WHEN id % 2 = 0 THEN 'recherche' ELSE domain END AS domain, CAST(CASE WHEN id % 3 = 0 THEN 3 ELSE importance END AS INT) AS importance FROM files",
)
def _(d):
    raw = d.files.select(
        "id", F.when(F.col("id") % 2 == 0, '["recherche", "autre"]').otherwise(F.col("domain")).alias("domain"), "summary",
        F.when(F.col("id") % 3 == 0, "haute").otherwise(F.col("importance").cast("string")).alias("importance"),
    )
    return rec.coerce_record(raw).select("id", "domain", "importance")


@query(
    "fn21_parse_answers",
    "SELECT id, concat('new ', id) AS nouveau_fait, '' AS ancien_fait, 0.5::DOUBLE AS confidence FROM segments WHERE id % 5 <> 0 UNION ALL SELECT id, 'second', 'old', 0.9 FROM segments WHERE id % 5 <> 0",
)
def _(d):
    body = F.concat(
        F.lit('{"corrections": [{"nouveau_fait": "new '), F.col("id"), F.lit('"}, {"nouveau_fait": "", "ancien_fait": "x"}, {"ancien_fait": "old", "nouveau_fait": "second", "confidence": 0.9}]}')
    )
    text = F.when(F.col("id") % 5 == 0, "no answer").when(F.col("id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return rec.parse_answers(d.segments.select("id", text.alias("answer")), "answer", "corrections").select("id", "nouveau_fait", "ancien_fait", "confidence")


@query("fn21_pillar_answers", "SELECT id, 'f' AS fait, 'FAIT' AS categorie, CAST(least(3, greatest(1, id % 6)) AS INT) AS importance FROM segments")
def _(d):
    text = F.concat(F.lit('{"piliers": [{"fait": "f", "importance": '), F.col("id") % 6, F.lit("}]}"))
    return rec.parse_answers(d.segments.select("id", text.alias("answer")), "answer", "piliers").select("id", "fait", "categorie", "importance")


@query("fn21_trajectory_answers", "SELECT id, 'a' AS ancien_concept, 'b' AS nouveau_concept, 'TRAJECTOIRE' AS type FROM segments WHERE id % 2 = 0")
def _(d):
    new = F.when(F.col("id") % 2 == 0, "b").otherwise("")
    text = F.concat(F.lit('{"trajectoires": [{"ancien_concept": "a", "nouveau_concept": "'), new, F.lit('"}]}'))
    return rec.parse_answers(d.segments.select("id", text.alias("answer")), "answer", "trajectoires").select("id", "ancien_concept", "nouveau_concept", "type")

"""Queries: sources, joins, mutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions import dates, text as tx
from engram.operators import joins, mutations as mut
from engram.plans.queries_filters import SQL_STAMP, ts
from engram.plans.registry import query
from engram.sources import exports, files as src_files, segments as src, sinks, sql as guarded
from engram.session import scratch_path


# --- sources -------------------------------------------------------------------------------------------
@query(
    "src1_read_segments",
    f"""SELECT id, {SQL_STAMP}, personnes[1] AS first_person, len(personnes) AS n_persons, CAST(NULL AS VARCHAR) AS type_contenu FROM segments WHERE id % 2 = 0
    UNION ALL SELECT id, strftime(timestamp, '%Y-%m-%d %H:%M:%S'), personnes[1], len(personnes), 'v1' FROM segments WHERE id % 2 = 1""",
)
def _(d):
    # one half as stored by the older schema: lists as JSON text, times as ISO text
    seg = d.segments
    new = seg.filter("id % 2 = 0")
    old = seg.filter("id % 2 = 1").select(
        "id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.to_json("personnes").alias("personnes"), F.lit("v1").alias("type_contenu"),
    )
    out = src.unify([new, old])
    return out.select("id", ts(), F.col("personnes")[0].alias("first_person"), F.size("personnes").cast("long").alias("n_persons"), "type_contenu")


LOG_SQL = """SELECT conv_id, string_agg(concat(CAST(turn AS VARCHAR), '|[SOURCE:chat][2024-01-', lpad(CAST(1 + conv_id % 28 AS VARCHAR), 2, '0'), 'T10:', lpad(CAST(turn % 60 AS VARCHAR), 2, '0'), ':00Z] ',
   CASE WHEN auteur = 'human' THEN 'User' ELSE 'assistant' END, ' : ', text), chr(10) ORDER BY turn) AS text FROM exchanges GROUP BY conv_id"""


def exchange_logs(d):
    """Log texts as the archive stores them, one per conversation."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    line = F.concat(
        F.col("turn").cast("string"), F.lit("|[SOURCE:chat][2024-01-"), two(1 + F.col("conv_id") % 28), F.lit("T10:"), two(F.col("turn") % 60),
        F.lit(":00Z] "), F.when(F.col("auteur") == "human", "User").otherwise("assistant"), F.lit(" : "), F.col("text"),
    )
    # a conversation has few turns here; real logs come from files
    return d.exchanges.select("conv_id", "turn", line.alias("line")).groupBy("conv_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("turn", "line")))["line"], "\n").alias("text")
    )


@query(
    "src3_parse_exchanges",
    """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS no, 'chat' AS source,
    concat('2024-01-', lpad(CAST(1 + conv_id % 28 AS VARCHAR), 2, '0'), ' 10:', lpad(CAST(turn % 60 AS VARCHAR), 2, '0'), ':00') AS ts, auteur,
    md5(trim(text, ' ' || chr(10))) AS digest FROM exchanges""",
)
def _(d):
    out = src.parse_exchanges(exchange_logs(d), key="conv_id")
    return out.select("conv_id", F.col("no").cast("long").alias("no"), "source", ts(), "auteur", F.md5("text").alias("digest"))


@query(
    "src2_scan_archive",
    """SELECT day, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_lines FROM (
    SELECT concat('2024-01-', lpad(CAST(1 + conv_id % 28 AS VARCHAR), 2, '0')) AS day, text FROM exchanges) WHERE day BETWEEN '2024-01-05' AND '2024-01-12' GROUP BY day""",
)
def _(d):
    # the archive is written from the exchanges first; then read with a date range
    root = scratch_path(d.spark, "archive")
    lines = d.exchanges.select(
        F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("conv_id") % 28).cast("string"), 2, "0")).alias("day"),
        F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn")).alias("timestamp"), F.col("text").alias("line"),
    )
    sinks.write_daily_archive(lines, root)
    files = src.scan_archive(d.spark, root, "2024-01-05", "2024-01-12")
    lines = F.size(F.split("text", "\n")) - 1
    return files.groupBy(tx.file_date(F.col("file_name")).alias("day")).agg(F.sum(lines).alias("n_lines"))


def tree_export(d):
    """Conversations as a message-tree export."""
    when = F.lit(1_704_067_200.0) + F.col("conv_id") * 4000 + F.col("turn") * 60
    kind = F.when(F.col("turn") % 4 == 3, "code").otherwise("text")
    node = F.struct(
        F.when(F.col("turn") > 0, F.concat(F.lit("n"), F.col("turn") - 1)).alias("parent"),
        F.when(F.col("last") == F.col("turn"), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("n"), F.col("turn") + 1))).alias("children"),
        F.struct(
            F.struct(F.col("role").alias("role")).alias("author"), when.alias("create_time"),
            F.struct(kind.alias("content_type"), F.when(kind == "text", F.array("text")).alias("parts"), F.when(kind == "code", F.col("text")).alias("text")).alias("content"),
            F.struct((F.col("turn") == 1).alias("is_visually_hidden_from_conversation")).alias("metadata"),
        ).alias("message"),
    )
    turns = d.conversations.select("*", F.lit(0).alias("_z"))
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    return turns.join(last, "conv_id").groupBy("conv_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("n"), F.col("turn")), node))).alias("mapping")
    ).select(F.col("conv_id").alias("conv"), F.concat(F.lit("talk "), F.col("conv_id")).alias("title"), "mapping")


@query(
    "src4_tree_export",
    """SELECT conv_id AS conv, CASE WHEN role = 'user' THEN 'human' ELSE role END AS auteur,
    strftime(make_timestamp(CAST((1704067200 + conv_id * 4000 + turn * 60) * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS ts,
    md5(CASE WHEN turn % 4 = 3 THEN concat('[Code]', chr(10), trim(text, ' ')) ELSE trim(text, ' ' || chr(10)) END) AS digest
    FROM conversations WHERE role <> 'system' AND turn <> 1""",
)
def _(d):
    out = exports.tree_messages(tree_export(d))
    return out.select("conv", "auteur", ts(), F.md5("text").alias("digest"))


@query(
    "src5_content_text",
    r"""SELECT doc_id, md5(CASE doc_id % 5 WHEN 0 THEN trim(text, ' ' || chr(10)) WHEN 1 THEN concat('[Code]', chr(10), text) WHEN 2 THEN concat('[Output]', chr(10), text) ELSE '' END) AS digest FROM documents""",
)
def _(d):
    k, t = F.col("doc_id") % 5, F.col("text")
    kind = F.when(k == 0, "text").when((k == 1) | (k == 4), "code").when(k == 2, "execution_output").otherwise("user_editable_context")
    content = F.struct(
        kind.alias("content_type"), F.when(k == 0, F.array(t, F.lit(""), F.lit(None).cast("string"))).alias("parts"),
        F.when(k == 4, F.concat(F.lit("\\u00e9 "), t)).otherwise(t).alias("text"),
    )
    return d.documents.select("doc_id", F.md5(exports.content_text(content)).alias("digest"))


def flat_export(d, side: int = 0):
    """Conversations as a flat export; every other message as content blocks."""
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 4000 + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    blocks = F.when(F.col("turn") % 2 == 0, F.array(block("text", F.col("text")), block("tool_use", F.lit("x")), block("text", F.lit("end"))))
    message = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("uuid"), F.when(F.col("role") == "user", "human").otherwise("assistant").alias("sender"),
        stamp.alias("created_at"), F.when(F.col("turn") % 2 == 1, F.col("text")).alias("text"), blocks.alias("content"),
    )
    rows = d.exchanges.withColumn("role", F.when(F.col("auteur") == "human", "user").otherwise(F.col("auteur")))
    if side == 1:
        rows = rows.filter("turn < 4")
    if side == 2:
        rows = rows.filter("turn >= 2")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", message.alias("m"))))["m"].alias("chat_messages")).select(
        F.concat(F.lit("c"), F.col("conv_id")).alias("uuid"), F.concat(F.lit("talk "), F.col("conv_id")).alias("name"),
        F.concat(F.lit("summary "), F.lit(side)).alias("summary"), F.lit("2024-01-01T00:00:00Z").alias("created_at"),
        F.lit(f"2024-02-0{side + 1}T00:00:00Z").alias("updated_at"), "chat_messages",
    )


@query(
    "src6_flat_export",
    r"""SELECT concat('c', conv_id) AS conv, auteur, strftime(make_timestamp(CAST((1704067200 + conv_id * 4000 + turn * 60) * 1000000 AS BIGINT)) - INTERVAL 8 HOURS, '%Y-%m-%d') AS day,
    md5(trim(CASE WHEN turn % 2 = 0 THEN concat(text, chr(10), chr(10), 'end') ELSE text END, ' ' || chr(10))) AS digest FROM exchanges""",
)
def _(d):
    out = exports.flat_messages(flat_export(d))
    return out.select("conv", "auteur", F.date_format("day", "yyyy-MM-dd").alias("day"), F.md5("text").alias("digest"))


@query("src7_read_files")
def _(d):
    root = scratch_path(d.spark, "research")
    d.documents.select("text", F.col("source").alias("part")).write.partitionBy("part").text(root)
    out = src_files.read_files(d.spark, root)
    return out.groupBy("extension").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("src8_html_to_text")
def _(d):
    return src_files.html_to_text(d.pages).select("page_id", "text")


@query("src9_file_inventory")
def _(d):
    root = scratch_path(d.spark, "inventory")
    src_files.file_parts(d.documents.select("text", F.col("lang").alias("part")), "part", 4).write.partitionBy("part").text(root)
    out = src_files.file_inventory(d.spark, root)
    return out.groupBy("extension").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("content_hash") == 12).alias("hashed"))


@query(
    "src10_guarded_sql",
    """SELECT source_origine, count(*) AS n, round(avg(emotion_valence), 6) AS mean_valence FROM segments WHERE resume_texte NOT LIKE '%DROP TABLE%' GROUP BY source_origine""",
)
def _(d):
    return guarded.execute_sql(
        d.spark,
        "SELECT source_origine, count(*) AS n, round(avg(emotion_valence), 6) AS mean_valence FROM metadata "
        "WHERE resume_texte NOT LIKE '%DROP TABLE%' GROUP BY source_origine",
        {"metadata": d.segments}, required="metadata",
    )


@query("src11_document_chunks", "SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, content_tokens FROM chunks WHERE doc_id = 'src3-en'")
def _(d):
    return src_files.document_chunks(d.chunks, "src3-en").select("doc_id", F.col("chunk_index").cast("long"), "content_tokens")


@query(
    "src12_classify_uri",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'url' WHEN 1 THEN 'gdrive' WHEN 2 THEN 'local' ELSE 'dropbox' END AS source_type,
    CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN substring(url, 5) WHEN 2 THEN concat('/data/', url) ELSE concat('rel/', page_id) END AS path FROM pages""",
)
def _(d):
    k, url = F.col("page_id") % 4, F.col("url")
    uri = (
        F.when(k == 0, url).when(k == 1, F.concat(F.lit("gdrive://"), F.substring(url, F.lit(5), F.length(url))))
        .when(k == 2, F.concat(F.lit("file:///data/"), url)).otherwise(F.concat(F.lit("rel/"), F.col("page_id")))
    )
    kind, path = src_files.classify_uri(uri)
    return d.pages.select("page_id", kind.alias("source_type"), path.alias("path"))


# --- joins -----------------------------------------------------------------------------------------------
def persons(d):
    rows = d.nation.select(
        F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("Personne "), F.col("n_nationkey")).alias("nom_canonique"),
        F.array(F.concat(F.lit("PERSON"), F.col("n_nationkey") * 2), F.concat(F.lit("alias"), F.col("n_nationkey"))).alias("variantes"),
        F.when(F.col("n_nationkey") % 4 == 0, 0).otherwise(1).alias("actif"),
    )
    return rows


PERSONS_SQL = """persons AS (SELECT n_nationkey AS id, concat('Personne ', n_nationkey) AS nom, lower(concat('PERSON', n_nationkey * 2)) AS v FROM nation)"""


@query(
    "join7_canonicalise",
    f"""WITH {PERSONS_SQL}, e AS (SELECT id, projets, unnest(personnes) AS name, generate_subscripts(personnes, 1) AS pos FROM segments),
    j AS (SELECT e.id, e.pos, e.name, p.nom FROM e LEFT JOIN persons p ON lower(e.name) = p.v)
    SELECT j.id, string_agg(coalesce(nom, name), ',' ORDER BY pos) AS persons, arg_min(CASE WHEN nom IS NULL THEN name END, CASE WHEN nom IS NULL THEN pos END) AS person_candidate,
    any_value(CASE WHEN s.projets[1] IN ('project1', 'project2') THEN s.projets[1] ELSE '' END) AS projects,
    any_value(CASE WHEN s.projets[1] IN ('project1', 'project2') THEN s.sujets[1] ELSE concat(s.sujets[1], ',', s.projets[1]) END) AS subjects
    FROM j JOIN segments s ON s.id = j.id GROUP BY j.id""",
)
def _(d):
    known = d.spark.createDataFrame([("Project1",), ("PROJECT2",)], "nom STRING")
    out = joins.canonicalise(d.segments, joins.alias_dim(persons(d)), known)
    joined = lambda c, n: F.array_join(c, ",").alias(n)
    return out.select("id", joined("personnes", "persons"), F.col("personne_candidat").alias("person_candidate"), joined("projets", "projects"), joined("sujets", "subjects"))


@query("join8_new_only", "SELECT id FROM segments WHERE (timestamp, source_origine) NOT IN (SELECT timestamp, source_origine FROM segments WHERE auteur = 'human')")
def _(d):
    return joins.new_only(d.segments, d.segments.filter("auteur = 'human'"), ["timestamp", "source_origine"]).select("id")


@query("join8_changed_files", "SELECT id FROM files WHERE id % 3 = 0")
def _(d):
    stored = d.files.select("id", F.when(F.col("id") % 3 == 0, F.lit("old")).otherwise(F.col("content_hash")).alias("content_hash"))
    return joins.changed_only(d.files, stored, "id", "content_hash").select("id")


@query("join9_duplicate_rows", "SELECT id FROM files WHERE content_hash IN (SELECT content_hash FROM files GROUP BY content_hash HAVING count(*) > 1)")
def _(d):
    return joins.duplicate_rows(d.files, ["content_hash"]).select("id")


VERSION_PAIRS = "SELECT id AS source_id, CASE id % 4 WHEN 0 THEN id + 7 WHEN 1 THEN id WHEN 2 THEN id - 3 ELSE id + 1000000 END AS target_id FROM segments"


def version_pairs(d):
    k = F.col("id") % 4
    target = F.when(k == 0, F.col("id") + 7).when(k == 1, F.col("id")).when(k == 2, F.col("id") - 3).otherwise(F.col("id") + 1_000_000)
    return d.segments.select(F.col("id").alias("source_id"), target.alias("target_id"))


@query(
    "join10_link_versions",
    f"""SELECT p.source_id, p.target_id FROM ({VERSION_PAIRS}) p JOIN segments a ON a.id = p.source_id JOIN segments b ON b.id = p.target_id
    WHERE p.source_id <> p.target_id AND a.timestamp <= b.timestamp""",
)
def _(d):
    return joins.link_versions(version_pairs(d), d.segments)[0].select("source_id", "target_id")


@query(
    "join10_rejected_versions",
    f"""SELECT p.source_id, CASE WHEN p.source_id = p.target_id THEN 'same segment' WHEN b.id IS NULL THEN 'target missing' ELSE 'source is newer' END AS reason
    FROM ({VERSION_PAIRS}) p JOIN segments a ON a.id = p.source_id LEFT JOIN segments b ON b.id = p.target_id
    WHERE p.source_id = p.target_id OR b.id IS NULL OR a.timestamp > b.timestamp""",
)
def _(d):
    return joins.link_versions(version_pairs(d), d.segments)[1].select("source_id", "reason")


@query(
    "join11_segment_text",
    """SELECT s.id, md5(string_agg(l.line, chr(10) ORDER BY l.offs, l.line)) AS digest, count(*) AS n_lines
    FROM segments s JOIN (SELECT source_file, id AS offs, resume_texte AS line FROM segments) l ON l.source_file = s.source_file AND l.offs >= s.token_start AND l.offs < s.token_end GROUP BY s.id""",
)
def _(d):
    log = d.segments.select("source_file", F.col("id").alias("offset"), F.col("resume_texte").alias("line"))
    out = joins.segment_text(d.segments, log, bucket=64)
    return out.select("id", F.md5("text").alias("digest"), "n_lines")


@query(
    "join11_segment_line",
    "SELECT s.id, l.resume_texte AS line FROM segments s JOIN segments l ON l.source_file = s.source_file AND l.id = s.token_start",
)
def _(d):
    log = d.segments.select("source_file", F.col("id").alias("offset"), F.col("resume_texte").alias("line"))
    return joins.segment_line(d.segments, log).select("id", "line")


@query(
    "join13_merge_exports",
    """WITH a AS (SELECT conv_id, turn, 1 AS side FROM exchanges WHERE turn < 4 UNION ALL SELECT conv_id, turn, 2 FROM exchanges WHERE turn >= 2)
    SELECT concat('c', conv_id) AS uuid, count(DISTINCT turn) AS n_messages, concat('summary ', max(side)) AS summary FROM a GROUP BY conv_id""",
)
def _(d):
    conv, msgs = joins.merge_exports([flat_export(d, 1), flat_export(d, 2)])
    counts = msgs.groupBy(F.col("conversation").alias("uuid")).agg(F.count(F.lit(1)).alias("n_messages"))
    return conv.join(counts, "uuid").select("uuid", "n_messages", "summary")


@query(
    "agg14_merge_stats",
    """WITH a AS (SELECT conv_id, turn FROM exchanges WHERE turn < 4), b AS (SELECT conv_id, turn FROM exchanges WHERE turn >= 2), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
    SELECT count(DISTINCT conv_id) + 0 AS conversations_unique, (SELECT count(DISTINCT conv_id) FROM a) + (SELECT count(DISTINCT conv_id) FROM b) AS conversations_total,
    (SELECT count(DISTINCT conv_id) FROM a) + (SELECT count(DISTINCT conv_id) FROM b) - count(DISTINCT conv_id) AS conversations_duplicates,
    count(*) AS messages_total, count(DISTINCT (conv_id, turn)) AS messages_unique, count(*) - count(DISTINCT (conv_id, turn)) AS messages_duplicates FROM u""",
)
def _(d):
    from engram.operators.aggregates import merge_stats

    return merge_stats([flat_export(d, 1), flat_export(d, 2)])


@query(
    "join14_hierarchy",
    """WITH RECURSIVE t AS (SELECT id, nom, 0 AS niveau, nom AS chemin FROM projects WHERE parent_id IS NULL
    UNION ALL SELECT p.id, p.nom, t.niveau + 1, concat(t.chemin, ' > ', p.nom) FROM projects p JOIN t ON p.parent_id = t.id) SELECT id, niveau, chemin FROM t""",
)
def _(d):
    return joins.hierarchy(d.projects).select("id", "niveau", "chemin")


@query(
    "join15_trajectories",
    """WITH h AS (SELECT 'error' AS a, 'purchase' AS b UNION ALL SELECT 'view', 'user 9 ' UNION ALL SELECT 'click', 'click'),
    n AS (SELECT h.a, h.b, (SELECT id FROM segments WHERE contains(resume_texte, h.a) OR sujets[1] = h.a ORDER BY timestamp DESC, id LIMIT 1) AS source_id,
      (SELECT id FROM segments WHERE contains(resume_texte, h.b) OR sujets[1] = h.b ORDER BY timestamp DESC, id LIMIT 1) AS target_id FROM h)
    SELECT source_id, target_id FROM n WHERE source_id <> target_id""",
)
def _(d):
    found = [
        {"ancien_concept": "Error", "nouveau_concept": "purchase"}, {"ancien_concept": "view", "nouveau_concept": "user 9 "},
        {"ancien_concept": "click", "nouveau_concept": "click"},
    ]
    return joins.weave_trajectories(found, d.segments).select("source_id", "target_id")


@query(
    "join16_person_lookup",
    """SELECT n_nationkey::BIGINT AS id FROM nation WHERE n_nationkey % 4 <> 0 AND contains(lower(concat('Personne ', n_nationkey, ' PERSON', n_nationkey * 2, ' alias', n_nationkey)), 'person4')""",
)
def _(d):
    return joins.person_lookup(persons(d), "Person4").select("id")


# --- mutations ---------------------------------------------------------------------------------------------
@query(
    "snk1_ingest_segments",
    """SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN emotion_valence END, 0.0) AS emotion_valence, coalesce(CASE WHEN id % 3 = 0 THEN emotion_activation END, 0.5) AS emotion_activation,
    coalesce(CASE WHEN id % 3 = 0 THEN confidence_score END, 0.5) AS confidence_score, CAST(floor(epoch(timestamp)) AS BIGINT) AS timestamp_epoch,
    nullif(coalesce(CASE WHEN id % 3 = 0 THEN emotion_valence END, 0.0), 0.0)::DOUBLE AS v1, nullif(coalesce(CASE WHEN id % 3 = 0 THEN emotion_activation END, 0.5), 0.0)::DOUBLE AS v2,
    CASE WHEN personnes[2] = 'person3' THEN 'Trois' ELSE personnes[2] END AS second_person FROM segments WHERE id % 5 <> 0""",
)
def _(d):
    seg = d.segments
    notes = seg.filter("id % 3 = 0 OR id % 5 = 0").select("id", "emotion_valence", "emotion_activation", "confidence_score", (F.col("id") % 5 != 0).alias("indexable"))
    persons = d.spark.createDataFrame([("Trois", ["PERSON3"])], "nom_canonique STRING, variantes ARRAY<STRING>")
    projects = seg.select(F.explode("projets").alias("nom")).distinct()
    out = mut.ingest_segments(seg.select("id", "timestamp", "personnes", "projets", "sujets"), notes, aliases=joins.alias_dim(persons), known_projects=projects)
    at = lambda k: F.try_element_at("vecteur", F.lit(k)).alias(f"v{k}")
    return out.select("id", "emotion_valence", "emotion_activation", "confidence_score", "timestamp_epoch", at(1), at(2), F.col("personnes")[1].alias("second_person"))


@query(
    "snk2_upsert_facts",
    """WITH f AS (SELECT domaine, sujet, information, importance, date_creation, derniere_maj FROM facts WHERE id % 2 = 0),
    u AS (SELECT domaine, sujet, concat('new ', information) AS information, importance * 3 AS importance, derniere_maj FROM facts WHERE id % 3 = 0)
    SELECT coalesce(f.domaine, u.domaine) AS domaine, coalesce(f.sujet, u.sujet) AS sujet, coalesce(u.information, f.information) AS information,
    CAST(CASE WHEN u.sujet IS NULL THEN f.importance ELSE greatest(1, least(5, u.importance)) END AS INT) AS importance, strftime(coalesce(f.date_creation, u.derniere_maj), '%Y-%m-%d') AS created
    FROM f FULL JOIN u ON f.domaine = u.domaine AND f.sujet = u.sujet""",
)
def _(d):
    facts = d.facts
    old = facts.filter("id % 2 = 0")
    new = facts.filter("id % 3 = 0").withColumns({"information": F.concat(F.lit("new "), F.col("information")), "importance": F.col("importance") * 3})
    # the same key twice: the later update wins
    older = new.withColumns({"information": F.lit("older"), "derniere_maj": F.col("derniere_maj") - F.expr("INTERVAL 1 DAY")})
    out = mut.upsert_facts(old, new.unionByName(older))
    return out.select("domaine", "sujet", "information", "importance", F.date_format("date_creation", "yyyy-MM-dd").alias("created"))


@query(
    "snk3_upsert_files",
    "SELECT id, CASE WHEN id % 4 = 0 THEN 'changed' ELSE status END AS status FROM files",
)
def _(d):
    changes = d.files.filter("id % 4 = 0").withColumns({"status": F.lit("changed")})
    stale = changes.withColumns({"status": F.lit("stale"), "size": F.lit(-1).cast("long")})
    return mut.upsert_by_key(d.files, changes.unionByName(stale), ["id"], "size").select("id", "status")


def some_edges(d):
    """Edges between segments a few places apart."""
    return d.segments.select(
        F.col("id").alias("source_id"), (F.col("id") + 3).alias("target_id"), F.when(F.col("id") % 2 == 0, "LIEN_PERSONNE").otherwise("TAGS_PARTAGES").alias("type"),
        F.lit(1.5).alias("poids"), F.create_map(F.lit("k"), F.col("auteur")).alias("metadata"),
    )


SOME_EDGES = "SELECT id AS source_id, id + 3 AS target_id, CASE WHEN id % 2 = 0 THEN 'LIEN_PERSONNE' ELSE 'TAGS_PARTAGES' END AS type FROM segments"


@query(
    "snk4_delete_cascade",
    f"SELECT source_id, target_id, type FROM ({SOME_EDGES}) WHERE source_id % 7 <> 0 AND target_id % 7 <> 0",
)
def _(d):
    gone = d.segments.filter("id % 7 = 0").select("id").unionByName(d.segments.select((F.col("id") * 7).alias("id")))
    return mut.delete_segments(d.segments, some_edges(d), gone)[1].select("source_id", "target_id", "type")


@query("snk5_pillar_flag", "SELECT id, CAST(CASE WHEN auteur = 'human' THEN 1 ELSE 0 END AS INT) AS pilier FROM segments")
def _(d):
    return mut.set_pillar_flag(d.segments, d.segments.filter("auteur = 'human'")).select("id", "pilier")


@query("snk6_mark_truth", "SELECT id, CAST(CASE WHEN emotion_valence < -0.5::DOUBLE THEN -1 ELSE statut_verite END AS INT) AS statut_verite FROM segments")
def _(d):
    return mut.mark_truth(d.segments, d.segments.filter("emotion_valence < -0.5"), -1).select("id", "statut_verite")


NEW_EDGES = "SELECT id * 2 AS source_id, id * 2 + 3 AS target_id, 'LIEN_PERSONNE' AS type FROM segments"


def new_edges(d):
    return d.segments.select(
        (F.col("id") * 2).alias("source_id"), (F.col("id") * 2 + 3).alias("target_id"), F.lit("LIEN_PERSONNE").alias("type"), F.lit(9.0).alias("poids"),
        F.create_map(F.lit("k"), F.lit("new")).alias("metadata"),
    )


@query(
    "snk7_insert_edges_ignore",
    f"SELECT source_id, target_id, type, max(p) AS poids FROM (SELECT *, 1.5::DOUBLE AS p FROM ({SOME_EDGES}) UNION ALL SELECT n.*, 9.0::DOUBLE FROM ({NEW_EDGES}) n ANTI JOIN ({SOME_EDGES}) o USING (source_id, target_id, type)) GROUP BY ALL",
)
def _(d):
    return mut.insert_edges(some_edges(d), new_edges(d), "ignore").select("source_id", "target_id", "type", "poids")


@query(
    "snk7_insert_edges_replace",
    f"SELECT source_id, target_id, type, max(p) AS poids FROM (SELECT *, 1.5::DOUBLE AS p FROM ({SOME_EDGES}) UNION ALL SELECT n.*, 9.0::DOUBLE FROM ({NEW_EDGES}) n) GROUP BY source_id, target_id, type",
)
def _(d):
    return mut.insert_edges(some_edges(d), new_edges(d), "replace").select("source_id", "target_id", "type", "poids")


@query("snk8_daily_archive")
def _(d):
    root = scratch_path(d.spark, "daily")
    msgs = exports.flat_messages(flat_export(d))
    sinks.write_daily_archive(sinks.archive_lines(msgs), root)
    lines = src.scan_archive(d.spark, root).select(tx.file_date(F.col("file_name")).alias("day"), F.explode(F.split("text", "\n")).alias("value"))
    return lines.groupBy("day").agg(F.count_if(F.col("value").startswith("=== Conversation")).alias("conversations"), F.count(F.lit(1)).alias("n_lines"))


@query(
    "snk9_internal_segments",
    "SELECT id, 'reflexion' AS source_nature, 'internal' AS auteur, CAST(1 AS INT) AS statut_verite, 1.0::DOUBLE AS confidence_score FROM facts",
)
def _(d):
    notes = d.facts.select("id", F.col("derniere_maj").alias("timestamp"), F.col("information").alias("resume_texte"))
    return mut.internal_segments(notes).select("id", "source_nature", "auteur", "statut_verite", "confidence_score")


@query(
    "snk10_add_pillars",
    """WITH old AS (SELECT * FROM pillars WHERE id % 2 = 0),
    cand AS (SELECT id + 1000000 AS id, concat('fait nouveau ', n_name) AS fait, CASE WHEN n_nationkey % 6 = 5 THEN 'AUTRE' ELSE 'VALEUR' END AS categorie FROM (SELECT n_nationkey AS id, n_nationkey, n_name FROM nation)
      UNION ALL SELECT id + 2000000, substring(fait, 5, 30), 'VALEUR' FROM old WHERE length(trim(substring(fait, 5, 30))) >= 3)
    SELECT id, categorie FROM old UNION ALL SELECT id, categorie FROM cand c WHERE categorie <> 'AUTRE' AND NOT EXISTS (SELECT 1 FROM old WHERE contains(lower(old.fait), lower(trim(c.fait))))""",
)
def _(d):
    old = d.pillars.filter("id % 2 = 0")
    fresh = d.nation.select(
        (F.col("n_nationkey").cast("long") + 1_000_000).alias("id"), F.concat(F.lit("fait nouveau "), F.col("n_name")).alias("fait"),
        F.when(F.col("n_nationkey") % 6 == 5, "autre").otherwise("valeur").alias("categorie"), F.lit(2).alias("importance"), F.current_timestamp().alias("date_creation"),
    )
    again = old.select(
        (F.col("id") + 2_000_000).alias("id"), F.substring("fait", 5, 30).alias("fait"), F.lit("valeur").alias("categorie"), F.lit(2).alias("importance"), "date_creation"
    )
    return mut.add_pillars(old, fresh.unionByName(again)).select("id", "categorie")


@query(
    "snk10_update_pillars",
    "SELECT id, CASE WHEN id % 3 = 0 AND id % 4 <> 0 THEN 'VALEUR' ELSE categorie END AS categorie FROM pillars",
)
def _(d):
    changes = d.pillars.filter("id % 3 = 0").select("id", F.when(F.col("id") % 4 == 0, "unknown").otherwise("valeur").alias("categorie"), F.lit(None).cast("int").alias("importance"))
    return mut.update_pillars(d.pillars, changes).select("id", "categorie")


@query("snk11_delete_facts", "SELECT id FROM facts WHERE NOT (domaine = 'fr' AND id % 2 = 0)")
def _(d):
    return mut.delete_facts(d.facts, d.facts.filter("domaine = 'fr' AND id % 2 = 0")).select("id")


@query(
    "snk12_write_reflections",
    """SELECT concat('reflexion_', k) AS domaine, concat(k, '_', strftime(timestamp, '%Y-%m-%d'), '_', strftime(timestamp, '%H%M%S')) AS sujet,
    CAST(greatest(1, least(5, CAST(floor(w * 5) AS INT) + 1)) AS INT) AS importance, resume_texte AS information FROM (SELECT *, least(1.0, greatest(0.0, abs(emotion_valence) * 1.5::DOUBLE)) AS w,
      CASE id % 3 WHEN 0 THEN 'intuition' WHEN 1 THEN 'analyse' ELSE 'autre' END AS k FROM segments) WHERE k <> 'autre'""",
)
def _(d):
    k = F.col("id") % 3
    notes = d.segments.select(
        F.col("resume_texte").alias("contenu"), F.when(k == 0, "intuition").when(k == 1, "analyse").otherwise("autre").alias("type_reflexion"),
        (F.abs("emotion_valence") * 1.5).alias("poids_mnemique"), "timestamp", F.lit("v1").alias("ego_version"), F.lit("m").alias("modele"),
    )
    return mut.write_reflections(notes).select("domaine", "sujet", "importance", "information")


@query(
    "snk13_entity_candidates",
    """SELECT kind, nom, arg_min(c, (timestamp, id)) AS contexte, count(*) AS n_mentions FROM (
      SELECT 'personne' AS kind, personnes[2] AS nom, substring(resume_texte, 1, 200) AS c, timestamp, id FROM segments WHERE id % 2 = 0
      UNION ALL SELECT 'projet', projets[1], substring(resume_texte, 1, 200), timestamp, id FROM segments) GROUP BY kind, nom""",
)
def _(d):
    seg = d.segments.withColumns(
        {"personne_candidat": F.when(F.col("id") % 2 == 0, F.col("personnes")[1]), "projet_candidat": F.col("projets")[0]}
    )
    return mut.entity_candidates(seg, cut=200).select("kind", "nom", "contexte", "n_mentions")


@query(
    "snk14_write_results",
    """WITH s AS (SELECT doc_id, text, string_split(lower(text), 'ertion') AS p FROM documents WHERE contains(lower(text), 'ertion')),
    m AS (SELECT doc_id, text, unnest(list_transform(range(1, len(p)), lambda k: list_sum(list_transform(p[1:k], lambda x: length(x))) + 6 * (k - 1))) AS position FROM s)
    SELECT doc_id, CAST(position AS BIGINT) AS position, substring(text, CAST(position AS BIGINT) + 1, 6) AS matched FROM m""",
)
def _(d):
    from engram.operators.filters import search_text

    root = scratch_path(d.spark, "results")
    sinks.write_results(search_text(d.documents.select("doc_id", "text"), "ertion"), root, {"query": "ertion"})
    return d.spark.read.json(root).select("doc_id", "position", "matched")


@query(
    "snk15_replace_section",
    """SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN concat('# Titre', chr(10), text, chr(10), '## Tâches', chr(10), 'fait', chr(10), chr(10), '# Fin', chr(10), text)
      ELSE concat('# Titre', chr(10), text) END) AS digest, doc_id % 2 = 0 AS section_found FROM documents""",
)
def _(d):
    t = F.col("text")
    with_section = F.concat(F.lit("# Titre\n"), t, F.lit("\n## Tâches\nancien texte\nsuite\n\n# Fin\n"), t)
    docs = d.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, with_section).otherwise(F.concat(F.lit("# Titre\n"), t)).alias("text"))
    out = mut.replace_section(docs, "tâches", " fait ")
    return out.select("doc_id", F.md5("text").alias("digest"), "section_found")


# --- scalar functions ------------------------------------------------------------------------------------
@query(
    "fn1_business_day",
    "SELECT strftime(timestamp - INTERVAL 8 HOURS, '%Y-%m-%d') AS day, count(*) AS n FROM segments GROUP BY 1",
)
def _(d):
    return d.segments.groupBy(F.date_format(dates.business_day(F.col("timestamp")), "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "fn2_iso_times",
    "SELECT id, epoch_us(timestamp) AS micros, concat(strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f'), 'Z') AS iso FROM segments",
)
def _(d):
    iso = dates.ts_to_iso(F.col("timestamp"))
    return d.segments.select("id", F.unix_micros(dates.iso_to_ts(iso)).alias("micros"), iso.alias("iso"))


@query(
    "fn8_token_count",
    "SELECT doc_id, CAST(floor(length(text) / 4.0) AS BIGINT) AS tokens FROM documents",
)
def _(d):
    return d.documents.select("doc_id", tx.token_count(F.col("text")).alias("tokens"))


@query("fn16_hashes", "SELECT doc_id, sha256(text) AS sha, substring(md5(text), 1, 12) AS short FROM documents")
def _(d):
    return d.documents.select("doc_id", F.sha2("text", 256).alias("sha"), tx.short_hash(F.col("text")).alias("short"))


@query(
    "fn15_file_names",
    "SELECT id, '.txt' AS ext, strftime(timestamp, '%Y-%m-%d') AS day, 'text/plain' AS kind FROM segments",
)
def _(d):
    name = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH-mm-ss"), F.lit(".TXT"))
    ext = tx.file_ext(name)
    return d.segments.select("id", ext.alias("ext"), tx.file_date(name).alias("day"), tx.media_type(ext).alias("kind"))

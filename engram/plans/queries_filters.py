"""Queries: filters, searches and audits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from engram.functions import dates, formats, text as tx
from engram.functions.lexicon import ACCENTED, CORRECTION_PATTERNS, TEXT_EXTENSIONS, UNACCENTED
from engram.operators import filters as flt, grams
from engram.plans.registry import query
from engram.session import scratch_path

NOW = datetime(2024, 1, 31)
STAMP = "yyyy-MM-dd HH:mm:ss"
SQL_STAMP = "strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS ts"


def ts(col="timestamp"):
    return F.date_format(col, STAMP).alias("ts")


@query(
    "flt1_candidates",
    """SELECT id FROM segments
    WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-25'
      AND (contains(lower(resume_texte), 'error') OR contains(lower(sujets[1]), 'error') OR contains(projets[1], 'error') OR contains(lieux[1], 'error')
        OR contains(lower(resume_texte), 'project1') OR contains(sujets[1], 'project1') OR contains(projets[1], 'project1') OR contains(lieux[1], 'project1'))
      AND (contains(tags_roget[1], '01-0060') OR contains(tags_roget[1], '0100'))""",
)
def _(d):
    return flt.candidates(
        d.segments, keywords=["error", "project1"], tags=["01-0060", "0100"], start=datetime(2024, 1, 5), end=datetime(2024, 1, 25)
    ).select("id")


@query(
    "flt1_candidates_persons_newest",
    f"""SELECT id, {SQL_STAMP} FROM segments WHERE contains(personnes[1], 'person3') OR contains(personnes[2], 'person3')
    OR contains(personnes[1], 'person10') OR contains(personnes[2], 'person10')
    ORDER BY timestamp DESC, id LIMIT 100""",
)
def _(d):
    return flt.candidates(d.segments, limit=100, keywords=["ignored"], persons=["Pérson3", "PERSON10"]).select("id", ts())


@query(
    "flt2_normalize_search",
    f"""SELECT doc_id, md5(lower(translate(text, '{ACCENTED}', '{UNACCENTED}'))) AS folded FROM documents""",
)
def _(d):
    return d.documents.select("doc_id", F.md5(tx.normalize_search(F.col("text"))).alias("folded"))


@query(
    "flt2_normalize_unicode",
    f"""SELECT doc_id, md5(lower(translate(text, '{ACCENTED}', '{UNACCENTED}'))) AS folded FROM documents""",
)
def _(d):
    # full Unicode folding in Arrow batches; equal to the native form on the letters of the table
    return d.documents.select("doc_id", F.md5(tx.fold_unicode(F.col("text"))).alias("folded"))


@query(
    "flt3_search_by_date",
    f"""SELECT id, {SQL_STAMP}, 1.0::DOUBLE AS score FROM segments
    WHERE timestamp BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' ORDER BY timestamp DESC, id LIMIT 20""",
)
def _(d):
    return flt.search_by_date(d.segments, datetime(2024, 1, 10), datetime(2024, 1, 12)).select("id", ts(), "score")


@query(
    "flt4_search_by_person",
    f"""SELECT id, {SQL_STAMP} FROM segments WHERE contains(personnes[1], 'person5') OR contains(personnes[2], 'person5')
    ORDER BY timestamp DESC, id LIMIT 10""",
)
def _(d):
    return flt.search_by_person(d.segments, "Person5").select("id", ts())


@query("flt5_search_by_tags", "SELECT id FROM segments WHERE contains(tags_roget[1], '03-0020') ORDER BY timestamp DESC, id LIMIT 10")
def _(d):
    return flt.search_by_tags(d.segments, ["03-0020"]).select("id")


@query(
    "flt6_inspect",
    """SELECT id, auteur, source_nature FROM segments WHERE auteur = 'human' AND source_nature = 'trace'
    AND CAST(timestamp AS DATE) >= DATE '2024-01-03' AND CAST(timestamp AS DATE) <= DATE '2024-01-20' AND len(tags_roget) > 0
    AND contains(lower(resume_texte), 'click') ORDER BY timestamp ASC, id LIMIT 40 OFFSET 15""",
)
def _(d):
    wanted = flt.AuditFilters("human", "trace", "2024-01-03", "2024-01-20", True, "Click")
    return flt.inspect(d.segments, wanted, limit=40, offset=15, order="oldest").select("id", "auteur", "source_nature")


@query(
    "flt7_get_segments",
    f"SELECT id, {SQL_STAMP}, resume_texte FROM segments ORDER BY timestamp DESC, id LIMIT 500 OFFSET 30",
)
def _(d):
    page = flt.get_segments(d.segments, limit=500, offset=30, fields=["id", "timestamp", "resume_texte", "unknown"])
    return page.select("id", ts(), "resume_texte")


@query(
    "flt8_emotional_resonance",
    """SELECT id, emotion_valence, emotion_activation FROM segments WHERE emotion_valence <= -0.5::DOUBLE + 0.2::DOUBLE
    AND emotion_activation >= 0.8::DOUBLE - 0.2::DOUBLE ORDER BY emotion_valence ASC, emotion_activation DESC, id LIMIT 10""",
)
def _(d):
    return flt.emotional_resonance(d.segments, -0.5, 0.8).select("id", "emotion_valence", "emotion_activation")


@query(
    "flt9_project_timeline",
    f"SELECT id, {SQL_STAMP} FROM segments WHERE contains(projets[1], 'project2') OR contains(lower(resume_texte), 'project2') ORDER BY timestamp, id LIMIT 10",
)
def _(d):
    return flt.project_timeline(d.segments, "project2").select("id", ts())


@query(
    "flt10_relation_history",
    f"SELECT id, {SQL_STAMP} FROM segments WHERE contains(personnes[1], 'person6') OR contains(personnes[2], 'person6') ORDER BY timestamp, id LIMIT 10",
)
def _(d):
    return flt.relation_history(d.segments, "person6").select("id", ts())


@query(
    "flt11_pillars",
    "SELECT id, categorie, importance FROM pillars WHERE categorie = 'TECHNIQUE' AND importance >= 2",
)
def _(d):
    return flt.get_pillars(d.pillars, "technique", 2).select("id", "categorie", "importance")


@query(
    "flt12_query_facts",
    "SELECT id, domaine, importance FROM facts WHERE domaine = 'fr' AND importance >= 3 AND contains(sujet, 'sujet_1') ORDER BY importance DESC, derniere_maj DESC, id LIMIT 10",
)
def _(d):
    return flt.query_facts(d.facts, "fr", "Sujet_1", 3).select("id", "domaine", "importance")


@query(
    "flt13_reflections",
    """SELECT id, domaine, importance, CAST(json_extract_string(metadata, '$.poids_mnemique') AS DOUBLE) AS weight FROM facts
    WHERE domaine = 'reflexion_intuition' AND importance >= 3 AND json_extract_string(metadata, '$.ego_version') = 'v1'
    ORDER BY date_creation DESC, id LIMIT 50""",
)
def _(d):
    out = flt.read_reflections(d.facts, "intuition", 0.4, ego="v1", k=80)
    return out.select("id", "domaine", "importance", F.col("poids_mnemique").alias("weight"))


@query(
    "flt14_last_state",
    """SELECT id, date_diff('day', date_creation, TIMESTAMP '2024-01-31') AS days_since FROM facts WHERE domaine = 'reflexion_etat_mental'
    ORDER BY date_creation DESC, id LIMIT 1""",
)
def _(d):
    return flt.last_state(d.facts, NOW).select("id", "days_since")


@query(
    "flt15_search_text",
    r"""WITH m AS (SELECT doc_id, regexp_split_to_array(lower(text), 'th.*and') AS pieces, regexp_extract_all(lower(text), 'th.*and') AS found
               FROM documents WHERE regexp_matches(lower(text), 'th.*and')),
    e AS (SELECT doc_id, unnest(range(len(found))) AS match_no, found, pieces FROM m)
    SELECT doc_id, match_no, found[match_no + 1] AS matched,
      CAST(list_sum(list_transform(pieces[1:match_no + 1], lambda p: length(p)))
         + coalesce(list_sum(list_transform(found[1:match_no], lambda p: length(p))), 0) AS BIGINT) AS position
    FROM e""",
)
def _(d):
    hits = flt.search_text(d.wide("documents").select("doc_id", "text"), "th*and")
    return hits.select("doc_id", F.col("match_no").cast("long"), F.lower("matched").alias("matched"), F.col("position").cast("long"))


def by_trigrams(d, pieces):
    """Documents of the blocks that can hold the pieces, through a stored trigram index."""
    path = scratch_path(d.spark, "blocks")
    grams.write_blocks(d.wide("documents").select("doc_id", "text"), "doc_id", "text", path)
    return grams.reading(grams.read_blocks(d.spark, path), pieces)


@query(
    "flt15_by_trigrams",
    r"""WITH m AS (SELECT doc_id, regexp_split_to_array(lower(text), 'th.*and') AS pieces, regexp_extract_all(lower(text), 'th.*and') AS found
               FROM documents WHERE regexp_matches(lower(text), 'th.*and')),
    e AS (SELECT doc_id, unnest(range(len(found))) AS match_no, found, pieces FROM m)
    SELECT doc_id, match_no, found[match_no + 1] AS matched,
      CAST(list_sum(list_transform(pieces[1:match_no + 1], lambda p: length(p)))
         + coalesce(list_sum(list_transform(found[1:match_no], lambda p: length(p))), 0) AS BIGINT) AS position
    FROM e""",
)
def _(d):
    hits = flt.search_text(by_trigrams(d, grams.literal_pieces("th*and")), "th*and")
    return hits.select("doc_id", F.col("match_no").cast("long"), F.lower("matched").alias("matched"), F.col("position").cast("long"))


@query(
    "flt15_context",
    r"""WITH m AS (SELECT doc_id, text, strpos(lower(text), 'nnting') AS p FROM documents WHERE contains(lower(text), 'nnting'))
    SELECT doc_id, CAST(p - 1 AS BIGINT) AS position, substring(regexp_replace(regexp_replace(trim(substring(text, greatest(p - 100, 1), p + 106 - greatest(p - 100, 1)), ' '),
      '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), 1, 500) AS context FROM m""",
)
def _(d):
    hits = flt.search_text(d.wide("documents").select("doc_id", "text"), "nnting", context=100, cut=500).filter("match_no = 0")
    return hits.select("doc_id", F.col("position").cast("long"), "context")


@query(
    "flt16_time_scope",
    "SELECT count(*) AS n FROM segments WHERE CAST(timestamp AS DATE) BETWEEN DATE '2024-01-24' AND DATE '2024-01-31'",
)
def _(d):
    start, end = dates.resolve_scope(NOW.date(), "week")
    files = d.segments.withColumn("file_name", F.concat(F.date_format("timestamp", "yyyy-MM-dd"), F.lit(".txt")))
    return flt.in_scope(files, start, end).agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt17_grep_lines",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
    SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, trim(line, ' ') AS line FROM l WHERE contains(lower(line), 'nter')""",
)
def _(d):
    return flt.grep_lines(d.documents.select("doc_id", "text"), "NTER").withColumn("line_no", F.col("line_no").cast("long"))


@query(
    "flt17_by_trigrams",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
    SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, trim(line, ' ') AS line FROM l WHERE contains(lower(line), 'nter')""",
)
def _(d):
    return flt.grep_lines(by_trigrams(d, ["NTER"]), "NTER").withColumn("line_no", F.col("line_no").cast("long"))


@query(
    "flt17_grep_counts",
    """WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT source, count(*) AS n_lines FROM l WHERE contains(lower(line), 'und') GROUP BY source""",
)
def _(d):
    return flt.grep_counts(d.documents.select("source", "text"), "und", "source")


@query(
    "flt18_grep_regex",
    r"""WITH l AS (SELECT concat('doc', CAST(doc_id AS VARCHAR), '.txt') AS file_name, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
    SELECT file_name, CAST(line_no AS BIGINT) AS line_no, CAST(NULL AS BIGINT) AS token_start, regexp_extract(line, '(?i)\bwh[a-z]+ of', 0) AS matched FROM l
    WHERE regexp_matches(line, '(?i)\bwh[a-z]+ of') AND NOT contains(line, '|') ORDER BY file_name DESC, line_no LIMIT 50""",
)
def _(d):
    docs = d.documents.select(F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".txt")).alias("file_name"), "text")
    plain = docs.withColumn("text", F.array_join(F.transform(F.split("text", "\n"), lambda x: F.when(~F.contains(x, F.lit("|")), x)), "\n", ""))
    return flt.grep_regex(plain, r"\bwh[a-z]+ of").select("file_name", F.col("line_no").cast("long"), "token_start", "matched")


@query("flt19_passages")
def _(d):
    docs = d.documents.select(F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".txt")).alias("file_name"), "text")
    return flt.search_recent(docs, "ertion", context=200)


@query(
    "flt20_search_keyword",
    f"""SELECT id, {SQL_STAMP} FROM segments WHERE contains(lower(resume_texte), 'purchase') OR contains(sujets[1], 'purchase')
    OR contains(personnes[1], 'purchase') OR contains(projets[1], 'purchase') ORDER BY timestamp DESC, id LIMIT 50""",
)
def _(d):
    return flt.search_keyword(d.segments, "Purchase").select("id", ts())


@query("flt21_failed_segments", "SELECT id, source_file FROM segments WHERE confidence_score = 0.5 AND contains(source_file, 'u2')")
def _(d):
    return flt.failed_segments(d.segments, "u2").select("id", "source_file")


@query("flt21_missing_field", "SELECT id FROM segments WHERE gr_id IS NULL")
def _(d):
    return flt.missing_field(d.segments, "gr_id").select("id")


@query("flt22_stale_documents", "SELECT chunk_id FROM chunks WHERE date_modified > indexed_at")
def _(d):
    return flt.stale_documents(d.chunks).select("chunk_id")


@query("flt23_docs_by_tag_prefix", "SELECT chunk_id, doc_id FROM chunks WHERE starts_with(roget_codes[1], '04-0110')")
def _(d):
    return flt.docs_by_tag_prefix(d.chunks, "04-0110").select("chunk_id", "doc_id")


@query("flt24_daily_window", f"SELECT id, {SQL_STAMP} FROM segments WHERE timestamp > TIMESTAMP '2024-01-31' - INTERVAL 36 HOURS")
def _(d):
    return flt.daily_window(d.segments, NOW, 36).select("id", ts())


@query(
    "flt25_drop_conversations",
    """WITH c AS (SELECT DISTINCT source AS title, doc_id FROM documents)
    SELECT title, count(*) AS n FROM c WHERE title NOT IN ('src1', 'src7') GROUP BY title""",
)
def _(d):
    titles = d.spark.createDataFrame([("src1",), ("src7",), ("unknown",)], "title STRING")
    kept = flt.drop_conversations(d.documents.select(F.col("source").alias("title"), "doc_id"), titles)
    return kept.groupBy("title").agg(F.count(F.lit(1)).alias("n"))


@query("flt25_title_suggestions", "SELECT DISTINCT source AS title FROM documents WHERE contains(source, 'c1')")
def _(d):
    return flt.title_suggestions(d.documents.select(F.col("source").alias("title")), "C1")


def _correction_sql(fact: str = "lower(nouveau_fait)") -> str:
    """`fact`: what makes two new facts of a document the same."""
    parts = []
    for no, rx in enumerate(CORRECTION_PATTERNS):
        rx = "(?i)" + rx.replace("'", "''")
        two = no in (5, 6, 7)
        old = f"trim(regexp_extract(line, '{rx}', 1), ' ')" if two else "''"
        new = f"trim(regexp_extract(line, '{rx}', {2 if two else 1}), ' ')"
        parts.append(f"SELECT doc_id, line_no, {no} AS pattern_no, {old} AS ancien_fait, {new} AS nouveau_fait FROM l WHERE regexp_matches(line, '{rx}')")
    return (
        """WITH t AS (SELECT doc_id, concat('non, c''est ', replace(text, ', ', ', c''est pas ')) AS text FROM documents),
        l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM t),
        hits AS (""" + "\nUNION ALL ".join(parts) + """),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, """ + fact + """ ORDER BY line_no, pattern_no) AS rn
              FROM hits WHERE length(nouveau_fait) > 3)
        SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(pattern_no AS INT) AS pattern_no, ancien_fait, nouveau_fait FROM r WHERE rn = 1"""
    )


def _corrections(d, letters=None):
    # the invented prose holds no corrections, so marker phrases are woven into every text
    docs = d.wide("documents").select("doc_id", F.concat(F.lit("non, c'est "), F.replace("text", F.lit(", "), F.lit(", c'est pas "))).alias("text"))
    return flt.detect_corrections(docs, "doc_id", letters=letters).select(
        "doc_id", F.col("line_no").cast("long"), "pattern_no", "ancien_fait", "nouveau_fait"
    )


@query("flt26_detect_corrections", _correction_sql())
def _(d):
    return _corrections(d)


@query("flt26_corrections_by_start", _correction_sql("substring(lower(nouveau_fait), 1, 50)"))
def _(d):
    return _corrections(d, 50)


@query("flt27_indexable", "SELECT conv_id, turn FROM exchanges WHERE length(trim(text, ' ')) >= 3 AND turn % 5 <> 0")
def _(d):
    rows = d.exchanges.withColumn("indexable", F.when(F.col("turn") % 5 == 0, False))
    return flt.indexable(rows).select("conv_id", "turn")


@query(
    "flt28_candidates_to_refute",
    """WITH r AS (SELECT id, source_file AS correction_id, row_number() OVER (PARTITION BY source_file ORDER BY timestamp, id) AS rn
      FROM segments WHERE statut_verite <> -1) SELECT id, correction_id FROM r WHERE rn <= 20""",
)
def _(d):
    hits = d.segments.withColumn("correction_id", F.col("source_file"))
    return flt.candidates_to_refute(hits, order="timestamp").select("id", "correction_id")


@query("flt29_segments_by_id", "SELECT id, auteur FROM segments WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(d):
    wanted = d.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return flt.segments_by_id(d.segments, wanted).select("id", "auteur")


_READABLE = ", ".join(f"'{e}'" for e in TEXT_EXTENSIONS)


@query(
    "flt30_enrich_status",
    f"""SELECT id, CASE WHEN extension NOT IN ({_READABLE}) THEN 'skipped' WHEN size < 300 THEN 'no_content' WHEN id % 10 = 7 THEN 'error' ELSE 'enriched' END AS status,
      CASE WHEN extension IN ({_READABLE}) AND size >= 300 AND id % 10 = 7 THEN 'bad answer' END AS error_message FROM files""",
)
def _(d):
    files = d.files.withColumns(
        {
            "content": F.when(F.col("size") >= 300, F.col("summary")),
            "parse_error": F.when(F.col("id") % 10 == 7, F.lit("bad answer")),
        }
    )
    return flt.enrich_status(files).select("id", "status", "error_message")


@query(
    "fn18_digest_lines",
    f"""SELECT id, concat(CASE auteur WHEN 'human' THEN '🧑' WHEN 'assistant' THEN '🤖' ELSE '💭' END, ' [', CAST(id AS VARCHAR), '] ', strftime(timestamp, '%H:%M'), ' | ',
      rpad(source_nature, 10, ' '), ' | ', substring(resume_texte, 1, 60), '...') AS line FROM segments""",
)
def _(d):
    line = formats.digest_line(*[F.col(c) for c in ("auteur", "id", "timestamp", "source_nature", "resume_texte")])
    return d.segments.select("id", line.alias("line"))

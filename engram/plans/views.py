"""Views over the given tables that stand for the engine's own tables.

The SQL text is shared with the checking engine, so both sides read the same rows; only array, map and time
functions differ by dialect.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from engram.session import spread

SEGMENTS = """
SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS timestamp,
       CAST(event_id * 7 % 1000 AS INT) AS token_start, CAST(event_id * 7 % 1000 + 5 AS INT) AS token_end,
       concat('u', CAST(user_id % 5 AS VARCHAR(20)), '.txt') AS source_file,
       CASE WHEN event_id % 10 = 0 THEN 'reflexion' ELSE 'trace' END AS source_nature,
       event_type AS source_origine,
       CASE event_id % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'assistant' ELSE 'internal' END AS auteur,
       (CAST(floor(value * 100) AS BIGINT) % 201 - 100) / 100.0E0 AS emotion_valence,
       (event_id * 7 % 101) / 100.0E0 AS emotion_activation,
       {array}(concat(lpad(CAST(1 + event_id % 6 AS VARCHAR(20)), 2, '0'), '-',
              lpad(CAST(10 * (event_id % 30) AS VARCHAR(20)), 4, '0'), '-',
              lpad(CAST(10 * (user_id % 40) AS VARCHAR(20)), 4, '0'))) AS tags_roget,
       {array}(concat('person', CAST(user_id % 7 AS VARCHAR(20))), concat('person', CAST(event_id % 11 AS VARCHAR(20)))) AS personnes,
       {array}(concat('project', CAST(user_id % 4 AS VARCHAR(20)))) AS projets,
       {array}(event_type) AS sujets,
       {array}(CASE event_type WHEN 'click' THEN 'bureau' WHEN 'view' THEN 'maison' WHEN 'purchase' THEN 'magasin' ELSE 'parc' END) AS lieux,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(floor(event_id / 4.0E0) AS BIGINT) END AS gr_id,
       CAST(0 AS INT) AS pilier,
       CASE WHEN event_id % 17 = 0 THEN 0.5E0 ELSE 0.9E0 END AS confidence_score,
       CAST(CASE WHEN event_id % 19 = 0 THEN -1 ELSE 0 END AS INT) AS statut_verite,
       CASE WHEN event_id % 23 = 0 THEN 'court' ELSE concat(event_type, ' by user ', CAST(user_id AS VARCHAR(20)), ' props ', props) END AS resume_texte
FROM {events}
"""

EXCHANGES = """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'human' ELSE role END AS auteur, text
FROM {conversations} WHERE role IN ('user', 'assistant')
"""

FILES = """
SELECT doc_id AS id, concat('/', source, '/', lang, '/doc', CAST(doc_id AS VARCHAR(20)), '.txt') AS path_display,
       concat('doc', CAST(doc_id AS VARCHAR(20)), '.txt') AS name,
       CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.pdf' WHEN 2 THEN '.txt' ELSE '.exe' END AS extension,
       n_chars AS size, lang AS domain, text AS summary,
       CAST(1 + doc_id % 5 AS INT) AS importance,
       CASE WHEN doc_id % 3 = 0 THEN 'pending' ELSE 'enriched' END AS status,
       md5(text) AS content_hash
FROM {documents}
"""

# documents cut into lines of a chunk table
CHUNKS = """
SELECT concat(source, '-', lang) AS doc_id, concat(source, '-', lang, '.txt') AS filename,
       concat('file:///', source, '/', CAST(doc_id AS VARCHAR(20))) AS source_uri,
       CAST(doc_id AS VARCHAR(20)) AS chunk_id, CAST(doc_id AS INT) AS chunk_index,
       CAST(floor(n_chars / 4.0E0) AS INT) AS content_tokens, lang AS domain, source AS project,
       {array}(concat(lpad(CAST(1 + doc_id % 6 AS VARCHAR(20)), 2, '0'), '-', lpad(CAST(10 * (doc_id % 20) AS VARCHAR(20)), 4, '0'), '-0010')) AS roget_codes,
       {days}('2024-01-01', CAST(doc_id % 28 AS INT)) AS indexed_at,
       {days}('2024-01-01', CAST(doc_id * 3 % 28 AS INT)) AS date_modified
FROM {documents}
"""

PROJECTS = """
SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS nom, CAST(NULL AS BIGINT) AS parent_id FROM {region}
UNION ALL
SELECT 100 + CAST(n_nationkey AS BIGINT), n_name, CAST(n_regionkey AS BIGINT) FROM {nation}
UNION ALL
SELECT 1000 + c_custkey, c_name, 100 + CAST(c_nationkey AS BIGINT) FROM {customer}
"""

FACTS = """
SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'reflexion_etat_mental' WHEN 1 THEN 'reflexion_intuition' ELSE lang END AS domaine,
       concat('sujet_', CAST(doc_id AS VARCHAR(20))) AS sujet, text AS information,
       CAST(1 + doc_id % 5 AS INT) AS importance,
       concat('{{"type_reflexion": "x", "poids_mnemique": 0.', CAST(doc_id % 10 AS VARCHAR(20)), ', "ego_version": "v', CAST(doc_id % 3 AS VARCHAR(20)), '"}}') AS metadata,
       {days}('2024-01-01', CAST(doc_id % 28 AS INT)) AS date_creation,
       {days}('2024-02-01', CAST(doc_id % 28 AS INT)) AS derniere_maj
FROM {documents}
"""

PILLARS = """
SELECT doc_id AS id, text AS fait,
       CASE doc_id % 5 WHEN 0 THEN 'IDENTITE' WHEN 1 THEN 'RECHERCHE' WHEN 2 THEN 'TECHNIQUE' WHEN 3 THEN 'RELATION' ELSE 'VALEUR' END AS categorie,
       CAST(doc_id % 4 AS INT) AS importance, {days}('2024-01-01', CAST(doc_id % 28 AS INT)) AS date_creation
FROM {documents}
"""

VIEWS = {
    "segments": SEGMENTS, "exchanges": EXCHANGES, "files": FILES, "chunks": CHUNKS, "projects": PROJECTS, "facts": FACTS,
    "pillars": PILLARS,
}
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; times without a zone become instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema if f.dataType.simpleString() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive})


def view(spark: SparkSession, sf_dir: str, name: str, wide: bool = False) -> DataFrame:
    """`wide` spreads the rows of the given tables, so that the view's columns are made on all cores and don't travel."""
    text = VIEWS[name]
    sources = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    if wide:
        sources = {t: spread(df) for t, df in sources.items()}
    text = text.replace("{array}", "array").replace("{days}(", "engram_days(")
    text = text.replace("{{", "\0").replace("}}", "\1")
    import re

    text = re.sub(r"engram_days\('([^']+)', (CAST\([^)]*\))\)", r"CAST(date_add(DATE '\1', \2) AS TIMESTAMP)", text)
    # literal braces would be read as placeholders, so they travel as arguments
    text = text.replace("\0", "{open}").replace("\1", "{close}")
    for t, df in sources.items():
        df.createOrReplaceTempView(f"_engram_{t}")
        text = text.replace("{" + t + "}", f"_engram_{t}")
    text = text.replace("{open}", "{").replace("{close}", "}")
    return spark.sql(text)


@cache
def check_sql(name: str) -> str:
    """The view for the checking engine."""
    import re

    text = VIEWS[name].replace("{array}", "list_value")
    text = re.sub(r"\{days\}\('([^']+)', (CAST\([^)]*\))\)", r"CAST(DATE '\1' + \2 AS TIMESTAMP)", text)
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text.replace("{{", "{").replace("}}", "}")


def with_views(sql: str) -> str:
    """Put the views a checking query names in front of it."""
    import re

    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    ctes = [f"{n} AS ({check_sql(n)})" for n in used]
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[len("WITH RECURSIVE"):]
    if body.upper().startswith("WITH"):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[len("WITH"):]
    return "WITH " + ",\n".join(ctes) + "\n" + body

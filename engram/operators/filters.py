"""Filters and searches over segments, documents, facts and pillars.

Every predicate is a native expression, so column pruning and parquet push-down stay with the optimizer.
Top-k results use `orderBy().limit()`, which Spark runs as per-partition heaps plus one merge.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from engram.functions import lexicon as lx
from engram.functions.dates import at
from engram.functions.text import contains_any, file_date, fold, normalize_list, wildcard_regex


def like(col: Column, word: str) -> Column:
    """Case-insensitive substring."""
    return F.contains(F.lower(col), F.lit(word.lower()))


def haystack(*cols: str) -> Column:
    """Lower-case text of several columns (texts or lists), one item per line; missing ones are left out."""
    return F.lower(F.concat_ws("\n", *cols))


def list_like(col: str, word: str) -> Column:
    """Substring inside any element of an array."""
    return F.contains(haystack(col), F.lit(word.lower()))


def any_of(conditions: Sequence[Column]) -> Column:
    hit = F.lit(False)
    for c in conditions:
        hit = hit | F.coalesce(c, F.lit(False))
    return hit


def newest(df: DataFrame, k: int | None) -> DataFrame:
    return df.orderBy(F.desc("timestamp"), F.asc("id")).limit(k) if k is not None else df


def oldest(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.asc("timestamp"), F.asc("id")).limit(k)


# --- candidates of a search ---------------------------------------------------------------------
def candidate_predicate(
    keywords: Sequence[str] = (),
    tags: Sequence[str] = (),
    persons: Sequence[str] = (),
    start: datetime | None = None,
    end: datetime | None = None,
    most_keywords: int | None = None,
    most_persons: int | None = None,
) -> Column:
    """Date range AND keywords (unless persons are asked) AND tags AND persons, each an OR over its values.

    All keywords and persons filter; `most_keywords=5` and `most_persons=3` are the contract's shorter lists.
    """
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col("timestamp") >= at(start))
    if end is not None:
        cond = cond & (F.col("timestamp") <= at(end))
    if keywords and not persons:
        cond = cond & any_of(
            [F.contains(haystack("resume_texte", "sujets", "projets", "lieux"), F.lit(w.lower())) for w in keywords[:most_keywords]]
        )
    if tags:
        cond = cond & any_of([list_like("tags_roget", t) for t in tags])
    if persons:
        cond = cond & any_of([F.contains(normalize_list(F.col("personnes")), fold(F.lit(p))) for p in persons[:most_persons]])
    return cond


def candidates(seg: DataFrame, limit: int | None = None, **query) -> DataFrame:
    """Candidate segments; `limit=100` gives the newest hundred only, the default keeps all."""
    return newest(seg.filter(candidate_predicate(**query)), limit)


def search_by_date(seg: DataFrame, start: datetime, end: datetime, k: int = 20) -> DataFrame:
    hits = seg.filter(F.col("timestamp").between(at(start), at(end)))
    return newest(hits, k).withColumn("score", F.lit(1.0))


def search_by_person(seg: DataFrame, person: str, k: int = 10) -> DataFrame:
    return newest(seg.filter(F.contains(normalize_list(F.col("personnes")), fold(F.lit(person)))), k)


def search_by_tags(seg: DataFrame, tags: Sequence[str], k: int = 10) -> DataFrame:
    return newest(seg.filter(any_of([list_like("tags_roget", t) for t in tags])), k)


KEYWORD_FIELDS = ("resume_texte", "sujets", "personnes", "projets")


def search_keyword(seg: DataFrame, word: str, k: int = 50) -> DataFrame:
    """Keyword in summary, subjects, persons or projects, newest first."""
    return newest(seg.filter(F.contains(haystack(*KEYWORD_FIELDS), F.lit(word.lower()))), k)


# --- audits --------------------------------------------------------------------------------------
@dataclass(frozen=True)
class AuditFilters:
    auteur: str | None = None
    source_nature: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    has_tags: bool = False
    search_resume: str | None = None

    def predicate(self) -> Column:
        cond = F.lit(True)
        if self.auteur:
            cond = cond & (F.col("auteur") == self.auteur)
        if self.source_nature:
            cond = cond & (F.col("source_nature") == self.source_nature)
        # bounds on the raw column, so that they reach the parquet scan
        if self.date_from:
            cond = cond & (F.col("timestamp") >= F.lit(self.date_from).cast("date").cast("timestamp"))
        if self.date_to:
            cond = cond & (F.col("timestamp") < F.date_add(F.lit(self.date_to).cast("date"), 1).cast("timestamp"))
        if self.has_tags:
            cond = cond & (F.size("tags_roget") > 0)
        if self.search_resume:
            cond = cond & like(F.col("resume_texte"), self.search_resume)
        return cond


def checked_limit(limit: int) -> int:
    if limit < 1:
        raise ValueError("a limit is at least 1")
    return limit


def inspect(seg: DataFrame, filters: AuditFilters = AuditFilters(), limit: int = 50, offset: int = 0, order: str = "recent") -> DataFrame:
    by = F.desc("timestamp") if order == "recent" else F.asc("timestamp")
    page = seg.filter(filters.predicate()).orderBy(by, F.asc("id"))
    return page.offset(max(0, offset)).limit(checked_limit(limit))


def get_segments(seg: DataFrame, limit: int = 10, offset: int = 0, fields: Sequence[str] | None = None, segment_id: int | None = None) -> DataFrame:
    """One segment, or a page of the newest ones, with the wanted fields."""
    cols = [c for c in fields or seg.columns if c in seg.columns]
    if segment_id is not None:
        return seg.filter(F.col("id") == segment_id).select(*cols)
    return seg.orderBy(F.desc("timestamp"), F.asc("id")).offset(max(0, offset)).limit(checked_limit(limit)).select(*cols)


def segments_by_id(seg: DataFrame, ids: DataFrame) -> DataFrame:
    """Segments of an id table; Spark broadcasts the ids when their size allows it."""
    return seg.join(ids.select("id").distinct(), "id", "left_semi")


def failed_segments(seg: DataFrame, source_file: str | None = None) -> DataFrame:
    """Segments that carry the fallback confidence."""
    out = seg.filter(F.col("confidence_score") == 0.5)
    return out.filter(F.contains("source_file", F.lit(source_file))) if source_file else out


def missing_field(df: DataFrame, field: str, source_file: str | None = None) -> DataFrame:
    out = df.filter(F.col(field).isNull())
    return out.filter(F.contains("source_file", F.lit(source_file))) if source_file else out


# --- emotions, people, projects -------------------------------------------------------------------
def emotional_resonance(seg: DataFrame, valence: float | None = None, activation: float | None = None, k: int = 10) -> DataFrame:
    """Segments of an emotion quadrant with a 0.2 tolerance, most intense in the asked direction first."""
    if valence is None and activation is None:
        raise ValueError("valence or activation is needed")
    v, a = F.col("emotion_valence"), F.col("emotion_activation")
    cond = v.isNotNull() & a.isNotNull()
    if valence is not None:
        cond = cond & (v <= valence + 0.2 if valence < 0 else v >= valence - 0.2)
    if activation is not None:
        cond = cond & (a >= activation - 0.2 if activation > 0.5 else a <= activation + 0.2)
    order = [a.desc()]
    if valence:
        order = [v.asc() if valence < 0 else v.desc(), a.desc()]
    return seg.filter(cond).orderBy(*order, F.asc("id")).limit(k)


def project_timeline(seg: DataFrame, word: str, k: int = 10) -> DataFrame:
    return oldest(seg.filter(list_like("projets", word) | like(F.col("resume_texte"), word)), k)


def relation_history(seg: DataFrame, name: str, k: int = 10) -> DataFrame:
    return oldest(seg.filter(list_like("personnes", name)), k)


def daily_window(seg: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """Segments of the last hours, oldest first."""
    start = at(now) - F.expr(f"INTERVAL {int(hours)} HOURS")
    return seg.filter(F.col("timestamp") > start).orderBy("timestamp", "id")


# --- pillars, facts, reflections -------------------------------------------------------------------
def get_pillars(pillars: DataFrame, category: str | None = None, min_importance: int = 0, k: int | None = None) -> DataFrame:
    out = pillars.filter(F.col("importance") >= min_importance)
    if category:
        out = out.filter(F.col("categorie") == category.upper())
    out = out.orderBy(F.desc("importance"), F.desc("date_creation"), F.asc("id"))
    return out.limit(k) if k else out


def query_facts(facts: DataFrame, domain: str | None = None, subject: str | None = None, min_importance: int = 1, k: int = 10) -> DataFrame:
    out = facts.filter(F.col("importance") >= min_importance)
    if domain:
        out = out.filter(F.col("domaine") == domain)
    if subject:
        out = out.filter(like(F.col("sujet"), subject))
    return out.orderBy(F.desc("importance"), F.desc("derniere_maj"), F.asc("id")).limit(k)


def importance_of(weight: Column) -> Column:
    """Importance 1..5 of a weight 0..1."""
    return F.least(F.lit(5), F.greatest(F.lit(1), (weight * 5).cast("int") + 1))


def read_reflections(
    facts: DataFrame, kind: str | None = None, min_weight: float = 0.0, ego: str | None = None, model: str | None = None, k: int = 10
) -> DataFrame:
    """Reflections, newest first. Filters on the JSON metadata apply before the limit."""
    meta = lambda key: F.get_json_object("metadata", f"$.{key}")
    out = facts.filter(F.col("domaine").startswith("reflexion_" + (kind or "")))
    if kind:
        out = out.filter(F.col("domaine") == "reflexion_" + kind)
    if min_weight > 0:
        out = out.filter(F.col("importance") >= importance_of(F.lit(min_weight)))
    if ego:
        out = out.filter(meta("ego_version") == ego)
    if model:
        out = out.filter(meta("modele") == model)
    out = out.withColumns({"type_reflexion": meta("type_reflexion"), "poids_mnemique": meta("poids_mnemique").cast("double")})
    return out.orderBy(F.desc("date_creation"), F.asc("id")).limit(checked_limit(k))


def last_state(facts: DataFrame, now: datetime) -> DataFrame:
    """Newest mental state and the whole days since."""
    states = facts.filter(F.col("domaine") == "reflexion_etat_mental")
    newest_row = F.max_by(F.struct("id", "information", "date_creation"), F.struct("date_creation", -F.col("id")))
    days = F.floor((F.unix_seconds(at(now)) - F.unix_seconds("date_creation")) / 86400).cast("long")
    return states.agg(newest_row.alias("s")).select("s.*").filter("id IS NOT NULL").withColumn("days_since", days)


# --- text archive -----------------------------------------------------------------------------------
def in_scope(files: DataFrame, start: str | None, end: str | None, name: str = "file_name") -> DataFrame:
    """Files whose name starts with a date in the range; without a range everything stays."""
    if not (start or end):
        return files
    day = file_date(F.col(name))
    cond = day.isNotNull()
    if start:
        cond = cond & (day >= start)
    if end:
        cond = cond & (day <= end)
    return files.filter(cond)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _running(gaps: pd.Series, sizes: pd.Series) -> pd.Series:
    """Start of each match: all gaps up to it and all matches before it."""
    return pd.Series([np.cumsum(g[: len(n)]) + np.cumsum(n) - n for g, n in zip(gaps, sizes)], dtype="object")


def search_text(docs: DataFrame, query: str, context: int = 300, text: str = "text", cut: int | None = None) -> DataFrame:
    """All matches of a wildcard query with 0-based position, match and squeezed context (its first `cut` characters).

    Positions come from splitting on the matches themselves, one pass per text and no second search:
    the start of match i is the length of the pieces and matches before it.
    """
    if context < 0:
        raise ValueError("context is not negative")
    pattern = "(?i)" + wildcard_regex(query)
    source = docs.filter(F.col(text).rlike(pattern))
    found = source.withColumn("_m", F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    starts = _running(gaps, F.transform("_m", lambda m: F.length(m)))
    pairs = F.arrays_zip(starts.alias("position"), F.col("_m").alias("matched"))
    hits = found.select(*docs.columns, F.posexplode(pairs).alias("match_no", "h")).select(*docs.columns, "match_no", "h.*")
    position = F.col("position")
    begin = F.greatest(F.lit(0), position - context)
    width = position + F.length("matched") + context - begin
    around = F.trim(F.substring(F.col(text), begin + 1, width))
    around = F.regexp_replace(F.regexp_replace(around, r"\n{3,}", "\n\n"), r"[ \t]+", " ")
    return hits.select(
        *[c for c in docs.columns if c != text], "match_no", position.alias("position"), "matched",
        (F.substring(around, 1, cut) if cut else around).alias("context"),
    )


def grep_lines(docs: DataFrame, term: str, text: str = "text") -> DataFrame:
    """Lines that hold the term (any case), 1-based line number."""
    lines = docs.filter(like(F.col(text), term)).select(
        *[c for c in docs.columns if c != text], F.posexplode(F.split(text, "\n")).alias("line_no", "line")
    )
    return lines.filter(like(F.col("line"), term)).withColumns({"line_no": F.col("line_no") + 1, "line": F.trim("line")})


def grep_counts(docs: DataFrame, term: str, by: str) -> DataFrame:
    return grep_lines(docs, term).groupBy(by).agg(F.count(F.lit(1)).alias("n_lines"))


def grep_regex(docs: DataFrame, pattern: str, k: int = 50, name: str = "file_name", text: str = "text", cut: int | None = None) -> DataFrame:
    """First matches of a regex per line (its first `cut` letters), newest file name first, with the token offset before `|`."""
    rx = "(?i)" + pattern
    lines = docs.filter(F.col(text).rlike(rx)).select(name, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    offset = F.when(F.contains("line", F.lit("|")), F.trim(F.split_part("line", F.lit("|"), F.lit(1))).try_cast("long"))
    return (
        lines.filter(F.col("line").rlike(rx))
        .select(
            name, (F.col("line_no") + 1).alias("line_no"), offset.alias("token_start"),
            (F.substring("line", 1, cut) if cut else F.col("line")).alias("content"), F.regexp_extract("line", f"({rx})", 1).alias("matched"),
        )
        .orderBy(F.desc(name), F.asc("line_no"))
        .limit(k)
    )


def passages(docs: DataFrame, query: str, context: int = 500, text: str = "text") -> DataFrame:
    """Matches with a passage that ends at line breaks and marks what was cut."""
    import re

    pattern = "(?i)" + re.escape(query)
    keep = [c for c in docs.columns if c != text]
    hits = docs.filter(F.col(text).rlike(pattern))
    schema = "array<struct<match_no:int,passage:string>>"

    @F.pandas_udf(schema)
    def snap(texts):
        rx = re.compile(re.escape(query), re.IGNORECASE)

        def around(body, m):
            lo, hi = max(0, m.start() - context), min(len(body), m.end() + context)
            if lo > 0:
                cut = body.rfind("\n", max(0, lo - 100), m.start())
                lo = cut + 1 if cut > lo - 100 else lo
            if hi < len(body):
                cut = body.find("\n", m.end(), hi + 100)
                hi = cut if cut != -1 else hi
            return ("..." if lo > 0 else "") + body[lo:hi].strip() + ("..." if hi < len(body) else "")

        return texts.map(lambda b: [{"match_no": i, "passage": around(b, m)} for i, m in enumerate(rx.finditer(b))])

    return hits.select(*keep, F.explode(snap(F.col(text))).alias("p")).select(*keep, "p.*")


def search_recent(docs: DataFrame, query: str, start: str | None = None, end: str | None = None, context: int = 500, k: int = 10, name: str = "file_name") -> DataFrame:
    """First passages, newest file first."""
    return passages(in_scope(docs, start, end, name), query, context).orderBy(F.desc(name), F.asc("match_no")).limit(k)


# --- documents ----------------------------------------------------------------------------------------
def stale_documents(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("date_modified") > F.col("indexed_at"))


def docs_by_tag_prefix(docs: DataFrame, prefix: str) -> DataFrame:
    return docs.filter(F.exists("roget_codes", lambda c: c.startswith(prefix))).orderBy(F.desc("indexed_at"), "doc_id")


def enrich_status(files: DataFrame, cut: int | None = None) -> DataFrame:
    """Next status of a file; `content` and `parse_error` (its first `cut` letters are kept) come from the reading step."""
    readable = F.col("extension").isNull() | (F.col("extension") == "") | F.lower("extension").isin(*lx.TEXT_EXTENSIONS)
    status = (
        F.when(~readable, "skipped")
        .when(F.coalesce("content", F.lit("")) == "", "no_content")
        .when(F.col("parse_error").isNotNull(), "error")
        .otherwise("enriched")
    )
    return files.withColumn("status", status).withColumn(
        "error_message", F.when(F.col("status") == "error", F.substring("parse_error", 1, cut) if cut else F.col("parse_error"))
    )


def drop_conversations(conversations: DataFrame, titles: DataFrame) -> DataFrame:
    """Conversations without the titled ones. Titles that were read with the wrong encoding match as well."""
    broken = F.decode(F.encode(F.col("title"), "UTF-8"), "ISO-8859-1")
    wanted = titles.select(F.explode(F.array(F.col("title"), broken)).alias("title")).distinct()
    return conversations.join(wanted, "title", "left_anti")


def title_suggestions(conversations: DataFrame, part: str) -> DataFrame:
    return conversations.filter(like(F.col("title"), part)).select("title").distinct()


CORRECTION_WORDS = ["c'est", "correction", "vraie", "bonne", "trompe", "oublie", "dis", "utilise"]


def detect_corrections(docs: DataFrame, key: str, text: str = "text", letters: int | None = None, cut: int | None = None) -> DataFrame:
    """Sentences that correct something: (old fact, new fact), one per document and new fact.

    `letters=50` is the contract's rule, which takes new facts of one start for the same; `cut` keeps the start of the line
    that is given as context (300 in the contract)."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    # every pattern needs one of these words; the test is far cheaper than nine regexes
    lines = lines.filter(contains_any(F.lower("line"), CORRECTION_WORDS))
    found = []
    for number, pattern in enumerate(lx.CORRECTION_PATTERNS):
        rx = "(?iu)" + pattern
        two = pattern.count("(") - pattern.count("(?") >= 2
        raw = F.regexp_extract("line", rx, 1)
        first = F.trim(raw)
        second = F.trim(F.regexp_extract("line", rx, 2)) if two else first
        found.append(
            F.when(
                raw != "",  # group 1 is never empty in a match
                F.struct(
                    F.lit(number).alias("pattern_no"), (first if two else F.lit("")).alias("ancien_fait"),
                    second.alias("nouveau_fait"),
                ),
            )
        )
    hits = (
        lines.select(key, (F.col("line_no") + 1).alias("line_no"), (F.substring("line", 1, cut) if cut else F.col("line")).alias("contexte"),
                     F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("hit"))
        .select(key, "line_no", "contexte", "hit.*")
        .filter(F.length("nouveau_fait") > 3)
    )
    # first of each group by aggregation, so the map side already reduces repeated lines
    columns = F.struct("line_no", "pattern_no", "ancien_fait", "nouveau_fait", "contexte")
    return (
        hits.groupBy(key, (F.substring(F.lower("nouveau_fait"), 1, letters) if letters else F.lower("nouveau_fait")).alias("_short"))
        .agg(F.min(columns).alias("hit"))
        .select(key, "hit.*", F.lit(0.7).alias("confidence"))
    )


def candidates_to_refute(hits: DataFrame, n: int = 20, by: str = "correction_id", order: str = "rank") -> DataFrame:
    """First hits per correction that are not refuted yet."""
    rn = F.row_number().over(W.partitionBy(by).orderBy(order, "id"))
    return hits.filter(F.coalesce("statut_verite", F.lit(0)) != -1).withColumn("_rn", rn).filter(F.col("_rn") <= n).drop("_rn")


def indexable(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(F.coalesce(F.col("indexable"), F.lit(True)) & (F.length(F.trim(F.col(text))) >= 3))

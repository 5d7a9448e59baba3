"""Hybrid search: filter, score, rank, format; emotion ranking; searches with expanded and widened terms."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from engram.functions import let, lexicon as lx, scores
from engram.functions.dates import at
from engram.functions.formats import context_block
from engram.functions.text import fold, normalize_list
from engram.operators import filters as flt, grams, windows
from engram.session import materialise

@dataclass(frozen=True)
class Query:
    """One parsed search."""

    query_id: int
    text: str = ""
    keywords: Sequence[str] = ()
    tags: Sequence[str] = ()
    persons: Sequence[str] = ()
    start: datetime | None = None
    end: datetime | None = None
    emotion: tuple[float, float] | None = None
    weights: Mapping[str, float] = field(default_factory=lambda: dict(lx.DEFAULT_WEIGHTS))
    top_k: int = 5


QUERY_ROW = """query_id bigint, text string, keywords array<string>, tags array<string>, persons array<string>, start timestamp, end timestamp,
    ev double, ea double, w_tags double, w_emotion double, w_time double, w_persons double, w_summary double, mask map<int,double>, top_k int"""


def query_table(spark: SparkSession, queries: Sequence[Query]) -> DataFrame:
    """A log of searches as a table, one row each (the columns of `QUERY_ROW`)."""
    def instant(t: datetime | None) -> datetime | None:
        return t if t is None or t.tzinfo else t.replace(tzinfo=timezone.utc)

    rows = []
    for q in queries:
        w = {k: float(q.weights.get(k, d)) for k, d in lx.DEFAULT_WEIGHTS.items()}
        rows.append((
            q.query_id, q.text, list(q.keywords), list(q.tags), list(q.persons), instant(q.start), instant(q.end), *(map(float, q.emotion) if q.emotion else (None, None)),
            w["tags_roget"], w["emotion"], w["timestamp"], w["personnes"], w["resume_texte"], scores.mask_of(q.weights), q.top_k,
        ))
    return spark.createDataFrame(rows, QUERY_ROW)


def _words(col: str) -> Column:
    return F.transform(col, lambda w: F.lower(w))


def _names(col: str = "q.persons") -> Column:
    return F.transform(col, lambda p: fold(p))


def _with_words(log: DataFrame) -> DataFrame:
    """The log with the words that are compared, so that no pair makes them anew."""
    return log.withColumns({"_words": _words("keywords"), "_tags": _words("tags"), "_names": _names("persons")})


def _with_texts(seg: DataFrame) -> DataFrame:
    """The segments with the texts that searches look into, made once per segment."""
    return seg.withColumns({
        "_low": flt.haystack(*KEYWORD_TEXT), "_held": flt.haystack("tags_roget"), "_people": normalize_list(F.col("personnes")),
        "_summary": F.lower(F.coalesce("resume_texte", F.lit(""))),
    })


SCANNED = 64  # queries that are tested against every row, where no index is at hand
LISTED = 10_000  # queries that are sent to every task
KEYWORD_TEXT = ("resume_texte", "sujets", "projets", "lieux")


def index_segments(seg: DataFrame, only: DataFrame | None = None) -> grams.Postings:
    """Postings of the texts that searches look into (keywords, tags, persons) and of the days. Built once and stored by
    `grams.write_postings`; `only` restricts them to what some queries ask for."""
    texts = {"keyword": flt.haystack(*KEYWORD_TEXT), "tag": flt.haystack("tags_roget"), "person": normalize_list(F.col("personnes"))}
    return grams.build_postings(seg, "id", texts, F.col("timestamp"), only)


def conditions(log: DataFrame) -> DataFrame:
    """What a segment must hold for each query, but for the days: query_id, kind, no, value (one value per kind is enough)."""
    asked = log.select(F.struct("*").alias("q"))
    # persons take the place of keywords
    words = F.when(F.size("q.persons") == 0, _words("q.keywords")).otherwise(F.array().cast("array<string>"))
    parts = [asked.select("q.query_id", F.lit(kind).alias("kind"), F.posexplode(values).alias("no", "value"))
             for kind, values in (("keyword", words), ("tag", _words("q.tags")), ("person", _names()))]
    return reduce(DataFrame.unionByName, parts)


def _day_conditions(log: DataFrame, terms: DataFrame) -> DataFrame:
    first, last = terms.filter("kind = 'day'").agg(F.to_date(F.min("term")), F.to_date(F.max("term"))).first()
    ranged = log.filter("start IS NOT NULL OR end IS NOT NULL")
    if first is None:
        return ranged.select("query_id", F.lit("day").alias("kind"), F.lit(0).alias("no"), F.lit("none").alias("value"))
    days = grams.days_between(F.col("start"), F.col("end"), first, last)
    # a range without a day that occurs has no candidates, which is still a condition
    return ranged.select("query_id", F.lit("day").alias("kind"), F.posexplode(F.when(F.size(days) > 0, days).otherwise(F.array(F.lit("none")))).alias("no", "value"))


def accepts() -> Column:
    """Whether the segment (of `_with_texts`) meets all conditions of the query in `q` (of `_with_words`)."""
    one_of = lambda values, text: (F.size(values) == 0) | F.exists(values, lambda v: F.contains(F.col(text), v))
    return (
        (F.col("q.start").isNull() | (F.col("timestamp") >= F.col("q.start"))) & (F.col("q.end").isNull() | (F.col("timestamp") <= F.col("q.end")))
        & ((F.size("q.persons") > 0) | one_of("q._words", "_low")) & one_of("q._tags", "_held") & one_of("q._names", "_people")
    )


def hybrid_score(now: datetime) -> Column:
    """Weighted sum of five partial scores of the segment for the query in `q`, raised by up to 20 % through the resonance."""
    tags, wanted = F.col("tags_roget"), F.col("q.tags")
    has_tags = F.size(tags) > 0
    pairs = F.flatten(F.transform(tags, lambda s: F.transform(wanted, lambda t: scores.tag_proximity(t, s))))
    s_tags = F.when(F.size(wanted) > 0, F.when(has_tags, F.array_max(pairs)).otherwise(0.3)).otherwise(F.when(has_tags, 0.5).otherwise(0.3))
    v, a = (F.coalesce(c, F.lit(0.0)) for c in ("emotion_valence", "emotion_activation"))
    s_emotion = F.when(F.col("q.ev").isNull(), 0.5).otherwise(scores.emotion_similarity(F.col("q.ev"), F.col("q.ea"), v, a))
    s_time = scores.time_score(F.col("timestamp"), at(now))
    s_persons = scores.hits_score(F.size(F.filter("q._names", lambda p: F.contains(F.col("_people"), p))), 0.5, 0.25)
    s_summary = scores.hits_score(F.size(F.filter("q.keywords", lambda k: F.contains(F.col("_summary"), k))), 0.3, 0.15)
    base = (
        s_tags * F.col("q.w_tags") + s_emotion * F.col("q.w_emotion") + s_time * F.col("q.w_time")
        + s_persons * F.col("q.w_persons") + s_summary * F.col("q.w_summary")
    )
    return base * (1 + 0.2 * scores.resonance_score(F.col("vecteur"), F.col("q.mask")))


def score_pairs(seg: DataFrame, queries: Sequence[Query] | DataFrame, now: datetime, index: grams.Postings | None = None) -> DataFrame:
    """(query_id, score, top_k) for every segment a query accepts.

    The log is a table: each query looks up its rarest condition in the postings, the candidates found meet the segments
    once by id, and are tested and scored there. One scan of the segments serves a log of any length. Without an `index`
    (see `index_segments`) the postings of what the log asks for are made on the way, unless the log has at most `SCANNED`
    queries: making postings reads every text, so these are tested against each segment in one scan instead. Queries
    without a condition accept every segment, and get them all.
    """
    log = queries if isinstance(queries, DataFrame) else query_table(seg.sparkSession, queries)
    log = materialise(log.select(*[F.col(c) for c in T._parse_datatype_string(QUERY_ROW).names]))
    if log.isEmpty():
        raise ValueError("no query")
    texts, rows = _with_texts(seg), log.count()
    if index is None and rows <= SCANNED:
        found = _with_each(texts, log).filter((F.col("id").isNotNull() | _takes_all()) & accepts())
        return _with_score(found, seg, now)
    asked = conditions(log)
    postings = index or index_segments(seg, only=asked)
    asked = asked.unionByName(_day_conditions(log, postings.terms))
    own = _with_words(log).select("query_id", F.struct("*").alias("q"))
    pairs = grams.candidates(asked, postings)
    if rows <= LISTED:  # so the pairs move without their query
        pairs = pairs.join(texts, "id").join(F.broadcast(own), "query_id")
    else:
        pairs = pairs.join(own, "query_id").join(texts, "id")
    found = pairs.filter(accepts())
    free = log.join(grams.bound_queries(asked), "query_id", "left_anti")
    if not free.isEmpty():
        found = found.select(*texts.columns, "q").unionByName(_with_each(texts, free).filter(accepts()))
    return _with_score(found, seg, now)


def _with_each(texts: DataFrame, log: DataFrame) -> DataFrame:
    """Every segment with every query."""
    return texts.join(F.broadcast(_listed(_with_words(log))), F.lit(True)).select(*texts.columns, F.explode("_all").alias("q"))


def _listed(log: DataFrame) -> DataFrame:
    """One row with all queries as a list."""
    return log.agg(F.collect_list(F.struct(*log.columns)).alias("_all"))


def _takes_all() -> Column:
    """Whether the query in `q` has no condition that a segment could fail; only such ones find segments without an id."""
    binds = lambda values: (F.size(values) > 0) & ~F.exists(values, lambda v: v == "")
    words = (F.size("q.persons") == 0) & binds(F.col("q.keywords"))
    return F.col("q.start").isNull() & F.col("q.end").isNull() & ~words & ~binds(F.col("q.tags")) & ~binds(_names())


def _with_score(found: DataFrame, seg: DataFrame, now: datetime) -> DataFrame:
    return found.select(*seg.columns, F.col("q.query_id").alias("query_id"), hybrid_score(now).alias("score"), F.col("q.top_k").alias("top_k"))


def _searches(log: DataFrame, index: grams.Postings | None) -> tuple[DataFrame, DataFrame]:
    """Queries that ask the same as one search: the searches (rows of a log, numbered anew), and `query_id`, `top_k`, `_search`.

    Keywords that the index holds nowhere neither find a segment nor change a score, so they make no search of their own.
    """
    names = T._parse_datatype_string(QUERY_ROW).names
    rows = materialise(log.select(*names, F.monotonically_increasing_id().alias("_row")))
    if index is not None:
        words = rows.select("_row", F.posexplode("keywords").alias("no", "word")).withColumn("value", F.lower("word"))
        held = grams.occurring(words.select(F.lit("keyword").alias("kind"), "value").distinct(), index).select("value")
        kept = words.join(held, "value").groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("no", "word")))["word"].alias("_kept"))
        rows = rows.join(kept, "_row", "left").withColumn("keywords", F.coalesce("_kept", "keywords")).drop("_kept")
    asked = [n for n in names if n not in ("query_id", "text", "top_k")]
    exact = {"start": F.unix_micros("start"), "end": F.unix_micros("end"), "mask": F.sort_array(F.map_entries("mask"))}
    rows = materialise(rows.withColumn("_key", F.sha2(F.to_json(F.struct(*[exact.get(n, F.col(n)).alias(n) for n in asked])), 256)))
    each = rows.groupBy("_key").agg(F.min("_row").alias("_search"), F.min_by(F.struct(*asked), "_row").alias("_q"), F.max("top_k").alias("top_k"))
    each = materialise(each)
    searches = each.select(F.col("_search").alias("query_id"), F.lit("").alias("text"), "_q.*", "top_k")
    return searches, rows.select("_key", "query_id", "top_k").join(each.select("_key", "_search"), "_key").drop("_key")


def hybrid_search(
    seg: DataFrame, queries: Sequence[Query] | DataFrame, now: datetime, prefilter_limit: int | None = None, index: grams.Postings | None = None
) -> DataFrame:
    """Best segments per query. `prefilter_limit=100` scores only the newest hundred candidates of each query.

    Without it, queries of a log that ask the same are searched for once, and each is given the best.
    """
    log = queries if isinstance(queries, DataFrame) else query_table(seg.sparkSession, queries)
    largest = log.agg(F.max("top_k")).first()[0] if isinstance(queries, DataFrame) else max((q.top_k for q in queries), default=0)
    order, members = [F.desc("score"), F.asc("id")], None
    if not prefilter_limit and (index is not None or log.count() > SCANNED):
        log, members = _searches(log, index)
    pairs = score_pairs(seg, log, now, index)
    if prefilter_limit:
        pairs = windows.top_k(pairs, ["query_id"], [F.desc("timestamp"), F.asc("id")], prefilter_limit, "_newest").drop("_newest")
    if members is not None:
        best = windows.top_k(pairs, ["query_id"], order, largest).drop("top_k", "rank").withColumnRenamed("query_id", "_search")
        pairs = best.join(members, "_search").select(*seg.columns, "query_id", "score", "top_k")
    ranked = windows.top_k(pairs, ["query_id"], order, largest)
    return ranked.filter("rank <= top_k").drop("top_k")


def text_fallback(docs: DataFrame, queries: Sequence[Query] | DataFrame, answered: DataFrame, name: str = "file_name", cut: int | None = None) -> DataFrame:
    """For queries without a hit: first matching line (its first `cut` letters) of the files that hold the query text, score 0.1.

    Up to `SCANNED` texts are looked for in one scan of the files. The candidates of more come from the rarest trigram of
    each text; files and queries meet by these only.
    """
    log = queries if isinstance(queries, DataFrame) else query_table(docs.sparkSession, queries)
    wanted = materialise(log.filter("text <> ''").select("query_id", F.lower("text").alias("value"), "top_k"))
    if wanted.isEmpty():
        raise ValueError("no query has a text")
    wanted = wanted.join(answered.select("query_id").distinct(), "query_id", "left_anti")
    if wanted.count() <= SCANNED:
        texts = docs.filter(F.col(name).isNotNull()).select(F.col(name).alias("id"), "text")
        held = let(F.lower("text"), lambda low: F.filter("_all", lambda q: F.contains(low, q["value"])))
        hits = texts.join(F.broadcast(_listed(wanted.filter("query_id IS NOT NULL"))), F.lit(True)).select("id", "text", F.inline(held))
    else:
        asked = wanted.select("query_id", F.lit("text").alias("kind"), F.lit(0).alias("no"), "value")
        postings = grams.build_postings(docs, name, {"text": F.lower("text")}, only=asked)
        hits = grams.candidates(asked, postings).join(wanted, "query_id").join(docs.select(F.col(name).alias("id"), "text"), "id").filter(F.contains(F.lower("text"), F.col("value")))
    line = F.try_element_at(F.filter(F.split("text", "\n"), lambda l: F.contains(F.lower(l), F.col("value"))), F.lit(1))
    rows = hits.select("query_id", "top_k", F.col("id").alias(name), (F.substring(line, 1, cut) if cut else line).alias("resume_texte"))
    largest = wanted.agg(F.max("top_k")).first()[0] or 1
    ranked = windows.top_k(rows, ["query_id"], [F.asc(name)], largest)
    return ranked.filter("rank <= top_k").drop("top_k").withColumn("score", F.lit(0.1))


def answer_context(hits: DataFrame, max_tokens: int = 4000) -> DataFrame:
    """Formatted context per query within the token budget."""
    blocks = hits.withColumn("block", context_block(F.col("rank"), {c: F.col(c) for c in hits.columns}))
    return windows.format_context(windows.context_budget(blocks.select("query_id", "rank", "block"), max_tokens))


def search_by_emotion(seg: DataFrame, valence: float, activation: float, k: int = 10, prefilter_limit: int | None = None) -> DataFrame:
    """Closest emotions. `prefilter_limit=500` ranks the newest five hundred only; the default ranks all."""
    act = F.coalesce(F.nullif(F.col("emotion_activation"), F.lit(0.0)), F.lit(0.5))
    pool = seg.filter("emotion_valence IS NOT NULL")
    if prefilter_limit:
        pool = flt.newest(pool, prefilter_limit)
    score = scores.emotion_similarity(F.lit(valence), F.lit(activation), F.col("emotion_valence"), act)
    return pool.withColumn("score", score).orderBy(F.desc("score"), F.asc("id")).limit(k)


def ranked_union(hits: DataFrame, cap: int, id_: str = "id", rank: str = "term_rank") -> DataFrame:
    """Distinct hits, those of the first term first, newest first within a term."""
    best = hits.groupBy(id_).agg(F.min(rank).alias(rank), F.max("timestamp").alias("timestamp"))
    return best.orderBy(rank, F.desc("timestamp"), id_).limit(cap)


def _term_hits(seg: DataFrame, terms: Sequence[str], k: int) -> DataFrame:
    """Newest k hits per term with the term's rank, in one scan."""
    text = flt.haystack(*flt.KEYWORD_FIELDS)
    flags = [F.when(F.contains(text, F.lit(t.lower())), F.lit(i)) for i, t in enumerate(terms)]
    hits = seg.select("id", "timestamp", F.explode(F.filter(F.array(*flags), lambda x: x.isNotNull())).alias("term_rank"))
    return windows.top_k(hits, ["term_rank"], [F.desc("timestamp"), F.asc("id")], k, "_k").drop("_k")


def expanded_search(
    seg: DataFrame, query: str, similar: Callable[[str], Sequence[tuple[str, float]]], k: int = 50, most_terms: int | None = None,
    per_term: int | None = None,
) -> DataFrame:
    """Search the query and its similar terms (score above 0.5). The contract takes five terms and half of k per term."""
    terms = [query] + [t.replace("_", " ") for t, score in similar(query) if score > 0.5]
    return ranked_union(_term_hits(seg, terms[:most_terms], per_term or k), k)


def widening_search(
    seg: DataFrame, archive: DataFrame, query: str, similar: Callable[[str], Sequence[tuple[str, float]]], pattern: str,
    enough: int = 20, k: int = 50,
) -> DataFrame:
    """Keyword, then similar terms, then a regex over the archive, each only while there are not enough different hits.

    Rows: stage (the first that found it), ref (segment id or file:line).
    """
    def staged(df: DataFrame, stage: int, ref: Column) -> DataFrame:
        return df.select(F.lit(stage).alias("stage"), ref.cast("string").alias("ref"))

    steps = [
        lambda: staged(flt.search_keyword(seg, query, k), 1, F.col("id")),
        lambda: staged(expanded_search(seg, query, similar, k), 2, F.col("id")),
        lambda: staged(flt.grep_regex(archive, pattern, k), 3, F.concat_ws(":", "file_name", "line_no")),
    ]
    out = None
    for step in steps:
        hits = step()
        both = hits if out is None else out.unionByName(hits)
        out = materialise(both.groupBy("ref").agg(F.min("stage").alias("stage")))
        if out.count() >= enough:
            break
    return out


def like_search(
    files: DataFrame, query: str, domain: str | None = None, extension: str | None = None, limit: int = 10, min_importance: int = 1
) -> DataFrame:
    """Substring search over path, name, summary and keywords."""
    cols = [c for c in ("path_display", "name", "summary", "keywords") if c in files.columns]
    hit = flt.any_of([flt.like(F.col(c), query) for c in cols])
    out = document_filters(files.filter(hit), domain, extension, min_importance)
    order = [F.desc("importance")] + ([F.desc("server_modified")] if "server_modified" in files.columns else []) + [F.asc("id")]
    return out.orderBy(*order).limit(flt.checked_limit(limit))


def document_filters(files: DataFrame, domain: str | None, extension: str | None, min_importance: int) -> DataFrame:
    if domain:
        files = files.filter(F.col("domain") == domain.lower())
    if extension:
        ext = extension if extension.startswith(".") else f".{extension}"
        files = files.filter(F.col("extension") == ext.lower())
    if min_importance > 1:
        files = files.filter(F.col("importance") >= min_importance)
    return files

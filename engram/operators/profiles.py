"""Batch jobs over a query log: parsing texts and normalising profiles."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from engram.functions import lexicon as lx
from engram.functions.dates import at
from engram.functions.text import contains_any


def _first_rule(text: Column, rules, value) -> Column:
    out = F
    for words, result in rules:
        out = out.when(contains_any(text, words), value(result))
    return out.otherwise(F.lit(None))


def featurise_queries(queries: DataFrame, now: datetime, known_names: Sequence[str] = lx.KNOWN_NAMES) -> DataFrame:
    """Persons, keywords, tags, dates, content type, domain and target emotion of each query text."""
    text, low = F.col("text"), F.lower("text")
    known, stop = list(known_names), lx.QUERY_STOPWORDS
    # \b on both sides with accented letters as word characters
    raw = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])[A-Z][a-zÀ-ÿ]+(?![\p{L}\p{N}_])"), F.lit(0))
    persons = F.filter("_raw", lambda p: ~F.lower(p).isin(*lx.PERSON_STOPWORDS, *known))
    words = F.regexp_extract_all(low, F.lit(r"(?<![\p{L}\p{N}_])[a-zA-ZÀ-ÿ]{3,}(?![\p{L}\p{N}_])"), F.lit(0))
    person_words = F.transform("personnes", lambda p: F.lower(p))
    plain = F.filter(words, lambda w: ~w.isin(*stop) & ~F.array_contains(person_words, w))
    named = F.filter(F.transform("_raw", lambda p: F.lower(p)), lambda p: p.isin(*known))
    extra = F.array_except(named, F.col("_plain"))
    days = _first_rule(low, lx.RELATIVE_DAYS, lambda d: F.lit(d))
    moment = at(now)
    return (
        queries.withColumn("_raw", raw)
        .withColumn("personnes", persons)
        .withColumn("_plain", plain)
        .withColumns(
            {
                "mots_cles": F.concat("_plain", extra),
                "tags_explicites": F.regexp_extract_all(text, F.lit(r"\b\d{2}-\d{4}-\d{4}\b"), F.lit(0)),
                "date_debut": F.when(days.isNotNull(), moment - F.make_dt_interval(days)),
                "date_fin": F.when(days.isNotNull(), moment),
                "type_contenu": _first_rule(low, lx.CONTENT_TYPES, F.lit),
                "domaine": _first_rule(low, lx.DOMAINS, F.lit),
                "emotion_cible": _first_rule(
                    low, lx.TARGET_EMOTIONS, lambda e: F.struct(F.lit(e[0]).alias("valence"), F.lit(e[1]).alias("activation"))
                ),
            }
        )
        .drop("_raw", "_plain")
    )


def normalise_profiles(profiles: DataFrame) -> DataFrame:
    """Fill missing weights and scale them to a sum of 1, clamp top_k to 3..10 and confidence to 0..1."""
    defaults = F.create_map(*[x for k, v in lx.PROFILE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    given = F.coalesce("weights", F.create_map().cast("map<string,double>"))
    full = F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key("_given", k)), F.col("_given"))
    total = F.aggregate(F.map_values("weights"), F.lit(0.0), lambda acc, x: acc + x)
    off = (F.col("_total") > 0) & (F.abs(F.col("_total") - 1.0) > 0.01)
    return (
        profiles.withColumn("_given", given)
        .withColumn("weights", full)
        .withColumn("_total", total)
        .withColumns(
            {
                "weights": F.when(off, F.transform_values("weights", lambda _, v: v / F.col("_total"))).otherwise(F.col("weights")),
                "top_k": F.least(F.lit(10), F.greatest(F.lit(3), F.coalesce("top_k", F.lit(5)))),
                "intent": F.coalesce("intent", F.lit("mixte")),
                "confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.5)))),
            }
        )
        .drop("_given", "_total")
    )


def split_filters(profiles: DataFrame) -> DataFrame:
    """Filters that stay outside the vector: the explicit ones, and `<field>_weight` of positive weights."""
    outside = F.array(*[F.lit(f) for f in lx.OUTSIDE_VECTOR])
    weights = F.map_filter("weights", lambda k, v: F.array_contains(outside, k) & (v > 0))
    named = F.transform_values(F.transform_keys(weights, lambda k, _: F.concat(k, F.lit("_weight"))), lambda _, v: v.cast("string"))
    explicit = F.map_filter(F.coalesce("filters", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(named, k))
    return profiles.withColumn("sql_filters", F.map_concat(explicit, named))

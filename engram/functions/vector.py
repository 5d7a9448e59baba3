"""Sparse segment vectors: map position -> value."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from engram.functions import let, lexicon as lx
from engram.functions.text import contains_any

VECTOR = T.MapType(T.IntegerType(), T.DoubleType())


def bag_of_words(df: DataFrame) -> Column:
    """Lower-case text of the seven descriptive fields, missing and empty ones left out."""
    fields = ["tags_roget", "resume_texte", "resume_mots_cles", "personnes", "lieux", "projets", "organisations"]
    parts = []
    for field in fields:
        if field not in df.columns:
            continue
        col = F.col(field)
        if isinstance(df.schema[field].dataType, T.ArrayType):
            col = F.when(F.size(col) > 0, F.array_join(col, " "))
        parts.append(F.when(col != "", col))
    return F.lower(F.concat_ws(" ", *parts))


def _entry(pos: int, value: Column, present: Column) -> Column:
    return F.when(present, F.struct(F.lit(pos).alias("key"), value.cast("double").alias("value")))


def _dictionary(pairs: Iterable[tuple[int, str]]) -> Column:
    """Constant array of (position, keyword); as one JSON literal, since a call per keyword is slow to build."""
    rows = [{"pos": p, "word": w} for p, w in dict.fromkeys(pairs)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<pos:int,word:string>>")


def _count_of(positions: Column, pos: int) -> Column:
    # a lambda with a default argument would be read as one that takes the element's index
    return F.size(F.filter(positions, lambda p: p == pos))


def _hits(text: Column, dictionary: Column) -> Column:
    """Positions whose keywords occur as substrings, one entry per keyword."""
    return F.transform(F.filter(dictionary, lambda e: F.contains(text, e["word"])), lambda e: e["pos"])


def vectorise(
    df: DataFrame,
    class_keywords: Sequence[tuple[int, str]] = (),
    theme_keywords: Sequence[tuple[int, str]] = (),
    out: str = "vecteur",
) -> DataFrame:
    """Add the sparse vector. `class_keywords`/`theme_keywords` are (position, keyword) pairs of the thesaurus.

    The dictionaries are constants of the plan and each text is folded over them once; no join, no shuffle.
    """
    direct = []
    for pos, name in {**lx.STATE_POSITIONS, **lx.COMMUNICATION_POSITIONS}.items():
        if name in df.columns:
            col = F.col(name)
            direct.append(_entry(pos, F.round(col, 3), col.isNotNull() & (col != 0)))

    places = F.coalesce(F.lower(F.array_join("lieux", " ")), F.lit("")) if "lieux" in df.columns else F.lit("")
    place_dim = _dictionary((p, w) for p, words in lx.PLACE_KEYWORDS.items() for w in words)
    theme_dim = _dictionary(
        [(p, w) for p, words in lx.THEME_KEYWORDS.items() for w in words] + [(p, w.lower()) for p, w in theme_keywords]
    )
    tag_classes = F.array().cast("array<string>")
    if "tags_roget" in df.columns:
        tag_classes = F.coalesce(F.transform("tags_roget", lambda t: F.substring(F.trim(t), 1, 2)), tag_classes)

    def of_bag(bag: Column) -> Column:
        """Class and theme entries; `bag` is bound once per row by the enclosing transform."""
        ones = F.transform(
            F.array_distinct(_hits(bag, theme_dim)), lambda p: F.struct(p.alias("key"), F.lit(1.0).alias("value"))
        )
        class_hits = _hits(bag, _dictionary((p, w.lower()) for p, w in class_keywords)) if class_keywords else None
        limit = F.when(F.size(F.split(F.trim(bag), r"\s+")) < 20, 1).otherwise(3)

        def of_classes(held: Column, hits: Column | None = None, limit: Column | None = None) -> Column:
            classes = []
            for cls, pos in lx.CLASS_POSITIONS.items():
                by_words = F.lit(0.0) if hits is None else F.least(F.lit(1.0), F.round(_count_of(hits, pos) / limit, 2))
                value = F.when(F.array_contains(held, cls), F.greatest(by_words, F.lit(0.8))).otherwise(by_words)
                classes.append(_entry(pos, value, value > 0))
            return F.filter(F.array(*classes), lambda e: e.isNotNull())

        if class_hits is None:
            return F.concat(let(tag_classes, lambda held: of_classes(held)), ones)
        # tags, hits and limit are bound as well: six classes read them
        return F.concat(let(tag_classes, lambda held: let(class_hits, lambda hits: let(limit, lambda n: of_classes(held, hits, n)))), ones)

    from_bag = F.transform(F.array(bag_of_words(df)), of_bag)[0]
    # the text of the places is bound, or it would be made for every keyword
    from_places = F.transform(
        F.array_distinct(let(places, lambda text: _hits(text, place_dim))), lambda p: F.struct(p.alias("key"), F.lit(1.0).alias("value"))
    )
    parts = [F.filter(F.array(*direct), lambda e: e.isNotNull())] if direct else []
    return df.withColumn(out, F.map_from_entries(F.concat(*parts, from_places, from_bag)).cast(VECTOR))


def keyword_dim(index: DataFrame) -> DataFrame:
    """(position, keyword) rows from a thesaurus table (class, section, tag, tag_name, keyword): classes and themes."""
    words = index.select("class", F.lower("tag_name").alias("tag_name"), F.lower("keyword").alias("keyword"))
    position = F.element_at(
        F.create_map(*[F.lit(x) for pair in lx.CLASS_POSITIONS.items() for x in pair]), F.col("class")
    )
    position = F.when(F.col("class").isin(*lx.CLASS_POSITIONS), position)
    classes = words.select(position.alias("position"), "keyword").filter("position IS NOT NULL")
    hits = [
        F.when(contains_any(F.col("keyword"), triggers) | contains_any(F.col("tag_name"), triggers), F.lit(pos))
        for pos, triggers in lx.THEME_TRIGGERS.items()
    ]
    themes = (
        words.filter(F.col("class").isin(*lx.CLASS_POSITIONS) & F.col("tag_name").isNotNull())
        .select(F.explode(F.filter(F.array(*hits), lambda p: p.isNotNull())).alias("position"), "keyword")
    )
    return classes.unionByName(themes).distinct()


def backfill_vectors(df: DataFrame, **dims) -> DataFrame:
    """Give a vector to the rows that have none; the others keep theirs."""
    filled = vectorise(df, out="_new", **dims)
    missing = F.col("vecteur").isNull() | (F.size("vecteur") == 0)
    return filled.withColumn("vecteur", F.when(missing, F.col("_new")).otherwise(F.col("vecteur"))).drop("_new")


def describe_vector(vector: Column) -> Column:
    """Readable text of a vector."""
    at = lambda pos: F.try_element_at(vector, F.lit(pos))
    shown = lambda pos: at(pos).cast("string")
    mood = F.when(at(1) > 0.3, "positif").when(at(1) < -0.3, "négatif").otherwise("neutre")

    def listed(label: str, names: dict[int, str], with_value: bool = False) -> Column:
        items = F.filter(
            F.array(*[
                F.when(at(p).isNotNull(), F.concat(F.lit(n + "("), shown(p), F.lit(")")) if with_value else F.lit(n))
                for p, n in names.items()
            ]),
            lambda x: x.isNotNull(),
        )
        return F.when(F.size(items) > 0, F.concat(F.lit(label + ":"), F.array_join(items, ",")))

    text = F.concat_ws(
        " | ",
        F.when(at(1).isNotNull(), F.concat(F.lit("Humeur:"), mood, F.lit("("), shown(1), F.lit(")"))),
        F.when(at(4).isNotNull(), F.concat(F.lit("Stress:"), shown(4))),
        listed("Lieu", lx.PLACE_NAMES),
        listed("Roget", lx.CLASS_NAMES, with_value=True),
        listed("Thèmes", lx.THEME_NAMES),
    )
    return F.when(text == "", "(vecteur vide)").otherwise(text)


def vector_json(vector: Column) -> Column:
    return F.to_json(vector)


def json_vector(text: Column) -> Column:
    """Map from stored JSON; bad or missing JSON gives an empty map."""
    # JSON keys are text
    parsed = F.transform_keys(F.from_json(text, "map<string,double>"), lambda k, _: k.try_cast("int"))
    return F.coalesce(F.map_filter(parsed, lambda k, v: v.isNotNull()), F.create_map().cast(VECTOR))


def vector_stats(df: DataFrame) -> DataFrame:
    """Rows and mean value per active position."""
    # an inner explode would evaluate a computed vector again for its non-empty test
    rows = df.select(F.explode_outer("vecteur").alias("position", "value")).filter("position IS NOT NULL")
    return rows.groupBy("position").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")
    )

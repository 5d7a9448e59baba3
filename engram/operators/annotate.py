"""Annotation hook: a caller's function over batches of rows, retries and new columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from engram.functions import lexicon as lx

ANNOTATION = T.StructType([
    T.StructField("indexable", T.BooleanType()), T.StructField("gr_id", T.LongType()),
    T.StructField("tags_roget", T.ArrayType(T.StringType())), T.StructField("personnes", T.ArrayType(T.StringType())),
    T.StructField("projets", T.ArrayType(T.StringType())), T.StructField("sujets", T.ArrayType(T.StringType())),
    T.StructField("lieux", T.ArrayType(T.StringType())), T.StructField("emotion_valence", T.DoubleType()),
    T.StructField("emotion_activation", T.DoubleType()), T.StructField("confidence_score", T.DoubleType()),
    T.StructField("resume_texte", T.StringType()),
])


def default_annotation() -> dict:
    """What a failed call leaves behind."""
    return {
        "indexable": True, "gr_id": None, "tags_roget": [], "personnes": [], "projets": [], "sujets": [], "lieux": [],
        "emotion_valence": 0.0, "emotion_activation": 0.5, "confidence_score": 0.5, "resume_texte": "",
    }


def annotate(df: DataFrame, fn: Callable[[pd.Series], pd.DataFrame], text: str = "text", key: str = "id") -> DataFrame:
    """Annotation columns per key. `fn` takes a batch of texts and gives one row per text.

    Batches follow `spark.sql.execution.arrow.maxRecordsPerBatch`; a batch that fails keeps its rows with defaults
    and `ok = false`, for `windows.fallback_fill` or a retry.
    """
    key_field = df.schema[key]
    schema = T.StructType([key_field, *ANNOTATION.fields, T.StructField("ok", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                out = fn(batch[text]).reset_index(drop=True)
                if len(out) != len(batch):
                    raise ValueError("one annotation per text is needed")
                ok = True
            except Exception:  # noqa: BLE001 - the hook is foreign code; failed rows stay visible through `ok`
                out, ok = pd.DataFrame([default_annotation() for _ in range(len(batch))]), False
            for name, value in default_annotation().items():
                if name not in out.columns:
                    out[name] = [value] * len(out)
            out[key], out["ok"] = batch[key].to_numpy(), ok
            yield out[schema.names]

    return df.select(key, text).mapInPandas(run, schema)


def rule_annotation(df: DataFrame, text: str = "text", cut: int | None = None) -> DataFrame:
    """Built-in annotation without any model: capitalised names, the first sentence (its first `cut` letters), emotion words."""
    body = F.col(text)
    low = F.lower(body)
    mood = F
    for words, (v, a) in lx.TARGET_EMOTIONS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        mood = mood.when(hit, F.struct(F.lit(v).alias("v"), F.lit(a).alias("a")))
    mood = mood.otherwise(F.struct(F.lit(0.0).alias("v"), F.lit(0.5).alias("a")))
    names = F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?<![\p{L}\p{N}.!?]\s?)(?<!^)\b([A-Z][a-zÀ-ÿ]{2,})\b"), F.lit(1)))
    empty = F.array().cast("array<string>")
    sentence = F.split_part(body, F.lit("."), F.lit(1))
    return df.withColumn("_m", mood).withColumns(
        {
            "indexable": F.length(F.trim(body)) >= 3,
            "gr_id": F.lit(None).cast("long"),
            "tags_roget": F.regexp_extract_all(body, F.lit(r"\b\d{2}-\d{4}-\d{4}\b"), F.lit(0)),
            "personnes": names,
            "projets": empty,
            "sujets": empty,
            "lieux": empty,
            "emotion_valence": F.col("_m.v"),
            "emotion_activation": F.col("_m.a"),
            "confidence_score": F.lit(0.7),
            "resume_texte": F.substring(sentence, 1, cut) if cut else sentence,
        }
    ).drop("_m")


FIELD_TYPES = {"TEXT": "string", "INTEGER": "long", "REAL": "double", "BLOB": "binary"}


def backfill_column(
    df: DataFrame, name: str, kind: str, default, fn: Callable[[pd.Series], pd.Series], text: str = "text", limit: int | None = None,
    source_file: str | None = None,
) -> DataFrame:
    """Fill a user-defined column where it is null; rows outside the source filter or past the limit stay as they are."""
    sql_type = FIELD_TYPES[kind.upper()]
    if name not in df.columns:
        df = df.withColumn(name, F.lit(None).cast(sql_type))
    wanted = F.col(name).isNull()
    if source_file:
        wanted = wanted & F.contains("source_file", F.lit(source_file))

    @F.pandas_udf(sql_type)
    def fill(texts: pd.Series) -> pd.Series:
        return fn(texts)

    value = F.coalesce(fill(F.col(text)), F.lit(default).cast(sql_type))
    todo = df.filter(wanted)
    if limit is not None:
        chosen = todo.orderBy("id").limit(limit).select("id")
        todo = todo.join(chosen, "id", "left_semi")
        rest = df.join(chosen, "id", "left_anti")
    else:
        rest = df.filter(~wanted)
    return todo.withColumn(name, value).unionByName(rest)


def retry_failed(seg: DataFrame, texts: DataFrame, fn: Callable[[pd.Series], pd.DataFrame], key: str = "id") -> DataFrame:
    """Annotate the segments with the fallback confidence again; successful answers replace the stored fields."""
    failed = seg.filter(F.col("confidence_score") == 0.5).select(key).join(texts, key)
    fields = [f for f in ANNOTATION.names if f in seg.columns]
    fresh = annotate(failed, fn, key=key).filter("ok").select(key, F.struct(*fields).alias("_new"))
    out = seg.join(fresh, key, "left")
    return out.withColumns({f: F.when(F.col("_new").isNotNull(), F.col("_new")[f]).otherwise(F.col(f)) for f in fields}).drop("_new").select(*seg.columns)


def register_functions(spark) -> None:
    """SQL functions for users: full Unicode folding, exchanges and matches as table functions."""
    from engram.functions.text import fold_unicode

    spark.udf.register("normalize_search", fold_unicode)
    spark.udtf.register("split_exchanges", SplitExchanges)
    spark.udtf.register("find_matches", FindMatches)


@F.udtf(returnType="no INT, ts STRING, auteur STRING, text STRING")
class SplitExchanges:
    """`SELECT * FROM split_exchanges(text)`: one row per exchange."""

    def eval(self, text: str):
        import re

        if not text:
            return
        head = re.compile(
            r"(?:\[SOURCE:\w+\])?\[(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?)\]\s*(human|assistant|user|utilisateur)\s*:\s*", re.I
        )
        marks = list(head.finditer(text))
        if not marks:
            yield 0, None, "human", text.strip()
        for no, (mark, nxt) in enumerate(zip(marks, [*marks[1:], None])):
            body = text[mark.end(): nxt.start() if nxt else len(text)].strip()
            if body:
                yield no, mark.group(1), "assistant" if mark.group(2).lower() == "assistant" else "human", body


@F.udtf(returnType="match_no INT, position INT, matched STRING")
class FindMatches:
    """`SELECT * FROM find_matches(text, 'wild*card')`."""

    def eval(self, text: str, query: str):
        import re

        if not text or not query:
            return
        for no, m in enumerate(re.finditer(".*".join(re.escape(p) for p in query.split("*")), text, re.I)):
            yield no, m.start(), m.group(0)

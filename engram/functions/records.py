"""Records out of model answers: JSON cutting and repair, coercion, annotation normalising."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from engram.functions import let
from engram.functions.scores import fix_tag

NOT_INDEXABLE_BELOW = 3  # characters


def extract_json(text: Column) -> Column:
    """From the first `{` to the last `}`, null when there is none."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def unfence(text: Column) -> Column:
    """Body of a fenced answer."""
    return F.trim(F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?(.*?)(?:```.*)?$", "$1"))


_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|//[^\n]*|/\*.*?(?:\*/|\Z)|[{}\[\]:,]|["\'][^\n]*|[^\s{}\[\]:,"\']+', re.S)
_WORDS = {"true": "true", "false": "false", "none": "null", "null": "null"}
_CLOSER = {"{": "}", "[": "]"}


def _mended(text: str) -> str:
    """Read the tokens of a JSON-like text and write them again as JSON.

    Comments go, strings and bare words get double quotes, missing commas are put in and stray ones left out, and what is
    still open at the end is closed. An object of a list that was cut off in a string is left out.
    """
    out: list[str] = []
    open_: list[tuple[str, int]] = []  # bracket, and how much was written before it
    value = False  # whether what was written last ends a value
    for token in _TOKEN.findall(text):
        if token.startswith(("//", "/*")):
            continue
        if token == ",":
            value = False
        elif token in ("}", "]"):
            if not open_ or _CLOSER[open_[-1][0]] != token:
                return text
            open_.pop()
            out.append(token)
            value = True
        elif token == ":":
            out.append(token)
            value = False
        else:
            before = len(out)
            if value or (out and out[-1] not in ("{", "[", ":")):
                out.append(",")
            if token in _CLOSER:
                open_.append((token, before))
                out.append(token)
                value = False
                continue
            if token[0] in "\"'" and (len(token) < 2 or token[-1] != token[0]):  # cut off in a string
                if len(open_) > 1 and open_[-2][0] == "[":
                    del out[open_.pop()[1] :]
                    break
                return text
            if token[0] in "\"'":
                token = json.dumps(json.loads(token, strict=False)) if token[0] == '"' else json.dumps(token[1:-1].replace("\\'", "'"))
            elif token.lower() in _WORDS:
                token = _WORDS[token.lower()]
            elif not _NUMBER.fullmatch(token):
                token = json.dumps(token)
            out.append(token)
            value = True
    return "".join(out) + "".join(_CLOSER[b] for b, _ in reversed(open_))


_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")


@F.pandas_udf(T.StringType())
def _mend(texts: pd.Series) -> pd.Series:
    def one(text: str) -> str:
        try:
            return _mended(text)
        except ValueError:
            return text

    return texts.map(one, na_action="ignore")


def repair_json(text: Column) -> Column:
    """Text that parses is kept; text with a bracket is read token by token and written as JSON."""
    broken = F.try_parse_json(text).isNull() & F.rlike(text, F.lit(r"[{\[]"))
    return F.when(broken, _mend(F.when(broken, text))).otherwise(text)


def parse_or_quarantine(df: DataFrame, col: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose (repaired) JSON parses, as struct `record`, and the rows that stay broken."""
    judged = let(
        repair_json(F.col(col)),
        lambda t: F.struct(F.try_parse_json(t).isNotNull().alias("ok"), F.from_json(t, schema).alias("record")),
    )
    # both sides read the same judgement; the generator keeps it from being inlined into each filter
    tried = df.select("*", F.inline(F.array(judged)))
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return tried.filter(ok).drop("ok"), tried.filter(~ok).drop("ok", "record")


ANSWER_SCHEMAS = {
    "corrections": "corrections ARRAY<STRUCT<ancien_fait STRING, nouveau_fait STRING, confidence DOUBLE, contexte STRING>>",
    "trajectoires": "trajectoires ARRAY<STRUCT<ancien_concept STRING, nouveau_concept STRING, type STRING, "
    "description STRING, confidence DOUBLE>>",
    "piliers": "piliers ARRAY<STRUCT<fait STRING, categorie STRING, importance INT, raison STRING>>",
}


def parse_answers(df: DataFrame, col: str, kind: str) -> DataFrame:
    """Rows of one kind of model answer: corrections need a new fact, trajectories both concepts, pillars a fact."""
    items = df.select(
        *[c for c in df.columns if c != col],
        F.explode(F.from_json(unfence(F.col(col)), ANSWER_SCHEMAS[kind])[kind]).alias("item"),
    ).select(*[c for c in df.columns if c != col], "item.*")
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    text = lambda c, d="": F.coalesce(F.col(c), F.lit(d)).alias(c)
    keep = [c for c in df.columns if c != col]
    half = F.coalesce("confidence", F.lit(0.5)).alias("confidence")
    if kind == "corrections":
        return items.filter(full("nouveau_fait")).select(*keep, text("ancien_fait"), "nouveau_fait", half, text("contexte"))
    if kind == "trajectoires":
        return items.filter(full("ancien_concept") & full("nouveau_concept")).select(
            *keep, "ancien_concept", "nouveau_concept", text("type", "TRAJECTOIRE"), text("description"), half
        )
    level = F.least(F.lit(3), F.greatest(F.lit(1), F.coalesce("importance", F.lit(2)))).alias("importance")
    return items.filter(full("fait")).select(*keep, "fait", text("categorie", "FAIT"), level, text("raison"))


def clamp(col: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), col))


def normalise_annotation(df: DataFrame, most: int | None = None, letters: int | None = None, places: bool = True) -> DataFrame:
    """Bring raw annotation columns into the contract: usable types, repaired tags, numbers in range, no nulls.

    `most` keeps the first tags and subjects, `letters` the start of the summary; without `places` these are emptied. The
    contract's values are 5, 800 and False; by default nothing is cut.

    Expected raw columns: indexable, gr_id, confidence_score, emotion_valence, emotion_activation (any scalar
    type), tags_roget, sujets, lieux, personnes, projets (arrays), resume_texte.
    """
    first = lambda c: F.slice(c, 1, most) if most else F.col(c)
    tags = F.filter(F.transform(first("tags_roget"), fix_tag), lambda t: t.isNotNull())
    number = lambda c, d: F.coalesce(F.col(c).try_cast("double"), F.lit(d))
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    summary = F.coalesce("resume_texte", F.lit(""))
    return df.filter(F.coalesce(F.col("indexable"), F.lit(True))).withColumns(
        {
            "indexable": F.lit(True),
            "tags_roget": F.coalesce(tags, F.array().cast("array<string>")),
            "sujets": F.coalesce(first("sujets"), F.array().cast("array<string>")),
            "lieux": listed("lieux") if places else F.array().cast("array<string>"),
            "personnes": listed("personnes"),
            "projets": listed("projets"),
            "gr_id": F.col("gr_id").try_cast("double").cast("long"),
            "confidence_score": clamp(number("confidence_score", 0.5), 0.0, 1.0),
            "emotion_valence": number("emotion_valence", 0.0),
            "emotion_activation": number("emotion_activation", 0.5),
            "resume_texte": F.when(F.length(summary) > letters, F.concat(F.substring(summary, 1, letters), F.lit("..."))).otherwise(summary) if letters else summary,
        }
    )


def coerce_record(df: DataFrame) -> DataFrame:
    """File enrichment answers: first of a list, text of anything else, importance 3 when it is no number."""
    first = lambda c: F.coalesce(
        F.when(F.col(c).startswith("["), F.from_json(F.col(c), "array<string>")[0]).otherwise(F.col(c)), F.lit("")
    )
    return df.withColumns(
        {
            "domain": first("domain"),
            "summary": F.coalesce(F.col("summary"), F.lit("")),
            "importance": F.coalesce(F.col("importance").try_cast("int"), F.lit(3)),
        }
    )

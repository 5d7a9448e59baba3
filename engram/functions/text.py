"""Text columns: folding, cleaning, marker handling, code fences and content classes."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from html import unescape

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from engram.functions import let, lexicon as lx

TS = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?"


def fold(col: Column) -> Column:
    """Lower case without accents, native: covers the letters of `lexicon.ACCENTED`."""
    return F.lower(F.translate(col, lx.ACCENTED, lx.UNACCENTED))


def normalize_search(col: Column) -> Column:
    """Folded text; arrays are joined with a space first. Null becomes empty text."""
    return fold(F.coalesce(col, F.lit("")))


def normalize_list(col: Column) -> Column:
    return normalize_search(F.array_join(col, " "))


@F.pandas_udf(T.StringType())
def fold_unicode(texts: pd.Series) -> pd.Series:
    """Full Unicode folding for letters outside the accent table."""

    def one(text):
        if text is None:
            return ""
        parts = unicodedata.normalize("NFD", text)
        return "".join(c for c in parts if unicodedata.category(c) != "Mn").lower()

    return texts.map(one)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True when any of the words is a substring."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def squeeze_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


_UNSUPPORTED = r"(?i)```\s*\n?\s*This block is not supported on your current device yet\.\s*\n?\s*```"


def clean_tree_artefacts(text: Column) -> Column:
    """Message-tree exports: image/search references and escaped call blocks go."""
    text = F.regexp_replace(text, r"i?turn\d+(image|search)\d+", "")
    text = F.regexp_replace(text, r"\[Code\]\s*\n[^\n]*\\u[0-9a-fA-F]{4}[^\n]*\n?", "")
    return strip(squeeze_newlines(text))


def clean_flat_artefacts(text: Column) -> Column:
    """Flat exports: the notice that stands for a block that was not exported goes."""
    return strip(squeeze_newlines(F.regexp_replace(text, _UNSUPPORTED, "")))


def clean_fused_artefacts(text: Column) -> Column:
    """Fused daily files: both kinds of artefacts, citations and escaped search calls."""
    text = F.regexp_replace(text, r"i?turn\d+(image|search)\d+", "")
    text = F.regexp_replace(text, r"cite(turn\d+search\d+)?", "cite")
    text = F.regexp_replace(text, r"search\s*\([\"'][^\"']*\\u[0-9a-fA-F]{4}[^\"']*[\"']\)\s*\n?", "")
    return squeeze_newlines(F.regexp_replace(text, _UNSUPPORTED, ""))


def neutralise_markers(text: Column) -> Column:
    """Source tags and time stamps inside a line get «» so that they never split an exchange."""
    text = F.regexp_replace(text, r"(?<=[^\n])\[SOURCE:(\w+)\]", "«SOURCE:$1»")
    return F.regexp_replace(text, rf"(?<=[^\]\n])\[({TS})\]", "«$1»")


def strip_system_context(text: Column) -> Column:
    """Drop everything up to the rule after the system block, or up to the block's end without a rule."""
    end = "[/SYSTEM_CONTEXT]"
    at = F.locate(end, text)
    tail = F.substring(text, at, F.length(text))
    rule = F.locate("---", tail)
    left = lambda c: F.regexp_replace(c, r"^\s+", "")
    return (
        F.when(~F.contains(text, F.lit("[SYSTEM_CONTEXT:")) | (at == 0), text)
        .when(rule == 0, left(F.substring(tail, F.lit(len(end) + 1), F.length(text))))
        .otherwise(left(F.substring(tail, rule + 3, F.length(text))))
    )


def token_count(text: Column, counter: Callable[[pd.Series], pd.Series] | None = None) -> Column:
    """Tokens as length/4, or by a caller's vectorised counter (for example a BPE encoder)."""
    if counter is None:
        return F.floor(F.length(text) / 4).cast("long")
    return F.pandas_udf(counter, "long")(text)


def code_language(code: Column) -> Column:
    """Language of a code block by ordered keyword rules."""
    trimmed = strip(code)
    forms = {"exact": code, "lower": F.lower(code), "upper": F.upper(code)}
    rule = F
    for name, form, words in lx.CODE_HINTS:
        hit = contains_any(forms[form], words)
        if name == "bash":
            hit = hit | trimmed.startswith("#!")
        rule = rule.when(hit, name)
    is_json = trimmed.startswith("{") & trimmed.endswith("}") & F.try_parse_json(code).isNotNull()
    return rule.when(is_json, "json").otherwise("code")


def content_class(text: Column) -> Column:
    """court / json / code / mixte / texte, from counts of the signs in `lexicon.CONTENT_SIGNS`."""
    forms = {"text": text, "lower": F.lower(text), "trimmed": strip(text)}

    def present(sign) -> Column:
        form, first, *rest = sign
        if form == "trimmed":  # first and last characters
            return forms[form].startswith(first) & forms[form].endswith(rest[0])
        found = F.contains(forms[form], F.lit(first))
        for more in rest:
            found = found & F.contains(forms[form], F.lit(more))
        return found

    many = {side: sum((present(sign).cast("int") for sign in signs), F.lit(0)) > 2 for side, signs in lx.CONTENT_SIGNS.items()}
    opened = F.substring(forms["trimmed"], 1, 1).isin("{", "[")
    kind = F.when(many["talk"], "mixte").when(opened, "json").otherwise("code")
    return F.when(F.length(forms["trimmed"]) < 20, "court").otherwise(F.when(many["code"], kind).otherwise("texte"))


def _code_block(body: Column, hint: Column) -> Column:
    """A body between language markers; nothing when it is empty."""

    def marked(code: Column) -> Column:
        language = F.when(hint.isin("", "code"), code_language(code)).otherwise(hint)
        return F.when(code == "", "").otherwise(
            let(language, lambda name: F.concat(F.lit("[CODE:"), name, F.lit(":START]\n"), code, F.lit("\n[CODE:"), name, F.lit(":END]")))
        )

    return let(strip(body), marked)


def _bracketed(part: Column) -> Column:
    """A part that may start with `[Code]`: its block reaches to a new bracket line, or to a paragraph that isn't indented."""
    opening = r"^\[Code\]\s*\n"

    def block(body: Column) -> Column:
        stop = F.regexp_instr(body, F.lit(r"\n\n[^\s\[]|\n\["))
        inside = F.when(stop > 0, F.substring(body, F.lit(1), stop - 1)).otherwise(body)
        return F.concat(_code_block(inside, F.lit("")), F.when(stop > 0, F.substring(body, stop, F.length(body))).otherwise(""))

    return F.when(F.rlike(part, F.lit(opening)), let(F.regexp_replace(part, opening, ""), block)).otherwise(part)


def fence_code(text: Column) -> Column:
    """Turn `[Code]` blocks and markdown fences into `[CODE:lang:START]…[CODE:lang:END]`; empty blocks go.

    The text is cut at the block starts, each part is labelled, and the parts are joined again; a fence without an end,
    or with more than a word behind its start, stays as it is.
    """
    fence, opening = "```", r"^(\w*)\n"
    joined = F.array_join(F.transform(F.split(text, r"(?=\[Code\]\s*\n)"), _bracketed), "")

    def fenced(parts: Column) -> Column:
        def piece(part: Column, i: Column) -> Column:
            inside = (i % 2 == 1) & (i < F.size(parts) - 1)
            block = _code_block(F.regexp_replace(part, opening, ""), F.lower(F.regexp_extract(part, opening, 1)))
            raw = F.concat(F.lit(fence), part, F.when(inside, fence).otherwise(""))
            return F.when(i % 2 == 0, part).when(inside & F.rlike(part, F.lit(opening)), block).otherwise(raw)

        return F.array_join(F.transform(parts, piece), "")

    return squeeze_newlines(let(F.split(joined, fence), fenced))


def file_ext(name: Column) -> Column:
    """Lower-case extension with its dot, empty without one."""
    return F.lower(F.regexp_extract(name, r"[^/.](\.[^./]+)$", 1))


def file_date(name: Column) -> Column:
    """`YYYY-MM-DD` at the start of a file name, null without one."""
    found = F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.when(found != "", found)


# file kinds with a fixed media type (fixed values)
MEDIA_TYPES = {".txt": "text/plain", ".md": "text/markdown", ".pdf": "application/pdf", ".html": "text/html",
               ".json": "application/json", ".csv": "text/csv",
               ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}


def media_type(ext: Column) -> Column:
    rule = F
    for name, kind in MEDIA_TYPES.items():
        rule = rule.when(ext == name, kind)
    return rule.otherwise("application/octet-stream")


def short_hash(content: Column) -> Column:
    """First 12 hex digits of the MD5."""
    return F.substring(F.md5(content), 1, 12)


@F.pandas_udf(T.StringType())
def decode_references(texts: pd.Series) -> pd.Series:
    """Named and numeric character references as characters; a no-break space as a blank."""
    return texts.map(lambda t: unescape(t).replace("\xa0", " "), na_action="ignore")


def html_text(html: Column) -> Column:
    """Visible text: script, style, nav, footer and header blocks go, pieces are trimmed and joined by newline."""
    body = html
    for tag in ("script", "style", "nav", "footer", "header"):
        body = F.regexp_replace(body, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    body = F.regexp_replace(body, r"(?s)<!--.*?-->", "")
    body = F.regexp_replace(body, r"(?s)<!doctype[^>]*>", "")
    pieces = F.transform(F.split(body, r"(?s)<[^>]*>"), lambda p: strip(p))
    text = F.array_join(F.filter(pieces, lambda p: p != ""), "\n")
    # only texts with references cross to Python
    return strip(F.when(F.contains(text, F.lit("&")), decode_references(F.when(F.contains(text, F.lit("&")), text))).otherwise(text))


def wildcard_regex(query: str) -> str:
    """`*` stands for any characters of a line, everything else is literal."""
    return ".*".join(re.escape(part) for part in query.split("*"))


_GLOB_PART = re.compile(r"(?:(?<=/)|^)\*\*/|\*+|\?|\[!?[^\]]+\]|[^*?\[]+|\[")


def glob_regex(pattern: str) -> str:
    """Regex of an object-name pattern: `**/` is any folders or none, `*` any characters, `?` one, `[…]` and `[!…]` sets."""
    out = []
    for part in _GLOB_PART.findall(pattern):
        if part == "**/":
            out.append("(?:.*/)?")
        elif part[0] == "*":
            out.append(".*")
        elif part == "?":
            out.append(".")
        elif part[0] == "[" and len(part) > 2:
            out.append(part.replace("\\", "\\\\").replace("[!", "[^", 1))
        else:
            out.append(re.escape(part))
    return "(?s)^" + "".join(out) + "$"

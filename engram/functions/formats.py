"""Readable sizes, stars, cut text and digest lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from engram.functions import lexicon as lx


def human_size(size: Column) -> Column:
    """Bytes in French units; `?` for nothing."""
    value = size.cast("double")
    rule = F.when(size.isNull() | (size == 0), "?").when(
        value < 1024, F.concat(size.cast("string"), F.lit(" " + lx.SIZE_UNITS[0]))
    )
    for power, unit in enumerate(lx.SIZE_UNITS[1:-1], start=1):
        rule = rule.when(value < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", value / 1024**power))
    return rule.otherwise(F.format_string(f"%.1f {lx.SIZE_UNITS[-1]}", value / 1024.0**4))


def stars(importance: Column, out_of: int = 3) -> Column:
    return F.concat(F.repeat(F.lit("★"), importance), F.repeat(F.lit("☆"), F.lit(out_of) - importance))


def cut(text: Column, n: int) -> Column:
    """First n characters, with an ellipsis when something was cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def document_line(rank: Column, name: Column, importance: Column, status: Column) -> Column:
    """Head line of a document hit."""
    icon = F.when(status == "enriched", "✅").otherwise("⏳")
    return F.concat(
        rank.cast("string"), F.lit(". **"), name, F.lit("** "),
        F.repeat(F.lit("⭐"), F.coalesce(importance, F.lit(3)).cast("int")), F.lit(" "), icon,
    )


def digest_line(author: Column, id_: Column, ts: Column, nature: Column, summary: Column) -> Column:
    """One line of the daily digest."""
    who = F.when(author == "human", "🧑").when(author == "assistant", "🤖").otherwise("💭")
    return F.concat(
        who, F.lit(" ["), id_.cast("string"), F.lit("] "), F.date_format(ts, "HH:mm"), F.lit(" | "),
        F.rpad(F.substring(nature, 1, 10), 10, " "), F.lit(" | "),
        F.substring(F.coalesce(summary, F.lit("")), 1, 60), F.lit("..."),
    )


def context_block(rank: Column, seg) -> Column:
    """Block of one hit in the answer context; `seg` maps names to columns."""
    info = F.concat(
        F.when(seg["gr_id"].isNotNull() & (seg["gr_id"] != 0), F.concat(F.lit("bloc:"), seg["gr_id"].cast("string"))).otherwise(""),
        F.lit(" "),
        F.when(
            seg["confidence_score"].isNotNull() & (seg["confidence_score"] != 0),
            F.format_string("conf:%.2f", seg["confidence_score"]),
        ).otherwise(""),
    )
    head = F.concat(
        F.lit("\n[Mémoire "), rank.cast("string"), F.lit("] "),
        F.coalesce(F.date_format(seg["timestamp"], "yyyy-MM-dd"), F.lit("N/A")),
        F.lit(" | "), info, F.format_string(" | Score: %.2f\n", seg["score"]),
    )
    people = F.when(F.size(seg["personnes"]) > 0, F.concat(
        F.lit("Personnes: "), F.to_json(seg["personnes"]), F.lit("\n"))).otherwise("")
    summary = F.when(F.coalesce(seg["resume_texte"], F.lit("")) != "", F.concat(
        F.lit("Résumé: "), seg["resume_texte"], F.lit("\n"))).otherwise("")
    return F.concat(head, people, summary)

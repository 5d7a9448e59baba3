"""Score columns: tag proximity, emotion similarity, resonance, time decay, quadrant labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from engram.functions import lexicon as lx


def tag_proximity(a: Column, b: Column) -> Column:
    """0..1 from the hierarchy CC-SSSS-TTTT; anything malformed counts as far."""
    pa, pb = F.split(a, "-"), F.split(b, "-")
    part = lambda p, i: F.try_element_at(p, F.lit(i))
    gap = lambda i: F.abs(part(pa, i).try_cast("int") - part(pb, i).try_cast("int"))
    # `least` skips nulls, so a part that is no number must stay null on its own
    near = lambda i: F.when(gap(i).isNotNull(), 1 - F.least(gap(i) / 100, F.lit(1.0)))
    shaped = (F.size(pa) == 3) & (F.size(pb) == 3)
    score = (
        F.when(~shaped | (part(pa, 1) != part(pb, 1)), 0.1)
        .when(part(pa, 2) != part(pb, 2), 0.3 + 0.3 * near(2))
        .otherwise(0.7 + 0.3 * near(3))
    )
    return F.coalesce(score, F.lit(0.1))


def emotion_similarity(v1: Column, a1: Column, v2: Column, a2: Column) -> Column:
    """Cosine of two (valence, activation) vectors on 0..1; 0.5 when either is null length."""
    norms = F.sqrt(v1 * v1 + a1 * a1) * F.sqrt(v2 * v2 + a2 * a2)
    return F.when(norms == 0, 0.5).otherwise(((v1 * v2 + a1 * a2) / norms + 1) / 2)


def mask_of(weights: Mapping[str, float]) -> dict[int, float]:
    """Vector positions a weighting looks at."""
    return {
        pos: float(weights[field])
        for field, positions in lx.MASK_POSITIONS.items()
        if weights.get(field, 0) > 0
        for pos in positions
    }


def resonance(vector: Column, mask: Mapping[int, float] | Column) -> Column:
    """Dot product of a sparse vector with a mask (positions and weights, or a column of them), rounded to 4 places."""
    if isinstance(mask, Column):
        weights = mask
    elif not mask:
        return F.lit(0.0)
    else:
        # the mask is one constant map; vectors have few entries
        weights = F.expr("map(" + ", ".join(f"{p}, {w!r}D" for p, w in mask.items()) + ")")
    part = lambda e: F.coalesce(F.try_element_at(weights, e["key"]), F.lit(0.0)) * e["value"]
    return F.round(F.aggregate(F.map_entries(vector), F.lit(0.0), lambda acc, e: acc + part(e)), 4)


def resonance_score(vector: Column, mask: Mapping[int, float] | Column) -> Column:
    """Resonance over its practical maximum; neutral without a vector."""
    empty = vector.isNull() | (F.size(vector) == 0)
    return F.when(empty, 0.5).otherwise(F.least(F.lit(1.0), resonance(vector, mask) / 5))


def whole_days(ts: Column, now: Column) -> Column:
    """Whole days between, rounded down (negative for the future)."""
    return F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 86_400_000_000)


def time_score(ts: Column, now: Column) -> Column:
    """Linear decay over a year, at least 0.1; 0.5 without a time."""
    decay = F.greatest(F.lit(0.1), 1.0 - whole_days(ts, now) / 365)
    return F.when(ts.isNull(), 0.5).otherwise(decay)


def hits_score(hits: Column, base: float, step: float) -> Column:
    """0.5 without a hit, otherwise base + step per hit, at most 1."""
    return F.when(hits > 0, F.least(F.lit(1.0), base + hits * step)).otherwise(0.5)


def quadrant(v: Column, a: Column) -> Column:
    """Name of the emotion quadrant."""
    high = F.coalesce(a > 0.5, F.lit(False))
    return (
        F.when(v.isNull() & a.isNull(), "indéfini")
        .when((v < 0) & high, "Tension (stress, anxiété, colère)")
        .when(v < 0, "Dépression (tristesse, épuisement)")
        .when((v > 0) & high, "Excitation (joie, enthousiasme)")
        .when(v > 0, "Sérénité (calme, détente)")
        .when(high, "Haute activation")
        .otherwise("Basse activation")
    )


def fix_tag(tag: Column) -> Column:
    """Repair a tag code to CC-SSSS-TTTT, null when it cannot be repaired."""
    p = F.split(F.trim(tag), "-")
    at = lambda i: F.try_element_at(p, F.lit(i))
    # zero fill that never cuts longer text
    fill = lambda c, n: F.when(F.length(c) >= n, c).otherwise(F.lpad(c, n, "0"))
    code = lambda a, b, c: F.concat_ws("-", fill(a, 2), fill(b, 4), fill(c, 4))
    return (
        F.when(F.size(p) == 3, code(at(1), at(2), at(3)))
        .when(F.size(p) == 4, code(at(1), F.concat(at(2), at(3)), F.concat(at(3), at(4))))
        .when(F.size(p) >= 6, code(at(1), at(2), at(3)))
    )

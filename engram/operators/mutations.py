"""Changes to tables, written as new tables: appends, upserts, deletes, flags.

Each function returns the new content; `sources.sinks.swap` stores it. Keys are reduced by aggregation before
they are joined, so repeated updates of one key never meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from engram.functions import lexicon as lx
from engram.functions.vector import vectorise
from engram.operators.filters import importance_of
from engram.operators.joins import canonicalise
from engram.session import materialise, spread

EDGE_KEY = ["source_id", "target_id", "type"]
PILLAR_CATEGORIES = ["IDENTITE", "RECHERCHE", "TECHNIQUE", "RELATION", "VALEUR"]


def latest(df: DataFrame, keys: Sequence[str], order: Column, first: bool = False) -> DataFrame:
    """One row per key, the last (or first) by `order`; combines on the map side."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if first else F.max_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def ingest_segments(
    exchanges: DataFrame, annotations: DataFrame, key: str = "id", aliases: DataFrame | None = None, known_projects: DataFrame | None = None
) -> DataFrame:
    """Exchanges as stored segments: joined with their annotations, without what is not indexable, with defaults, epoch and
    vector. With `aliases` and `known_projects` people and projects are resolved first (see `joins.canonicalise`)."""
    joined = exchanges.join(annotations, key, "left").filter(F.coalesce(F.col("indexable"), F.lit(True)))
    filled = joined.withColumns(
        {
            "timestamp_epoch": F.unix_seconds("timestamp"),
            "emotion_valence": F.coalesce("emotion_valence", F.lit(0.0)),
            "emotion_activation": F.coalesce("emotion_activation", F.lit(0.5)),
            "confidence_score": F.coalesce("confidence_score", F.lit(0.5)),
        }
    ).drop("indexable")
    if aliases is not None and known_projects is not None:
        filled = canonicalise(filled, aliases, known_projects)
    return vectorise(filled)


def upsert_facts(facts: DataFrame, updates: DataFrame) -> DataFrame:
    """Insert or replace facts by (domaine, sujet); importance is clamped to 1..5, the last update wins."""
    keys = ["domaine", "sujet"]
    fresh = latest(updates, keys, F.struct("derniere_maj", "information")).withColumn(
        "importance", F.least(F.lit(5), F.greatest(F.lit(1), F.col("importance")))
    )
    old, new = facts.alias("o"), fresh.alias("n")
    both = old.join(new, keys, "full_outer")
    # id and creation date of the stored row survive; everything else comes from the update when there is one
    mine, theirs = set(facts.columns), set(fresh.columns)

    def pick(c: str) -> Column:
        sides = [F.col(f"n.{c}")] if c in theirs else []
        sides += [F.col(f"o.{c}")] if c in mine else []
        if c == "id":
            sides.reverse()
        if c == "date_creation":
            sides = [F.col(f"o.{c}"), F.col("n.derniere_maj")]
        return F.coalesce(*sides).alias(c)

    rest = [c for c in [*facts.columns, *(c for c in fresh.columns if c not in mine)] if c not in keys]
    return both.select(*keys, *[pick(c) for c in rest])


def upsert_by_key(table: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Replace whole rows by key; untouched rows pass through without being reduced."""
    # equal order values: the row that is largest as text wins, whatever the partitioning
    fresh = latest(changes, keys, F.struct(F.col(order), F.to_json(F.struct(*changes.columns))))
    return table.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)


def delete_segments(seg: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments without the ids, edges without either endpoint among them."""
    gone = ids.select("id").distinct()
    kept = edges.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    kept = kept.join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return seg.join(gone, "id", "left_anti"), kept.select(*edges.columns)


def _flag(seg: DataFrame, ids: DataFrame, column: str, value: int) -> DataFrame:
    marked = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return (
        seg.join(marked, "id", "left")
        .withColumn(column, F.when(F.col("_hit"), F.lit(value).cast("int")).otherwise(F.col(column)))
        .select(*seg.columns)
    )


def set_pillar_flag(seg: DataFrame, ids: DataFrame, value: int = 1) -> DataFrame:
    return _flag(seg, ids, "pilier", value)


def mark_truth(seg: DataFrame, ids: DataFrame, status: int) -> DataFrame:
    """-1 refuted, 0 neutral, 1 valid."""
    if status not in (-1, 0, 1):
        raise ValueError("status is -1, 0 or 1")
    return _flag(seg, ids, "statut_verite", status)


def insert_edges(edges: DataFrame, new: DataFrame, mode: str = "ignore") -> DataFrame:
    """Add edges; on an existing key either the stored one stays (`ignore`) or the new one wins (`replace`)."""
    if mode not in ("ignore", "replace"):
        raise ValueError("mode is ignore or replace")
    both = edges.withColumn("_new", F.lit(0)).unionByName(new.select(*edges.columns).withColumn("_new", F.lit(1)))
    # equal keys within one batch: the smallest weight and metadata text decide, whatever the row order
    order = F.struct("_new", "poids", F.to_json("metadata"))
    return latest(both, EDGE_KEY, order, first=mode == "ignore").drop("_new")


def internal_segments(notes: DataFrame, author: str = "internal") -> DataFrame:
    """Segments for the system's own reflections."""
    return notes.withColumns(
        {
            "source_nature": F.lit("reflexion"),
            "source_format": F.lit("internal"),
            "auteur": F.lit(author),
            "statut_verite": F.lit(1),
            "confidence_score": F.lit(1.0),
            "token_start": F.lit(0),
            "token_end": F.lit(0),
            "timestamp_epoch": F.unix_seconds("timestamp"),
        }
    )


def valid_pillars(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the rules (category, importance 0..3, at least 3 characters) and the rest."""
    ok = (
        F.upper("categorie").isin(*PILLAR_CATEGORIES) & F.col("importance").between(0, 3)
        & (F.length(F.trim("fait")) >= 3)
    )
    ok = F.coalesce(ok, F.lit(False))
    shaped = new.withColumns({"categorie": F.upper("categorie"), "fait": F.trim("fait")})
    return shaped.filter(ok), shaped.filter(~ok)


PIECE, BITS, STRETCH = 32, 27, 1 << 19  # letters of a piece at most; bits of a place in the bitmap; letters hashed at a time
_BASE, _SPREAD = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_WAYS = _SPREAD, 0x94D049BB133111EB, 0xD6E8FEB86659FD93  # a piece sets a bit by each
FOUND = 50_000  # pieces that a task gathers before it gives them on


def _sums(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the letters' numbers, from which the hash of any stretch follows."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    letters = (codes + np.uint64(1)) * np.uint64(_SPREAD)
    letters ^= letters >> np.uint64(29)
    powers, back = (np.cumprod(np.full(len(codes), x, np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * powers, dtype=np.uint64)]), back


def _hashes(sums: np.ndarray, back: np.ndarray, n: int) -> np.ndarray:
    """A number for every `n` neighbouring letters."""
    own = (sums[n:] - sums[:-n]) * back[: max(len(sums) - n, 0)]
    return own ^ (own >> np.uint64(32))


def _places(own: np.ndarray, way: int, bits: int) -> np.ndarray:
    """One of the bitmap's places for each of `_hashes`."""
    return ((own * np.uint64(way)) >> np.uint64(64 - bits)).astype(np.int64)


def _bitmap(pieces: DataFrame, bits: int) -> np.ndarray:
    """Bits for every piece, in a map of fixed size (16 MB) that is filled in parts."""
    part = min(1 << 20, 1 << bits)

    def places(batches):
        for b in batches:
            own = np.array([_hashes(*_sums(x), len(x))[0] for x in b.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_places(own, way, bits) for way in _WAYS]), pa.int64())], ["place"])

    def filled(frame):
        own = np.zeros(part, bool)
        own[frame["place"].to_numpy() % part] = True
        return pd.DataFrame({"part": [int(frame["place"].iloc[0]) // part], "bits": [np.packbits(own).tobytes()]})

    rows = pieces.mapInArrow(places, "place bigint").distinct().groupBy(F.floor(F.col("place") / part)).applyInPandas(filled, "part bigint, bits binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows.collect():  # 128 rows at most
        out[r["part"] * part // 8 : (r["part"] + 1) * part // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _stretches(texts: Sequence[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts (their numbers) of about `STRETCH` letters together; longer ones in overlapping parts."""
    numbers, parts, size = [], [], 0
    for number, text in enumerate(texts):
        for start in range(0, len(text), STRETCH):
            numbers.append(number)
            parts.append(text[start : start + STRETCH + PIECE - 1])
            size += len(parts[-1])
            if size >= STRETCH:
                yield numbers, parts
                numbers, parts, size = [], [], 0
    if parts:
        yield numbers, parts


def _held_pieces(texts: DataFrame, pieces: DataFrame, lengths: Sequence[int], keyed: int = 1, bits: int = BITS) -> DataFrame:
    """(_key, _piece): the pieces that stand in the texts (columns _key, _low), and by chance some strings more.

    Only stretches of a text whose places in the bitmap of the asked pieces are all set leave the task; pieces of fewer than
    `keyed` letters without the key, so that each is given on once for many texts.
    """
    held = texts.sparkSession.sparkContext.broadcast(_bitmap(pieces, bits))
    names, kinds = ["_key", "_piece"], (pa.int64(), pa.string())

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

    def run(batches):
        found = set()
        for b in batches:
            keys = b.column(0).to_pylist()
            for numbers, parts in _stretches(b.column(1).to_pylist()):
                whole, ends = "".join(parts), np.cumsum([len(p) for p in parts])
                sums, back = _sums(whole)
                for n in lengths:
                    own = _hashes(sums, back, n)
                    hits = np.arange(len(own))
                    for way in _WAYS:
                        at = _places(own[hits], way, bits)
                        hits = hits[held.value[at >> 3] & (128 >> (at & 7)) != 0]
                    part = np.searchsorted(ends, hits, side="right")
                    inside = hits + n <= ends[part]
                    found.update((keys[numbers[p]] if n >= keyed else None, whole[i : i + n]) for i, p in zip(hits[inside].tolist(), part[inside].tolist(), strict=True))
                    if len(found) >= FOUND:
                        yield rows(found)
                        found = set()
        if found:
            yield rows(found)

    return texts.select("_key", "_low").mapInArrow(run, "_key bigint, _piece string").distinct()


def add_pillars(pillars: DataFrame, new: DataFrame, letters: int | None = None) -> DataFrame:
    """Append pillars whose text is not contained in a stored fact (any case).

    A text is contained only where its first `PIECE` letters stand (all of a shorter text). The stored facts are read once
    for stretches that can be such pieces (see `_held_pieces`), and these are joined with the pieces; longer texts are then
    compared with the facts that hold their piece. `letters=50` is the contract's rule, which looks for the start of a new
    fact only.
    """
    good, _ = valid_pillars(new)
    text = F.substring(F.lower("fait"), 1, letters) if letters else F.lower("fait")
    keyed = materialise(good.select(text.alias("_short")).distinct().withColumn("_piece", F.substring("_short", 1, PIECE)))
    lengths = [r[0] for r in keyed.select(F.length("_piece")).distinct().collect()]  # PIECE values at most
    low = pillars.select(F.lower("fait").alias("_low")).filter("_low IS NOT NULL").select(F.xxhash64("_low").alias("_key"), "_low")
    at = materialise(_held_pieces(spread(low), keyed.select("_piece").distinct(), lengths, keyed=PIECE))
    long = F.length("_short") > PIECE
    repeated = keyed.filter(~long).select("_short").join(at.select(F.col("_piece").alias("_short")), "_short", "left_semi")
    likely = keyed.filter(long).join(at, "_piece").select("_short", "_key").distinct()
    repeated = repeated.unionByName(likely.join(low, "_key").filter(F.contains("_low", F.col("_short"))).select("_short").distinct())
    fresh = latest(good.withColumn("_short", text), ["_short"], F.col("id"), first=True)
    return pillars.unionByName(fresh.join(repeated, "_short", "left_anti").select(*pillars.columns))


def update_pillars(pillars: DataFrame, changes: DataFrame) -> DataFrame:
    """Change category and importance by id; invalid values leave the row as it is."""
    ok = changes.filter(
        (F.col("categorie").isNull() | F.upper("categorie").isin(*PILLAR_CATEGORIES))
        & (F.col("importance").isNull() | F.col("importance").between(0, 3))
    ).select("id", F.upper("categorie").alias("_c"), F.col("importance").alias("_i"))
    return (
        pillars.join(ok, "id", "left")
        .withColumns({"categorie": F.coalesce("_c", "categorie"), "importance": F.coalesce("_i", "importance")})
        .select(*pillars.columns)
    )


def delete_facts(facts: DataFrame, keys: DataFrame, by: Sequence[str] = ("domaine", "sujet")) -> DataFrame:
    return facts.join(keys.select(*by).distinct(), list(by), "left_anti")


def write_reflections(notes: DataFrame) -> DataFrame:
    """Facts from reflections (contenu, type_reflexion, poids_mnemique, timestamp, ego_version, modele)."""
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("poids_mnemique")))
    kind, ts = F.col("type_reflexion"), F.col("timestamp")
    return notes.filter(kind.isin(*lx.REFLECTION_TYPES)).select(
        F.concat(F.lit("reflexion_"), kind).alias("domaine"),
        F.concat_ws("_", kind, F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "HHmmss")).alias("sujet"),
        F.col("contenu").alias("information"),
        importance_of(weight).alias("importance"),
        F.to_json(F.struct(kind.alias("type_reflexion"), weight.alias("poids_mnemique"), "ego_version", "modele")).alias("metadata"),
        ts.alias("date_creation"),
        ts.alias("derniere_maj"),
    )


def entity_candidates(seg: DataFrame, existing: DataFrame | None = None, cut: int | None = None) -> DataFrame:
    """Queue of unknown names: one row per kind and name with the context (its first `cut` letters) of its earliest segment."""
    context = F.substring("resume_texte", 1, cut) if cut else F.col("resume_texte")
    kinds = {"personne": "personne_candidat", "projet": "projet_candidat"}
    rows = seg.select(
        F.col("timestamp"), "id", context.alias("contexte"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("nom")) for k, c in kinds.items()])).alias("c"),
    ).select("timestamp", "id", "contexte", "c.*").filter("nom IS NOT NULL AND nom <> ''")
    found = rows.groupBy("kind", "nom").agg(
        F.min_by("contexte", F.struct("timestamp", "id")).alias("contexte"), F.min("timestamp").alias("date_detection"),
        F.count(F.lit(1)).alias("n_mentions"),
    )
    return found if existing is None else found.join(existing.select("kind", "nom").distinct(), ["kind", "nom"], "left_anti")


def replace_section(docs: DataFrame, title: str, body: str, text: str = "text") -> DataFrame:
    """Replace what stands below a `#`/`##` heading up to the next one; documents without it are unchanged."""
    import re

    head = rf"(?im)(^#{{1,2}}\s*{re.escape(title.strip())}\s*?$)"
    content = F.col(text)
    begin = F.regexp_instr(content, F.lit(head)) - 1
    heading_end = begin + F.length(F.regexp_extract(content, head, 1))
    rest = F.substring(content, heading_end + 1, F.length(content))
    next_at = F.regexp_instr(rest, F.lit(r"\n#{1,2}\s+\S"))
    tail = F.when(next_at > 0, F.substring(rest, next_at, F.length(rest))).otherwise("")
    fresh = F.concat(F.substring(content, F.lit(1), heading_end), F.lit(f"\n{body.strip()}\n"), tail)
    return docs.withColumn("section_found", begin >= 0).withColumn(text, F.when(F.col("section_found"), fresh).otherwise(content))


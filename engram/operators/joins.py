"""Join operators: canonical names, duplicates, hierarchies, merged exports, segment text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from engram.operators.filters import KEYWORD_FIELDS, haystack, like
from engram.session import stored


def alias_dim(persons: DataFrame) -> DataFrame:
    """(alias, canonical) rows, lower case, from persons with a canonical name and variants."""
    names = F.array_union(F.array("nom_canonique"), F.coalesce("variantes", F.array().cast("array<string>")))
    rows = persons.select(F.explode(names).alias("alias"), "nom_canonique")
    # one canonical name per alias, so that the join below can never multiply rows
    return rows.groupBy(F.lower("alias").alias("alias")).agg(F.min("nom_canonique").alias("canonical"))


MOST_NAMES = 500_000  # resolved names that are sent to every task


def canonicalise(seg: DataFrame, aliases: DataFrame, known_projects: DataFrame) -> DataFrame:
    """Replace people by canonical names and move unknown projects to subjects.

    Adds `personne_candidat` / `projet_candidat`, the first unknown one. `known_projects` has `nom`.
    The distinct names are resolved first; only those that are known are kept, with a checked number. Mentions of both kinds
    then meet that table and are regrouped by id once, and join their segments by the same key.
    """
    mention = lambda kind, col: F.transform(F.coalesce(F.col(col), F.array().cast("array<string>")), lambda n, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), n.alias("name")))
    rows = seg.select("id", F.inline(F.concat(mention("p", "personnes"), mention("j", "projets"))))
    names = rows.select("kind", "name").distinct()
    people = names.filter("kind = 'p'").join(aliases, F.lower("name") == F.col("alias")).select("kind", "name", F.col("canonical").alias("known"))
    known = known_projects.select(F.lower("nom").alias("nom")).distinct()
    projects = names.filter("kind = 'j'").join(known, F.lower("name") == F.col("nom"), "left_semi").select("kind", "name", F.col("name").alias("known"))
    resolved = stored(people.unionByName(projects))
    few = resolved.count() <= MOST_NAMES
    found = rows.join(F.broadcast(resolved) if few else resolved, ["kind", "name"], "left")

    def listed(kept: Column, value: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(kept, F.struct("pos", value.alias("name")))))["name"]

    person, project, new = F.col("kind") == "p", F.col("kind") == "j", F.col("known").isNull()
    own = found.groupBy("id").agg(
        listed(person, F.coalesce("known", "name")).alias("_p"), listed(project & ~new, F.col("name")).alias("_k"), listed(project & new, F.col("name")).alias("_u"),
        F.min_by("name", F.when(person & new, F.col("pos"))).alias("personne_candidat"), F.min_by("name", F.when(project & new, F.col("pos"))).alias("projet_candidat"),
    )
    empty = F.array().cast("array<string>")
    given = lambda c: F.coalesce(F.col(c), empty)
    return seg.join(own, "id", "left").withColumns(
        {"personnes": given("_p"), "projets": given("_k"), "sujets": F.array_union(given("sujets"), given("_u"))}
    ).drop("_p", "_k", "_u")


def new_only(df: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored yet."""
    return df.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def changed_only(listed: DataFrame, indexed: DataFrame, key: str, digest: str) -> DataFrame:
    """Files that are new or whose hash changed."""
    return listed.join(indexed.select(key, digest).distinct(), [key, digest], "left_anti")


def duplicate_rows(seg: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the keys that occur more than once."""
    repeated = seg.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys)
    return seg.join(repeated, list(keys), "left_semi")


def link_versions(pairs: DataFrame, seg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid version links (source_id -> target_id) and the rejected pairs with a reason.

    A link needs both segments, two different ids and a source that is not newer than its target.
    """
    ends = seg.select("id", "timestamp")
    joined = pairs.join(ends.select(F.col("id").alias("source_id"), F.col("timestamp").alias("_st")), "source_id", "left").join(
        ends.select(F.col("id").alias("target_id"), F.col("timestamp").alias("_tt")), "target_id", "left"
    )
    reason = (
        F.when(F.col("source_id") == F.col("target_id"), "same segment")
        .when(F.col("_st").isNull(), "source missing")
        .when(F.col("_tt").isNull(), "target missing")
        .when(F.col("_st") > F.col("_tt"), "source is newer")
    )
    judged = joined.withColumn("reason", reason).drop("_st", "_tt")
    ok = judged.filter("reason IS NULL").drop("reason").withColumns({"type": F.lit("LIEN_VERSION"), "poids": F.lit(2.0)})
    return ok, judged.filter("reason IS NOT NULL")


def segment_text(seg: DataFrame, log: DataFrame, bucket: int = 2048) -> DataFrame:
    """Text of each segment: the log lines of its file from token_start up to token_end.

    The range is cut into buckets of tokens, so the join is an equi-join on (file, bucket): a file that
    holds most of the lines spreads over its buckets. Lines of one segment are regrouped by segment id.
    """
    first, last = F.floor(F.col("token_start") / bucket), F.floor((F.col("token_end") - 1) / bucket)
    ranges = seg.filter("token_end > token_start").select(
        "id", "source_file", "token_start", "token_end", F.explode(F.sequence(first, last)).alias("_b")
    )
    lines = log.select(
        F.col("source_file"), F.col("offset"), F.col("line"), F.floor(F.col("offset") / bucket).alias("_b")
    )
    hits = ranges.join(lines, ["source_file", "_b"]).filter("offset >= token_start AND offset < token_end")
    return hits.groupBy("id").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("offset", "line")))["line"], "\n").alias("text"),
        F.count(F.lit(1)).alias("n_lines"),
    )


def segment_line(seg: DataFrame, log: DataFrame) -> DataFrame:
    """Exact form: the line that starts at the segment's offset."""
    return seg.select("id", "source_file", "token_start").join(
        log.select("source_file", F.col("offset").alias("token_start"), "line"), ["source_file", "token_start"]
    )


def merge_exports(exports: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Merge flat exports, earlier ones win: conversations and their messages.

    Conversations: first name and created_at, updated_at and summary of the newest copy. Messages: one row per
    uuid over all exports; messages without a uuid are kept from the first copy of their conversation only.
    Both sides reduce with map-side aggregation, so a message that was exported a million times is not moved.
    """
    rows = None
    for number, df in enumerate(exports):
        part = df.withColumn("_src", F.lit(number))
        rows = part if rows is None else rows.unionByName(part)
    first = lambda c: F.min_by(c, "_src").alias(c)
    newest = F.max_by(F.struct("updated_at", "summary"), F.struct(F.coalesce("updated_at", F.lit("")), -F.col("_src")))
    conversations = (
        rows.groupBy("uuid").agg(first("name"), first("created_at"), newest.alias("_n"), F.min("_src").alias("_first"))
        .select("uuid", "name", "created_at", "_n.updated_at", "_n.summary", "_first")
    )
    messages = rows.select(
        "uuid", "_src", F.posexplode("chat_messages").alias("_pos", "m")
    ).select(F.col("uuid").alias("conversation"), "_src", "_pos", "m.*")
    named = F.coalesce(F.col("uuid"), F.lit("")) != ""
    fields = [c for c in messages.columns if c not in ("_src", "_pos")]
    unique = (
        messages.filter(named).groupBy("uuid")
        .agg(F.min(F.struct("_src", "_pos", F.struct(*[F.col(c).alias(c) for c in fields if c != "content"]).alias("row"))).alias("k"))
        .select("k._src", "k._pos", "k.row.*")
    )
    unnamed = (
        messages.filter(~named)
        .join(conversations.select(F.col("uuid").alias("conversation"), F.col("_first").alias("_src")), ["conversation", "_src"], "left_semi")
        .select(*unique.columns)
    )
    return conversations.drop("_first"), unique.unionByName(unnamed).drop("_src", "_pos")


def hierarchy(projects: DataFrame) -> DataFrame:
    """Depth and `a > b > c` path of every node below a root, for trees of any depth.

    Every node knows an ancestor and the path from there. A round hands it that ancestor's ancestor and path, which doubles
    the distance, so a tree of n levels takes log2(n) rounds of one equi-join; nodes that have reached their root take part
    no more. Nodes whose chain ends in a missing parent are left out. Nodes that haven't reached a root when the distance
    exceeds the number of nodes stand in or below a cycle, which is an error that names some of them.
    """
    rows = projects.select("id", "nom", "parent_id", F.col("parent_id").alias("above"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("niveau"), F.col("nom").alias("chemin"))
    rows = stored(rows)
    done, left, reach, most = rows.filter("above IS NULL"), rows.filter("above IS NOT NULL"), 1, rows.count()
    known = rows.select("id", "above", "niveau", "chemin")
    while not left.isEmpty():
        if reach > 2 * most:
            raise ValueError(f"cyclic: {[r.id for r in left.orderBy('id').limit(10).collect()]}")
        up = known.select(F.col("id").alias("above"), F.col("above").alias("_above"), F.col("niveau").alias("_niveau"), F.col("chemin").alias("_chemin"))
        moved = stored(left.join(up, "above").select(
            "id", "nom", "parent_id", F.col("_above").alias("above"), (F.col("niveau") + F.col("_niveau")).alias("niveau"), F.concat_ws(" > ", "_chemin", "chemin").alias("chemin")))
        done, left, reach = done.unionByName(moved.filter("above IS NULL")), moved.filter("above IS NOT NULL"), 2 * reach
        # ancestors that reached their root stay as they are
        known = done.unionByName(left).select("id", "above", "niveau", "chemin")
    return done.select("id", "nom", "parent_id", "niveau", "chemin")


def person_lookup(persons: DataFrame, term: str) -> DataFrame:
    """Active persons whose name or variants hold the term."""
    text = F.concat_ws(" ", "nom_canonique", F.array_join(F.coalesce("variantes", F.array().cast("array<string>")), " "))
    return persons.filter(F.col("actif") == 1).withColumn("recherche_texte", text).filter(like(F.col("recherche_texte"), term))


def newest_hit(seg: DataFrame, term: str):
    """Aggregate for the newest segment that mentions a term."""
    hit = F.contains(haystack(*KEYWORD_FIELDS), F.lit(term.lower()))
    return F.max_by("id", F.when(F.coalesce(hit, F.lit(False)), F.struct("timestamp", -F.col("id"))))


def weave_trajectories(trajectories: Sequence[dict], seg: DataFrame, cut: int | None = None) -> DataFrame:
    """Link the newest segment of the old concept to the newest of the new one, when both exist and differ.

    All trajectories of a reflection run share one aggregation pass over the segments: two `max_by` each.
    """
    if not trajectories:
        raise ValueError("no trajectories")
    slots = []
    for number, t in enumerate(trajectories):
        slots.append(newest_hit(seg, t["ancien_concept"]).alias(f"a{number}"))
        slots.append(newest_hit(seg, t["nouveau_concept"]).alias(f"b{number}"))
    row = seg.agg(*slots)
    found = F.array(
        *[
            F.struct(
                F.col(f"a{i}").alias("source_id"), F.col(f"b{i}").alias("target_id"),
                F.lit(t.get("type", "TRAJECTOIRE")).alias("type"),
                F.lit(t.get("description", "")[:cut]).alias("description"),
                F.lit(float(t.get("confidence", 0.5))).alias("confidence"),
            )
            for i, t in enumerate(trajectories)
        ]
    )
    links = row.select(F.inline(found))
    return links.filter("source_id IS NOT NULL AND target_id IS NOT NULL AND source_id <> target_id")

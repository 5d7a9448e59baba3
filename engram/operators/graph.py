"""The typed, weighted graph of segments.

All rules are linear in the number of segments. No rule uses a window over a raw key: an entity, tag or
emotion peak sequence that covers a third of the corpus is scanned in sorted runs (see `ordered`).
Edges: source_id, target_id, type, poids, metadata MAP<STRING,STRING>.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from engram.functions import lexicon as lx
from engram.operators import ordered as o
from engram.operators.mutations import EDGE_KEY
from engram.session import materialise, stored

EDGE_COLUMNS = ["source_id", "target_id", "type", "poids", "metadata"]
BLOCK = ["gr_id", "source_file"]


def _meta(**fields: Column) -> Column:
    return F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))])


def _edges(df: DataFrame, kind: str, source: str, target: str, meta: Column) -> DataFrame:
    return df.select(
        F.col(source).alias("source_id"), F.col(target).alias("target_id"), F.lit(kind).alias("type"),
        F.lit(lx.LINK_WEIGHTS[kind]).alias("poids"), meta.alias("metadata"),
    )


def weave_entities(seg: DataFrame, col: str = "personnes", kind: str = "LIEN_PERSONNE") -> DataFrame:
    """Link each segment to the previous one with the same entity."""
    names = F.filter(F.transform(col, lambda e: F.trim(e)), lambda e: e != "")
    # duplicates inside one list go without a shuffle
    rows = seg.select("id", "timestamp", F.posexplode(F.array_distinct(names)).alias("pos", "entity"))
    linked = o.ordered_scan(rows, ["entity"], ["timestamp", "id"], {"prev_id": o.lag("id")}).filter(
        "prev_id IS NOT NULL AND prev_id <> id"
    )
    # two entities may give the same pair: the first in the segment's list names the edge
    named = linked.groupBy("prev_id", "id").agg(F.min_by("entity", "pos").alias("entity"))
    return _edges(named, kind, "prev_id", "id", _meta(sujet=F.col("entity")))


def weave_emotions(seg: DataFrame, minimum: float = 0.6, distance: float = 0.10, window: int = 20) -> DataFrame:
    """Link emotion peaks to similar ones among the 20 peaks before them."""
    act = F.coalesce(F.nullif(F.col("emotion_activation"), F.lit(0.0)), F.lit(0.5))
    peaks = seg.filter(F.abs("emotion_valence") >= minimum).select(
        "id", "timestamp", F.col("emotion_valence").alias("val"), act.alias("act")
    )
    pairs = o.last_n_pairs(peaks, [], ["timestamp", "id"], window, ["id", "val", "act"])
    gap = F.sqrt(F.pow(F.col("val") - F.col("prev_val"), 2) + F.pow(F.col("act") - F.col("prev_act"), 2))
    return _edges(
        pairs.filter(gap < distance), "RESONANCE_EMOTION", "prev_id", "id",
        _meta(val=F.round("val", 2), act=F.round("act", 2)),
    )


def _blocks(seg: DataFrame) -> DataFrame:
    # groups compare the file as a plain value, so a missing file is a value of its own
    return seg.filter("gr_id IS NOT NULL").select("gr_id", F.coalesce("source_file", F.lit("")).alias("source_file"), "id", "timestamp")


def block_members(seg: DataFrame) -> DataFrame:
    """The links within thematic blocks, as one row per segment of a block of two or more: gr_id, source_file, id,
    timestamp, size of the block, and place in it by time (from 0).

    A block of n segments stands for n(n-1)/2 links; they are never written out, whatever its size.
    """
    rows = _blocks(seg)
    sizes = rows.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("size")).filter("size >= 2")
    return o.ordinals(rows.join(sizes, BLOCK), ["timestamp", "id"], "place", BLOCK)


PAIRED_ROWS = 512  # members of a block on each side of one group of the pair join


def weave_blocks(seg: DataFrame) -> DataFrame:
    """The links within blocks, one by one, each from the earlier segment to the later one.

    As many rows as there are links, for readers that want them as edges (walks follow `block_members`). A block is cut
    into slices of about `PAIRED_ROWS` rows, and every two slices meet in a group of their own, so no task pairs a whole
    large block.
    """
    rows = _blocks(seg)
    sizes = rows.groupBy(*BLOCK).agg(F.ceil(F.count(F.lit(1)) / PAIRED_ROWS).cast("int").alias("_k"))
    cut = rows.join(sizes, BLOCK).withColumn("_own", F.pmod(F.xxhash64("id", "timestamp"), F.col("_k")).cast("int"))
    every = F.sequence(F.lit(0), F.col("_k") - 1)
    earlier = cut.select(*BLOCK, "id", F.struct("timestamp", "id").alias("_at"), F.col("_own").alias("_a"), F.explode(every).alias("_b"))
    later = cut.select(*BLOCK, F.col("id").alias("target_id"), F.struct("timestamp", "id").alias("_after"), F.explode(every).alias("_a"), F.col("_own").alias("_b"))
    pairs = earlier.join(later, [*BLOCK, "_a", "_b"]).filter(F.col("_at") < F.col("_after"))
    return _edges(pairs, "MEME_GROUPE", "id", "target_id", _meta(gr_id=F.col("gr_id"), source_file=F.col("source_file")))


def weave_tags(seg: DataFrame, window: int = 10) -> DataFrame:
    """Link each segment to the 10 before it with the same primary tag."""
    tag = F.try_element_at("tags_roget", F.lit(1))
    rows = seg.select("id", "timestamp", tag.alias("tag")).filter("tag IS NOT NULL AND tag <> ''")
    pairs = o.last_n_pairs(rows, ["tag"], ["timestamp", "id"], window, ["id"])
    return _edges(pairs, "TAGS_PARTAGES", "prev_id", "id", _meta(tag=F.col("tag")))


def union_edges(*parts: DataFrame) -> DataFrame:
    """Union with one edge per key; earlier parts win."""
    both = None
    for number, part in enumerate(parts):
        tagged = part.select(*EDGE_COLUMNS, F.lit(number).alias("_part"))
        both = tagged if both is None else both.unionByName(tagged)
    row = F.struct("_part", "poids", F.to_json("metadata"))
    best = both.groupBy(*EDGE_KEY).agg(F.min_by(F.struct("poids", "metadata"), row).alias("e"))
    return best.select(*EDGE_KEY, "e.*")


def _followed(seg: DataFrame, minimum: float) -> DataFrame:
    """One row per thing a rule follows: (kind, entity, timestamp, id, pos, val, act)."""
    kind = "struct<kind:string,entity:string,pos:int,val:double,act:double>"
    row = lambda k, e, p=F.lit(0), v=F.lit(None), a=F.lit(None): F.struct(
        F.lit(k).alias("kind"), e.alias("entity"), p.cast("int").alias("pos"), v.cast("double").alias("val"), a.cast("double").alias("act")
    )
    none = F.array().cast(f"array<{kind}>")

    def names(col: str, link: str) -> Column:
        clean = F.array_distinct(F.filter(F.transform(col, lambda e: F.trim(e)), lambda e: e != ""))
        return F.coalesce(F.transform(clean, lambda e, i: row(link, e, i)), none)

    tag = F.try_element_at("tags_roget", F.lit(1))
    act = F.coalesce(F.nullif(F.col("emotion_activation"), F.lit(0.0)), F.lit(0.5))
    tags = F.when(F.coalesce(tag, F.lit("")) != "", F.array(row("TAGS_PARTAGES", tag))).otherwise(none)
    peaks = F.when(
        F.coalesce(F.abs("emotion_valence") >= minimum, F.lit(False)),
        F.array(row("RESONANCE_EMOTION", F.lit(""), v=F.col("emotion_valence"), a=act)),
    ).otherwise(none)
    rows = F.concat(names("personnes", "LIEN_PERSONNE"), names("projets", "LIEN_PROJET"), tags, peaks)
    return seg.select("id", "timestamp", F.inline(rows))


def weave_sequences(seg: DataFrame, minimum: float = 0.6, distance: float = 0.10, peaks: int = 20, tags: int = 10) -> DataFrame:
    """All edges that follow a sequence (people, projects, tags, emotion peaks) from a single ordered scan.

    The segments are read, sorted and checkpointed once for four rules. The same edges as the single rules give.
    """
    scanned = o.ordered_scan(
        _followed(seg, minimum), ["kind", "entity"], ["timestamp", "id"], {"prev_id": o.lag("id"), "_rn": o.rows_before()}
    )
    chains = scanned.filter("kind IN ('LIEN_PERSONNE', 'LIEN_PROJET') AND prev_id IS NOT NULL AND prev_id <> id")
    chains = chains.groupBy("kind", "prev_id", "id").agg(F.min_by("entity", "pos").alias("entity")).select(
        F.col("prev_id").alias("source_id"), F.col("id").alias("target_id"), F.col("kind").alias("type"), F.lit(1.5).alias("poids"),
        _meta(sujet=F.col("entity")).alias("metadata"),
    )
    # rows within a window meet in buckets of the window's width
    near = scanned.filter("kind IN ('TAGS_PARTAGES', 'RESONANCE_EMOTION')")
    width = F.when(F.col("kind") == "TAGS_PARTAGES", tags).otherwise(peaks)
    bucket = F.floor(F.col("_rn") / width)
    current = near.withColumn("_b", bucket)
    earlier = near.select(
        "kind", "entity", F.col("id").alias("_id"), F.col("val").alias("_val"), F.col("act").alias("_act"), F.col("_rn").alias("_prev"),
        F.explode(F.array(bucket, bucket + 1)).alias("_b"),
    )
    gap = F.col("_rn") - F.col("_prev")
    far = F.sqrt(F.pow(F.col("val") - F.col("_val"), 2) + F.pow(F.col("act") - F.col("_act"), 2))
    is_tag = F.col("kind") == "TAGS_PARTAGES"
    pairs = current.join(earlier, ["kind", "entity", "_b"]).filter((gap >= 1) & (gap <= width) & (is_tag | (far < distance)))
    windows = pairs.select(
        F.col("_id").alias("source_id"), F.col("id").alias("target_id"), F.col("kind").alias("type"),
        F.when(is_tag, lx.LINK_WEIGHTS["TAGS_PARTAGES"]).otherwise(lx.LINK_WEIGHTS["RESONANCE_EMOTION"]).alias("poids"),
        F.when(is_tag, _meta(tag=F.col("entity"))).otherwise(_meta(val=F.round("val", 2), act=F.round("act", 2))).alias("metadata"),
    )
    return chains.unionByName(windows)


def rebuild_graph(seg: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """All woven edges but those within blocks (see `block_members` and `weave_blocks`), plus the stored edges of hand-made types, which a
    rebuild must not lose."""
    # within one rule a key occurs once, and types differ between rules: a plain union has unique keys
    out = weave_sequences(seg)
    if existing is None:
        return out
    kinds = [k for k in lx.LINK_WEIGHTS if k != "LIEN_VERSION"]
    return out.unionByName(existing.filter(~F.col("type").isin(*kinds)).select(*EDGE_COLUMNS))


def graph_counts(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Links by type; those within blocks are counted from the blocks' sizes."""
    counts = edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    if members is None:
        return counts
    # each member has a link to every earlier one
    within = members.agg(F.sum("place").cast("bigint").alias("n")).filter("n > 0").select(F.lit("MEME_GROUPE").alias("type"), "n")
    return counts.unionByName(within).groupBy("type").agg(F.sum("n").cast("bigint").alias("n"))


def _both_ways(edges: DataFrame) -> DataFrame:
    """Each edge seen from both ends: two equi-joins later instead of one join on a CASE.

    A self edge is seen once."""
    there = edges.select(F.col("source_id").alias("here"), F.col("target_id").alias("there"), "type", "poids")
    back = edges.filter("source_id <> target_id").select(
        F.col("target_id").alias("here"), F.col("source_id").alias("there"), "type", "poids"
    )
    return there.unionByName(back)


def store_adjacency(edges: DataFrame, path: str) -> None:
    """Store each edge at both its ends, sorted by node, so that a walk from some nodes skips the other row groups.

    The edges are made once and stored as they come: finding the ranges reads them a second time, and so does the other end."""
    made = stored(edges.select("source_id", "target_id", "type", "poids"), "edges")
    _both_ways(made).repartitionByRange("here").sortWithinPartitions("here").write.mode("overwrite").parquet(path)


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """here, there, type, poids: takes the place of `edges` in `explore_links` and `neighbours`."""
    return spark.read.parquet(path)


READ_BY_LIST = 1_000  # nodes that a scan of the adjacency gets as a list; more are joined


def _seen_from(edges: DataFrame) -> DataFrame:
    return edges if "here" in edges.columns else _both_ways(edges)


def _around(usable: DataFrame, frontier: DataFrame) -> DataFrame:
    """The adjacency of the frontier's nodes (`here`), read by a list of nodes where that is short."""
    nodes = [r[0] for r in frontier.select("here").distinct().limit(READ_BY_LIST + 1).collect()]
    return usable.filter(F.col("here").isin(nodes)) if len(nodes) <= READ_BY_LIST else usable


def neighbours(edges: DataFrame, seg: DataFrame, ids: DataFrame, types: Sequence[str] | None = None, members: DataFrame | None = None) -> DataFrame:
    """Neighbours of a segment set with their attributes; `members` are the blocks of `block_members`."""
    kinds = link_types(types)
    asked = ids.select(F.col("id").alias("here")).distinct()
    hits = _seen_from(edges.filter(F.col("type").isin(*kinds)) if types else edges).join(asked, "here")
    if members is not None and "MEME_GROUPE" in kinds:
        own = members.select(*BLOCK, F.col("id").alias("here")).join(asked, "here")
        within = own.join(members.select(*BLOCK, F.col("id").alias("there")), BLOCK).filter("here <> there").select(
            "here", "there", F.lit("MEME_GROUPE").alias("type"), F.lit(lx.LINK_WEIGHTS["MEME_GROUPE"]).alias("poids")
        )
        hits = hits.unionByName(within)
    return hits.join(
        seg.select(F.col("id").alias("there"), "timestamp", "resume_texte", "auteur"), "there"
    ).select(F.col("here").alias("id"), F.col("there").alias("linked_id"), F.col("type").alias("link_type"), "poids", "timestamp", "resume_texte", "auteur")


def link_types(types: Sequence[str] | None) -> list[str]:
    """Valid types among the asked ones; none asked means all."""
    if not types:
        return list(lx.LINK_WEIGHTS)
    valid = [t.upper() for t in types if t.upper() in lx.LINK_WEIGHTS]
    if not valid:
        raise ValueError(f"no valid link type; known: {list(lx.LINK_WEIGHTS)}")
    return valid


def explore_links(
    edges: DataFrame, seg: DataFrame, starts: DataFrame, types: Sequence[str] | None = None, depth: int = 1,
    max_results: int = 10, members: DataFrame | None = None, cut: int | None = None,
) -> DataFrame:
    """Breadth-first walk of `depth` hops from many starts (column `id`) at once.

    A node is reported once per start, at its first depth, with its heaviest edge; heaviest first, then oldest.
    `members` are the blocks of `block_members`. A block is followed at the first hop that touches it: all its members
    are reached then. All links of a block weigh the same and older members come first, so at the last hop only the first
    `max_results` members that aren't known yet can be reported, and no more are read, however large the block is.
    `edges` may be a stored adjacency (`read_adjacency`): the first hops then read what lies around their nodes only.
    Starts that do not exist give no rows (see `missing_starts`). `cut` keeps the start of the summaries (150 in the contract).
    """
    if depth < 1 or max_results < 1:
        raise ValueError("depth and max_results must be at least 1")
    kinds = link_types(types)
    usable = _seen_from(edges.filter(F.col("type").isin(*kinds)))
    if "MEME_GROUPE" not in kinds:
        members = None
    attrs = seg.select(F.col("id").alias("node"), "timestamp", "resume_texte", "auteur")
    level = starts.select(F.col("id").alias("start")).distinct().join(attrs.select(F.col("node").alias("start")), "start", "left_semi")
    frontier = level.withColumn("here", F.col("start"))
    found, visited, followed = None, frontier.select("start", F.col("here").alias("node")), None
    best = F.min(F.struct((-F.col("poids")).alias("w"), "type"))
    for d in range(1, depth + 1):
        hop = frontier.join(_around(usable, frontier), "here").select("start", F.col("there").alias("node"), "poids", "type")
        if members is not None:
            own = members.select(*BLOCK, F.col("id").alias("here"))
            touched = frontier.join(own, "here").groupBy("start", *BLOCK).agg(F.count(F.lit(1)).alias("known"))
            if followed is not None:
                touched = touched.join(followed, ["start", *BLOCK], "left_anti")
            reach = members.select(*BLOCK, F.col("id").alias("node"), "place")
            reached = touched.join(reach, BLOCK)
            if d == depth:
                reached = reached.filter(F.col("place") < max_results + F.col("known"))
            hop = hop.unionByName(reached.select("start", "node", F.lit(lx.LINK_WEIGHTS["MEME_GROUPE"]).alias("poids"), F.lit("MEME_GROUPE").alias("type")))
            if d < depth:
                blocks = touched.select("start", *BLOCK)
                followed = blocks if followed is None else followed.unionByName(blocks)
        hop = hop.groupBy("start", "node").agg(best.alias("e")).select("start", "node", (-F.col("e.w")).alias("poids"), F.col("e.type").alias("type"))
        hop = hop.join(visited, ["start", "node"], "left_anti").withColumn("depth", F.lit(d)).join(attrs, "node")
        if d < depth:
            hop = materialise(hop)  # used three times below
        found = hop if found is None else found.unionByName(hop)
        frontier = hop.select("start", F.col("node").alias("here"))
        visited = visited.unionByName(hop.select("start", "node"))
    rank = F.row_number().over(W.partitionBy("start").orderBy(F.desc("poids"), "timestamp", "node"))
    summary = F.coalesce("resume_texte", F.lit("N/A"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= max_results).select(
        F.col("start").alias("id"), F.col("node").alias("linked_id"), F.col("type").alias("link_type"), "poids", "depth",
        "timestamp", (F.substring(summary, 1, cut) if cut else summary).alias("resume_texte"), "auteur", "rank",
    )


def missing_starts(starts: DataFrame, seg: DataFrame) -> DataFrame:
    return starts.select("id").distinct().join(seg.select("id"), "id", "left_anti")


TYPED_LINKS = ["CORRIGE_PAR", "TRAJECTOIRE", "GENEALOGIE", "EVOLUE_VERS"]


def typed_links(df: DataFrame, kind: str | None = None, weight: float = 1.0) -> DataFrame:
    """Edges of a correction or evolution (source_id, target_id, metadata); without `kind` the rows carry `type`."""
    typed = df.withColumn("type", F.lit(kind)) if kind else df
    meta = F.col("metadata") if "metadata" in df.columns else F.create_map().cast("map<string,string>")
    return typed.filter(F.col("type").isin(*TYPED_LINKS) & (F.col("source_id") != F.col("target_id"))).select(
        "source_id", "target_id", "type", F.lit(weight).alias("poids"), meta.alias("metadata")
    )


def latest_version(edges: DataFrame, ids: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Newest version of each segment: follow LIEN_VERSION to its end.

    Pointer jumping over the version edges only: each round doubles the length that is followed, so a chain of
    n versions needs log2(n) joins. Several successors of one segment: the largest id wins.
    """
    nxt = edges.filter("type = 'LIEN_VERSION' AND source_id <> target_id").groupBy(F.col("source_id").alias("id")).agg(F.max("target_id").alias("to"))
    jumps = materialise(nxt)
    for _ in range(max_rounds):
        further = jumps.select(F.col("id").alias("to"), F.col("to").alias("_next"))
        joined = materialise(jumps.join(further, "to", "left").select("id", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("moved")))
        jumps = joined.select("id", "to")
        if joined.filter("moved").isEmpty():
            break
    else:
        raise ValueError("version links form a cycle")
    return ids.select("id").join(jumps, "id", "left").select("id", F.coalesce("to", "id").alias("latest_id"))

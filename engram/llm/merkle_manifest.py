"""Merkle manifest of a dataset: a tree of hashes per source, a tree over the sources, and a proof for every document.

A document's leaf is the hash of its fields, each with its length in bytes. Per source the leaves are ranked by id, and
every node carries the interval of leaf ranks it covers, so the tree needs no pointers:

1. Ranks come from an ordered scan in sorted runs, so a source that holds a third of all rows is spread over many tasks.
2. Level by level, nodes whose intervals fall into the same bucket of 16^level ranks become one node with the interval of
   the bucket. A bucket has 16 children at most, so no group is large, and each level has a sixteenth of the rows below.
3. From the root down, nodes meet the parent whose interval contains theirs (joined by source and bucket of that level).
   What the parent's interval has before and after the node's own are its siblings; with those of the parent they are its
   path. Leaves meet their parents once, by the same join, and get their whole path.

A source with a single node at some level has reached its sub-root and passes through the levels above unchanged. Folding
a leaf along its path gives the root; a document whose text was changed gives another one.

Null fields count as `-`. A null source is a group of its own and comes first; null ids come first within a source and are
never tampered with. Rows that share an id are ordered by their leaves; fully equal rows are leaves of their own. An empty table
gives no rows; other columns are ignored. Everything is DataFrame functions; only hashes and ranks are moved, no texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import LOWERED, UPPER
from engram.operators.ordered import ordinals
from engram.session import materialise

FAN = 16


def digest(*parts: Column) -> Column:
    """SHA-256 of the joined strings, lower-case hex."""
    return F.sha2(F.concat(*parts), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """Leaf of a document with this text."""
    return digest(*[_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], _field(text))


def tampered(every: int = 5) -> Column:
    """Whether a document's text is changed in the trial: one in `every` ids, by checksum."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))


def leaves(docs: DataFrame, every: int = 5) -> DataFrame:
    """doc_id, grp (the source as a text that sorts like it, null first), leaf, changed (the leaf after tampering, null without)."""
    docs = docs.select("doc_id", "source", "lang", "n_chars", F.col("text").cast("string").alias("text"))
    folded = F.when(tampered(every), leaf(F.translate("text", UPPER, LOWERED)))
    return docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("grp"), leaf(F.col("text")).alias("leaf"), folded.alias("changed"))


def _height(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def grow(nodes: DataFrame, most: int) -> list[DataFrame]:
    """All levels above `nodes` (grp, lo, hi, hash), lowest first, each with the `kids` (lo, hi, hash) of its nodes and whether
    the node only passes its child through (`same`). `most`: leaves of the largest group."""
    levels = []
    for k in range(1, _height(most) + 1):
        up = nodes.groupBy("grp", (F.shiftright("lo", 4 * k)).alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "hash"))).alias("kids"))
        # the first bucket holds one node only if the group has no other
        same = (F.col("bucket") == 0) & (F.size("kids") == 1)
        up = up.select(
            "grp", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), "kids", same.alias("same"),
            F.when(same, F.col("kids")[0]["hash"]).otherwise(digest(F.array_join("kids.hash", ""))).alias("hash"),
        )
        levels.append(materialise(up))
        nodes = levels[-1].select("grp", "lo", "hi", "hash")
    return levels


PATH = "array<struct<l:string,r:string>>"


def attach(nodes: DataFrame, parents: DataFrame, level: int, carried: list[str]) -> DataFrame:
    """The nodes with the path to their root: siblings before (l) and after (r) at every level from their own up.

    `parents` are of the given level and have `kids`, `same`, `path` and the `carried` columns, which the nodes take over.
    """
    up = parents.select(
        F.col("grp").alias("_grp"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("kids").alias("_kids"), F.col("same").alias("_same"), F.col("path").alias("_up"), *carried,
        F.shiftright("lo", 4 * level).alias("_bucket"),
    )
    inside = (F.col("grp") == F.col("_grp")) & (F.shiftright("lo", 4 * level) == F.col("_bucket")) & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
    before = F.array_join(F.transform(F.filter("_kids", lambda x: x["hi"] < F.col("lo")), lambda x: x["hash"]), "")
    after = F.array_join(F.transform(F.filter("_kids", lambda x: x["lo"] > F.col("hi")), lambda x: x["hash"]), "")
    own = F.array(F.struct(before.alias("l"), after.alias("r"))).cast(PATH)
    return nodes.join(up, inside).withColumn("path", F.when(F.col("_same"), F.col("_up")).otherwise(F.concat(own, "_up"))).drop(
        "_grp", "_lo", "_hi", "_bucket", "_up", "_kids", "_same")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, s: digest(s["l"], h, s["r"]))


def proof(path: Column) -> Column:
    """Siblings of all levels in a row."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")


def _down(levels: list[DataFrame], top: DataFrame, carried: list[str]) -> list[DataFrame]:
    """Every level with paths; `top` has the nodes of the last one with `path` and the carried columns."""
    out = [top]
    for k in range(len(levels) - 1, 0, -1):
        out.insert(0, materialise(attach(levels[k - 1], out[0], k + 1, carried)))
    return out


def manifest(docs: DataFrame, every: int = 5) -> DataFrame:
    """doc_id, leaf, changed (leaf after tampering, null without), subroot, root, path (from the leaf's level to the root)."""
    # cut first: the scan samples its input, and texts should be hashed once
    ranked = ordinals(materialise(leaves(docs, every)), ["doc_id", "leaf"], "lo", ["grp"]).withColumn("hi", F.col("lo"))
    ranked = materialise(ranked)
    most = ranked.agg(F.max("lo")).first()[0]
    if most is None:
        return ranked.select("doc_id", "leaf", "changed", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"), F.array().cast(PATH).alias("path"))
    # the last level has one node per source
    trees = grow(ranked.select("grp", "lo", "hi", F.col("leaf").alias("hash")), most + 1)
    subroots = (trees[-1] if trees else ranked.select("grp", F.col("leaf").alias("hash"))).select(F.col("grp").alias("source"), F.col("hash").alias("subroot"))

    sources = materialise(ordinals(subroots, ["source"], "lo").select("source", "subroot", F.lit("").alias("grp"), "lo", F.col("lo").alias("hi")))
    crown = grow(sources.select("grp", "lo", "hi", F.col("subroot").alias("hash")), sources.agg(F.max("lo")).first()[0] + 1)
    if crown:
        tip = crown[-1].withColumn("path", F.array().cast(PATH)).withColumn("root", F.col("hash"))
        sources = attach(sources, _down(crown, tip, ["root"])[0], 1, ["root"])
    else:
        sources = sources.withColumn("path", F.array().cast(PATH)).withColumn("root", F.col("subroot"))
    sources = materialise(sources.select(F.col("source").alias("_source"), "subroot", "root", "path"))

    if not trees:
        return ranked.join(sources, F.col("grp") == F.col("_source")).select("doc_id", "leaf", "changed", "subroot", "root", "path")
    tips = trees[-1].join(sources, F.col("grp") == F.col("_source")).drop("_source")
    carried = ["subroot", "root"]
    lowest = _down(trees, tips, carried)[0]
    return attach(ranked, lowest, 1, carried).select("doc_id", "leaf", "changed", *carried, "path")


def verify(docs: DataFrame, every: int = 5) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (of the tampered leaf, where there is one), verified."""
    rows = manifest(docs, every).withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

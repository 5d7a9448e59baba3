"""Graph properties and plan shapes."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from engram.operators import graph
from engram.plans.registry import Data

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def seg(spark, small):
    return Data(spark, small).segments.cache()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def small_segments(spark, rows):
    """rows: (id, persons, valence, activation, block, tags)"""
    data = [(i, T0 + timedelta(hours=i), "f", p, p, v, a, g, t) for i, p, v, a, g, t in rows]
    return spark.createDataFrame(
        data, "id LONG, timestamp TIMESTAMP, source_file STRING, personnes ARRAY<STRING>, projets ARRAY<STRING>, emotion_valence DOUBLE, "
        "emotion_activation DOUBLE, gr_id LONG, tags_roget ARRAY<STRING>",
    )


def edges(df):
    return sorted((r["source_id"], r["target_id"]) for r in df.collect())


def test_entity_chain_by_hand(spark):
    s = small_segments(spark, [
        (1, ["Ana", " Bo "], 0.0, 0.0, None, []), (2, ["Bo", "", "Bo"], 0.0, 0.0, None, []), (3, ["Ana", "Bo"], 0.0, 0.0, None, []), (4, ["ana"], 0.0, 0.0, None, None),
    ])
    out = graph.weave_entities(s)
    assert edges(out) == [(1, 2), (1, 3), (2, 3)]
    assert {r["metadata"]["sujet"] for r in out.filter("source_id = 1 AND target_id = 3").collect()} == {"Ana"}


def test_null_and_zero_activation_count_as_half(spark):
    s = small_segments(spark, [(1, [], 0.7, None, None, []), (2, [], 0.7, 0.0, None, []), (3, [], 0.7, 0.5, None, []), (4, [], 0.5, 0.5, None, [])])
    assert edges(graph.weave_emotions(s)) == [(1, 2), (1, 3), (2, 3)]


def test_blocks_of_any_size_are_member_rows(spark):
    s = small_segments(spark, [(i, [], 0.0, 0.0, 1 if i < 300 else 2, []) for i in range(303)] + [(303, [], 0.0, 0.0, 3, [])])
    members = graph.block_members(s).cache()
    assert members.count() == 303 and sorted(r["place"] for r in members.filter("gr_id = 2").collect()) == [0, 1, 2]
    none = graph.weave_tags(s)
    assert {r["type"]: r["n"] for r in graph.graph_counts(none, members).collect()} == {"MEME_GROUPE": 300 * 299 // 2 + 3}
    start = spark.createDataFrame([(3,), (301,), (303,)], "id LONG")
    s2 = s.withColumns({"resume_texte": F.lit("x"), "auteur": F.lit("human")})
    assert graph.neighbours(none, s2, start, members=members).count() == 299 + 2
    found = graph.explore_links(none, s2, start, members=members, max_results=200).collect()
    assert sorted(r["linked_id"] for r in found if r["id"] == 3) == [i for i in range(201) if i != 3]
    assert sorted(r["linked_id"] for r in found if r["id"] == 301) == [300, 302]


def test_last_hop_reads_only_what_can_be_reported(spark):
    """Start 0 is tied to 5 and 7 of a block of 100: at the second hop the oldest unknown members come first."""
    s = small_segments(spark, [(i, [], 0.0, 0.0, 1 if i > 0 else None, []) for i in range(101)])
    s2 = s.withColumns({"resume_texte": F.lit("x"), "auteur": F.lit("human")})
    e = spark.createDataFrame([(0, 5, "AUTRE", 1.0), (0, 1, "AUTRE", 1.0), (3, 0, "AUTRE", 1.0)], "source_id LONG, target_id LONG, type STRING, poids DOUBLE")
    e = e.withColumn("type", F.lit("TAGS_PARTAGES"))
    found = graph.explore_links(e, s2, spark.createDataFrame([(0,)], "id LONG"), depth=2, max_results=6, members=graph.block_members(s))
    assert [(r["linked_id"], r["depth"]) for r in found.orderBy("rank").collect()] == [(2, 2), (4, 2), (6, 2), (7, 2), (8, 2), (9, 2)]


def test_single_scan_equals_single_rules(seg):
    cols = ["source_id", "target_id", "type", "poids"]
    one = graph.weave_sequences(seg).select(cols)
    four = graph.weave_entities(seg).unionByName(graph.weave_entities(seg, "projets", "LIEN_PROJET")).unionByName(
        graph.weave_emotions(seg)).unionByName(graph.weave_tags(seg)).select(cols)
    assert one.exceptAll(four).isEmpty() and four.exceptAll(one).isEmpty()


def test_keys_are_unique(seg):
    out = graph.rebuild_graph(seg)
    assert out.groupBy("source_id", "target_id", "type").count().filter("count > 1").isEmpty()


def test_explore_depth_is_honoured(spark):
    s = small_segments(spark, [(i, [], 0.0, 0.0, None, []) for i in range(9)]).withColumns({"resume_texte": F.lit("x"), "auteur": F.lit("human")})
    e = spark.createDataFrame([(i, i + 1, "TAGS_PARTAGES", 1.3) for i in range(8)], "source_id LONG, target_id LONG, type STRING, poids DOUBLE")
    one = spark.createDataFrame([(0,)], "id LONG")
    assert sorted((r["linked_id"], r["depth"]) for r in graph.explore_links(e, s, one, depth=5, max_results=500).collect()) == [(i, i) for i in range(1, 6)]
    with pytest.raises(ValueError):
        graph.explore_links(e, s, one, depth=0)


def test_unknown_link_type(seg):
    with pytest.raises(ValueError):
        graph.link_types(["nothing"])


def test_missing_starts(spark, seg):
    assert [r["id"] for r in graph.missing_starts(spark.createDataFrame([(0,), (-5,)], "id LONG"), seg).collect()] == [-5]


def test_neighbours_have_no_cartesian_product(seg):
    plan = plan_of(graph.neighbours(graph.weave_tags(seg), seg, seg.select("id")))
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_scans_move_rows_once(seg):
    """Behind the sorted runs only the carry table is windowed, and nothing is dealt out by run."""
    plan = plan_of(graph.weave_entities(seg))
    assert "hashpartitioning(_run" not in plan
    windows = [k for k, line in enumerate(plan.splitlines()) if "Window" in line]
    carry = next(k for k, line in enumerate(plan.splitlines()) if "BroadcastExchange" in line)
    assert windows and min(windows) > carry


def test_version_chain(spark):
    e = spark.createDataFrame([(1, 2, "LIEN_VERSION"), (2, 3, "LIEN_VERSION"), (3, 9, "LIEN_VERSION"), (4, 5, "AUTRE")], "source_id LONG, target_id LONG, type STRING")
    ids = spark.createDataFrame([(i,) for i in (1, 3, 4, 9)], "id LONG")
    assert {r["id"]: r["latest_id"] for r in graph.latest_version(e, ids).collect()} == {1: 9, 3: 9, 4: 4, 9: 9}


def test_walk_on_stored_edges(spark, seg, tmp_path):
    """A stored adjacency gives the walk of the plain edges, and the nodes asked for reach the scan."""
    edges = graph.rebuild_graph(seg)
    graph.store_adjacency(edges, str(tmp_path / "a"))
    stored = graph.read_adjacency(spark, str(tmp_path / "a"))
    starts = seg.select("id").orderBy("id").limit(3)
    shown = lambda e, depth: sorted(map(tuple, graph.explore_links(e, seg, starts, depth=depth).select("id", "linked_id", "link_type", "poids", "depth", "rank").collect()))
    assert shown(stored, 1) == shown(edges, 1) and shown(stored, 3) == shown(edges, 3)
    plan = plan_of(graph.explore_links(stored, seg, starts, depth=1))
    assert re.search(r"here#\d+L? IN \(", plan) and "PushedFilters" in plan
    with_blocks = lambda e: sorted(map(tuple, graph.neighbours(e, seg, starts, members=graph.block_members(seg)).select("id", "linked_id", "link_type").collect()))
    assert with_blocks(stored) == with_blocks(edges)


def test_stored_edges_are_made_once(spark, tmp_path):
    """Neither the other end nor the search for ranges makes the edges again."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    edges = spark.range(100).selectExpr("id AS source_id", "id + 1 AS target_id", "'LIEN_PROJET' AS type", "1.5D AS poids", "CAST(map() AS map<string,string>) AS metadata")
    graph.store_adjacency(edges.mapInArrow(count, edges.schema), str(tmp_path / "a"))
    got = graph.read_adjacency(spark, str(tmp_path / "a"))
    assert made.value == 100 and got.count() == 200 and got.filter("abs(here - there) = 1").count() == 200


def test_blocks_are_listed_as_pairs(spark, monkeypatch):
    """Every link once, from the earlier to the later segment, however many slices a block has."""
    monkeypatch.setattr(graph, "PAIRED_ROWS", 7)
    s = small_segments(spark, [(i, [], 0.0, 0.0, 1 if i < 40 else None, []) for i in range(45)] + [(50, [], 0.0, 0.0, 2, []), (60, [], 0.0, 0.0, 2, [])])
    out = graph.weave_blocks(s)
    assert edges(out) == sorted([(a, b) for b in range(40) for a in range(b)] + [(50, 60)])
    assert {(r["type"], r["poids"]) for r in out.collect()} == {("MEME_GROUPE", 1.8)}


@pytest.mark.parametrize("name", ["graph3_block_edges", "graph6_rebuild"])
def test_queries_list_block_links(spark, small, name):
    from engram.plans import all_checks, all_queries

    kinds = all_queries()[name](spark, small).filter("type = 'MEME_GROUPE'")
    assert kinds.count() > 0 and "<> 'MEME_GROUPE'" not in all_checks()[name]

"""Golden rows and refusals."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from engram.functions import dates, records, scores, text as tx, vector as vec
from engram.operators import annotate as ann, embeddings as emb, filters as flt, joins, listings, mutations as mut, profiles, search, tables, windows as win
from engram.sources import exports, segments as src, sinks, sql as guarded


def one(spark, expr, **cols):
    df = spark.range(1)
    for name, value in cols.items():
        df = df.withColumn(name, F.lit(value))
    return df.select(expr.alias("x")).first()["x"]


# weights and vectors of a worked example: a tense and a calm segment
WEIGHTS = {"emotion": 0.5, "tags_roget": 0.3, "timestamp": 0.15, "personnes": 0.05, "resume_texte": 0.0}
TENSE = {"1": -0.2, "2": 0.6, "4": 0.7, "5": 0.4, "6": 0.7, "7": 0.6, "61": 1.0, "62": 1.0, "63": 1.0, "64": 1.0, "65": 1.0, "66": 1.0}
CALM = {"1": 0.6, "2": 0.7, "5": 0.8, "6": 0.4, "7": 0.3, "61": 1.0, "62": 1.0, "64": 1.0, "65": 1.0, "66": 1.0}


@pytest.mark.parametrize("vector,want", [(TENSE, 3.2), (CALM, 2.9)])
def test_resonance(spark, vector, want):
    assert one(spark, scores.resonance(vec.json_vector(F.lit(json.dumps(vector))), scores.mask_of(WEIGHTS))) == pytest.approx(want)


@pytest.mark.parametrize("a,b,want", [
    ("01-0010-0020", "01-0010-0020", 1.0), ("01-0010-0020", "01-0010-0070", 0.85), ("01-0010-0020", "01-0060-0020", 0.45),
    ("01-0010-0020", "02-0010-0020", 0.1), ("01-0010", "01-0010-0020", 0.1), ("01-0010-00x0", "01-0010-0020", 0.1), ("01-0010-0001", "01-0010-9000", 0.7),
])
def test_tag_proximity(spark, a, b, want):
    assert one(spark, scores.tag_proximity(F.lit(a), F.lit(b))) == pytest.approx(want)


@pytest.mark.parametrize("tag,want", [
    ("01-0010-0020", "01-0010-0020"), ("1-10-20", "01-0010-0020"), ("1-2-3-4", "01-0023-0034"), ("1-2-3-4-5-6", "01-0002-0003"), ("12", None), ("1-2-3-4-5", None),
])
def test_fix_tag(spark, tag, want):
    assert one(spark, scores.fix_tag(F.lit(tag))) == want


def test_future_segment_scores_above_one(spark):
    late, now = F.lit("2024-01-11").cast("timestamp"), F.lit("2024-01-01").cast("timestamp")
    assert one(spark, scores.time_score(late, now)) == pytest.approx(1 + 10 / 365)


@pytest.mark.parametrize("size,want", [(None, "?"), (0, "?"), (512, "512 o"), (1536, "1.5 Ko"), (5 * 1024**2, "5.0 Mo"), (3 * 1024**3, "3.0 Go"), (2 * 1024**4, "2.0 To")])
def test_human_size(spark, size, want):
    from engram.functions.formats import human_size

    assert one(spark, human_size(F.lit(size).cast("long"))) == want


def test_business_day(spark):
    day = lambda t: str(one(spark, dates.business_day(F.lit(t).cast("timestamp"))))
    assert day("2024-01-02 07:59:59") == "2024-01-01" and day("2024-01-02 08:00:00") == "2024-01-02"


def test_scope():
    now = datetime(2024, 3, 31).date()
    assert dates.resolve_scope(now, "week") == ("2024-03-24", "2024-03-31")
    assert dates.resolve_scope(now, "week", days=2) == ("2024-03-29", "2024-03-31")
    assert dates.resolve_scope(now, "week", start="2020-01-01") == ("2020-01-01", None)
    assert dates.resolve_scope(now, "anything") == (None, None)


@pytest.mark.parametrize("sql,ok", [
    ("SELECT count(*) FROM metadata", True), ("select id FROM metadata WHERE resume_texte LIKE '%delete%'", True),
    ("WITH a AS (SELECT id FROM metadata) SELECT count(*) FROM a", True), ("DROP TABLE metadata", False), ("DELETE FROM metadata", False),
    ("INSERT INTO metadata SELECT 1", False), ("SELECT * FROM other", False), ("SELECT 1", False), ("SELECT id FROM metadata WHERE id IN (SELECT id FROM other)", False),
    ("CREATE TABLE x AS SELECT * FROM metadata", False), ("not sql", False),
    ("SELECT * FROM metadata WHERE id IN (SELECT max(id) FROM metadata)", True), ("SELECT m.id FROM metadata m, range(3)", True),
    ("SELECT m.id FROM metadata m JOIN (VALUES (1)) AS v(id) ON m.id = v.id ORDER BY 1 LIMIT 3;", True),
    ("SELECT * FROM IDENTIFIER('sec' || 'ret')", False), ("SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM metadata", False),
    ("SELECT try_reflect('java.lang.System', 'getProperty', 'user.home') FROM metadata", False),
    ("SELECT *, (SELECT count(*) FROM (WITH secret AS (SELECT 1 AS x) SELECT * FROM secret)) FROM secret, metadata", False),
    ("SELECT * FROM metadata) UNION SELECT * FROM (SELECT id, 'x' FROM secret", False), ("SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`", False),
])
def test_guarded_sql(spark, sql, ok):
    views = {"metadata": spark.createDataFrame([(1, "x")], "id LONG, resume_texte STRING")}
    spark.range(3).createOrReplaceTempView("secret")
    spark.range(7).createOrReplaceTempView("metadata")
    if ok:
        assert guarded.execute_sql(spark, sql, views, "metadata").count() >= 0
    else:
        with pytest.raises(guarded.RefusedSql):
            guarded.execute_sql(spark, sql, views, "metadata")
    assert spark.table("metadata").count() == 7


@pytest.mark.parametrize("bad,good", [
    ("{'a': 'x', 'n': True,}", {"a": "x", "n": "true"}), ('{"a": "x"\n"n": None}', {"a": "x", "n": None}), ('{a: "x" /* c */, n: 1}', {"a": "x", "n": "1"}),
    ('{"a": "x", "n": "1"', {"a": "x", "n": "1"}), ('{"a": "http://x"}', {"a": "http://x", "n": None}),
])
def test_repair_json(spark, bad, good):
    df = spark.createDataFrame([(bad,)], "t STRING")
    fixed, broken = records.parse_or_quarantine(df, "t", "a STRING, n STRING")
    assert fixed.first()["record"].asDict() == good and broken.isEmpty()


def test_cut_off_list_keeps_whole_objects(spark):
    df = spark.createDataFrame([('[{"a": "x"}, {"a": "y"}, {"a": "z',)], "t STRING")
    assert [r.a for r in records.parse_or_quarantine(df, "t", "array<struct<a:string>>")[0].first()["record"]] == ["x", "y"]


def test_parse_exchanges(spark):
    log = (
        "0|[SOURCE:chat][2024-01-01T10:00:00Z] User : bonjour le monde [2024-01-01T09:00:00Z] cite\n"
        "12|[2024-01-01T10:01:00.000Z] assistant : réponse\nsur deux lignes [SOURCE:"
    )
    rows = src.parse_exchanges(spark.createDataFrame([("a.txt", log), ("b.txt", " sans marque ")], "file_name STRING, text STRING")).orderBy("file_name", "no").collect()
    assert [(r["file_name"], r["source"], r["auteur"]) for r in rows] == [("a.txt", "chat", "human"), ("a.txt", None, "assistant"), ("b.txt", None, "human")]
    assert rows[0]["text"] == "bonjour le monde «2024-01-01T09:00:00Z» cite" and rows[1]["text"] == "réponse\nsur deux lignes"


def test_tree_export_from_json(spark, tmp_path):
    node = lambda parent, children, role, time, text, hidden=False: {
        "parent": parent, "children": children,
        "message": {"author": {"role": role}, "create_time": time, "content": {"content_type": "text", "parts": [text, ""]}, "metadata": {"is_visually_hidden_from_conversation": hidden}},
    }
    export = [{"title": "t", "create_time": 1.0, "mapping": {
        "r": {"parent": None, "children": ["a"], "message": None}, "a": node("r", ["b", "h"], "user", 1704100000.0, "un"), "b": node("a", ["c"], "assistant", 1704100060.0, "deux turn0search1"),
        "c": node("b", [], "system", 1704100070.0, "x"), "h": node("a", [], "user", 1704100080.0, "caché", True), "lost": node("gone", [], "user", 1704100090.0, "perdu"),
    }}]
    path = tmp_path / "export.json"
    path.write_text(json.dumps(export))
    rows = exports.read_tree_export(spark, str(path)).orderBy("timestamp").collect()
    assert [(r["auteur"], r["text"]) for r in rows] == [("human", "un"), ("assistant", "deux")]
    after = exports.read_tree_export(spark, str(path), datetime.fromtimestamp(1704100000)).collect()
    assert [r["text"] for r in after] == ["deux"]


def test_pillar_rules(spark):
    new = spark.createDataFrame([(1, "ok fait", "valeur", 2), (2, "x", "VALEUR", 2), (3, "bon", "AUTRE", 2), (4, "bon", "VALEUR", 9)], "id LONG, fait STRING, categorie STRING, importance INT")
    good, bad = mut.valid_pillars(new)
    assert [r["id"] for r in good.collect()] == [1] and bad.count() == 3


def test_swap_replaces_a_table_computed_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    sinks.swap(spark.read.parquet(path).filter("id > 1"), path, spark)
    assert spark.read.parquet(path).count() == 3


def test_chunks_prefer_newlines_and_lose_nothing(spark):
    text = "a b c d e f\ng h i j k l m n o p"
    rows = win.chunk_tokens(spark.createDataFrame([(1, text)], "id LONG, text STRING"), size=8).orderBy("chunk_index").collect()
    assert "".join(r["content"] for r in rows) == text
    assert rows[0]["content"] == "a b c d e f" and max(r["n_tokens"] for r in rows) <= 8


def test_context_ends_at_first_overflow(spark):
    ranked = spark.createDataFrame([(1, 1, "x" * 10), (1, 2, "y" * 100), (1, 3, "z")], "query_id LONG, rank INT, block STRING")
    out = win.format_context(win.context_budget(ranked, max_tokens=20)).first()["context"]
    assert "x" in out and "y" not in out and "z" not in out and win.TRUNCATED in out


def test_search_text_positions(spark):
    docs = spark.createDataFrame([(1, "Jérémie et jeremy\nJEREMIE")], "id LONG, text STRING")
    rows = flt.search_text(docs, "jerem*").orderBy("position").collect()
    assert [(r["position"], r["matched"]) for r in rows] == [(11, "jeremy"), (18, "JEREMIE")]


def test_globs(spark):
    names = ["a/b.txt", "a/x/b.txt", "a/x/y/b.txt", "a/b1.txt", "a/bz.txt", "c"]
    inv = spark.createDataFrame([(n,) for n in names], "path STRING")
    match = lambda p: sorted(r[0] for r in listings.glob_filter(inv, p).collect())
    assert match("a/**/b.txt") == ["a/b.txt", "a/x/b.txt", "a/x/y/b.txt"]
    assert match("a/b[0-9].txt") == ["a/b1.txt"] and match("a/b[!0-9].txt") == ["a/bz.txt"] and match("?") == ["c"]


def test_load_refuses_too_many_bad_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1,a\nzz,b\n3\n")
    with pytest.raises(ValueError):
        tables.load_table(spark, str(tmp_path), "csv", "i INT, s STRING")
    assert tables.load_table(spark, str(tmp_path), "csv", "i INT, s STRING", max_bad=2).count() == 1
    assert tables.load_table(spark, str(tmp_path), "csv", "i INT, s STRING", max_bad=1, jagged=True).count() == 2
    with pytest.raises(ValueError):
        tables.load_table(spark, str(tmp_path), "avro")


def test_evolving_append_needs_permission(spark):
    a, b = spark.range(2).select("id"), spark.range(2).withColumn("n", F.lit("x"))
    with pytest.raises(ValueError):
        tables.append_evolve(a, b)
    assert tables.append_evolve(a, b, allow_new=True).count() == 4


def test_csv_extract_refuses_nested(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.extract(spark.range(1).withColumn("a", F.array("id")), str(tmp_path / "o"), "csv")


def test_failed_annotation_stays_visible(spark):
    def broken(texts):
        raise RuntimeError("model down")

    rows = ann.annotate(spark.createDataFrame([(1, "x")], "id LONG, text STRING"), broken).collect()
    assert rows[0]["ok"] is False and rows[0]["confidence_score"] == 0.5


def test_exchange_table_function(spark):
    ann.register_functions(spark)
    out = spark.sql("SELECT auteur, text FROM split_exchanges('[2024-01-01T10:00:00Z] user : a [2024-01-01T10:00:01Z] assistant : b')").collect()
    assert [tuple(r) for r in out] == [("human", "a"), ("assistant", "b")]


def test_query_features(spark):
    q = spark.createDataFrame([(1, "Que dit Marie de Python cette semaine 04-0110-0010 ?")], "query_id LONG, text STRING")
    row = profiles.featurise_queries(q, datetime(2024, 1, 31)).first()
    assert row["personnes"] == ["Marie"] and row["mots_cles"] == ["dit", "python", "semaine"] and row["tags_explicites"] == ["04-0110-0010"]
    assert row["date_debut"] == datetime(2024, 1, 24) and row["domaine"] == "technique"


def test_too_many_queries_are_refused(spark):
    with pytest.raises(ValueError):
        search.score_pairs(spark.range(1), [], datetime(2024, 1, 1))


def test_hierarchy_refuses_cycles(spark):
    p = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2)], "id LONG, nom STRING, parent_id LONG")
    assert {r["id"]: r["chemin"] for r in joins.hierarchy(p).collect()} == {1: "a", 2: "a > b", 3: "a > b > c"}


def test_embeddings(spark):
    words = [["alpha", "beta", "gamma", "delta"], ["alpha", "beta", "gamma", "omega"]] * 20
    corpus = spark.createDataFrame([(i, 0, w) for i, w in enumerate(words)], "doc_id INT, par_no INT, tokens ARRAY<STRING>")
    phrases = emb.detect_phrases(corpus, threshold=0.1)
    joined = emb.apply_phrases(corpus, phrases.filter("a = 'alpha'"), ["doc_id", "par_no"]).first()["tokens"]
    assert joined[0] == "alpha_beta" and len(joined) == 3
    vectors = emb.vectors_table(emb.train_word2vec(corpus, size=8, epochs=1, partitions=2)).cache()
    assert emb.model_stats(vectors).first()["dimensions"] == 8
    near = emb.neighbour_table(vectors, vectors.select("term"), n=2, minimum=-1.0)
    exact = emb.most_similar(vectors, ["alpha"], 2, -1.0).select("term").collect()
    assert [r[0] for r in near.filter("source = 'alpha'").orderBy("rank").select("term").collect()] == [r[0] for r in exact]
    asked = spark.createDataFrame([(1, "Alpha et gamma")], "query_id LONG, text STRING")
    out = emb.expand_queries(asked, near).collect()
    assert out and not {"alpha", "gamma"} & {r["term"] for r in out}


def test_rolling_window_equals_batch(spark, small):
    """Windows of the stream: contiguous, over the limit, next one starts inside the overlap."""
    from engram.plans import all_queries

    rows = all_queries()["str3_rolling_window"](spark, small).collect()
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r["conv_id"], []).append(r)
        assert r["tokens"] > 400
    for windows in by_conv.values():
        windows.sort(key=lambda r: r["window_no"])
        assert [w["window_no"] for w in windows] == list(range(len(windows)))
        assert all(b["first_turn"] <= a["last_turn"] + 1 for a, b in zip(windows, windows[1:]))


def test_named_table_of_a_stream_may_be_a_folder(spark, tmp_path):
    from engram.streaming import jobs

    rows = spark.createDataFrame([(i, i % 3, "x" * 40) for i in range(30)], "conv_id LONG, turn LONG, text STRING")
    rows.repartition(4).write.parquet(str(tmp_path / "in" / "many.parquet"))
    rows.repartition(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "in" / "single.parquet")
    for name in ("many.parquet", "single.parquet"):
        out, ckpt = str(tmp_path / f"out-{name}"), str(tmp_path / f"ckpt-{name}")
        jobs.run_once(jobs.file_stream(spark, str(tmp_path / "in"), rows.schema, name), out, ckpt)
        assert spark.read.schema(rows.schema).parquet(out).count() == 30


def test_entity_chain_over_several_batches(spark):
    from engram.operators import graph
    from engram.session import scratch_path
    from engram.streaming import jobs

    rows = [(i, datetime(2024, 1, 1, i // 60, i % 60), [f"e{i % 3}", f"f{i % 5}"]) for i in range(90)]
    df = spark.createDataFrame(rows, "id LONG, timestamp TIMESTAMP, personnes ARRAY<STRING>")
    edges, state = scratch_path(spark, "edges"), scratch_path(spark, "state")
    body = jobs.entity_chain_batches("personnes", "LIEN_PERSONNE", edges, state)
    for n in (0, 1, 2, 2):  # the last batch is repeated
        body(df.filter(f"id >= {n * 30} AND id < {n * 30 + 30}"), n)
    pairs = lambda t: {(r.source_id, r.target_id) for r in t.collect()}
    assert pairs(spark.read.parquet(edges)) == pairs(graph.weave_entities(df))


def test_tree_nodes_with_several_parents(spark):
    rows = [("c", "r", True, ["m"]), ("c", "a0", False, ["m"]), ("c", "m", False, ["k"]), ("c", "k", False, []), ("c", "x", False, ["y"]), ("c", "y", False, ["x"])]
    nodes = spark.createDataFrame(rows, "conv STRING, node STRING, is_root BOOLEAN, children ARRAY<STRING>")
    assert sorted(r.node for r in exports.reachable_nodes(nodes).collect()) == ["k", "m", "r"]


def test_jagged_rows_with_quoted_delimiters(spark, tmp_path):
    (tmp_path / "x.csv").write_text('"a,b",1\n"c",2,3\nzz,q,1\n')
    got = tables.load_table(spark, str(tmp_path), "csv", "a STRING, b INT, c INT", jagged=True, max_bad=1).collect()
    assert sorted(map(tuple, got)) == [("a,b", 1, None), ("c", 2, 3)] or sorted(map(repr, got)) == sorted(["Row(a='a,b', b=1, c=None)", "Row(a='c', b=2, c=3)"])


def test_many_queries_and_pillars(spark):
    seg = spark.createDataFrame([(1, datetime(2024, 1, 1), "alpha six")], "id LONG, timestamp TIMESTAMP, resume_texte STRING").withColumns(
        {c: F.array().cast("array<string>") for c in ("sujets", "projets", "lieux", "personnes", "tags_roget")}
    ).withColumns({"emotion_valence": F.lit(0.0), "emotion_activation": F.lit(0.0), "vecteur": F.lit(None).cast("map<int,double>")})
    queries = [search.Query(i, keywords=["a1", "a2", "a3", "a4", "a5", "six"] if i % 2 else ["none"]) for i in range(300)]
    assert search.score_pairs(seg, queries, datetime(2024, 1, 1)).count() == 150
    # queries without conditions accept all; persons take the place of keywords; empty and short values
    odd = [search.Query(1), search.Query(2, keywords=["zz"], persons=["Ann"]), search.Query(3, keywords=[""]), search.Query(4, keywords=["x"]), search.Query(5, keywords=["a", "x"]),
           search.Query(6, start=datetime(2024, 1, 1), end=datetime(2024, 1, 2)), search.Query(7, end=datetime(2020, 1, 1)), search.Query(8, tags=["07"]), search.Query(9, keywords=[""], tags=["07"]),
           search.Query(10, keywords=["ha si"]), search.Query(11, keywords=["ha\nsi"])]
    rich = seg.withColumns({"personnes": F.array(F.lit("Joanna")), "tags_roget": F.array(F.lit("01-0010-0070"))})
    assert {r.query_id for r in search.score_pairs(rich, odd, datetime(2024, 1, 1)).collect()} == {1, 2, 3, 4, 5, 6, 8, 9, 10}


def test_stored_postings_equal_scan(spark, tmp_path):
    """Ten thousand searches in one scan of the segments, through a stored index, give what testing every pair gives."""
    words = ["alpha", "beta", "gamma", "Delta", "be", "ta ga"]
    seg = spark.range(400).select(
        "id", F.timestamp_seconds(F.col("id") * 40_000 + 1_700_000_000).alias("timestamp"), F.element_at(F.array(*map(F.lit, words)), (F.col("id") % 6 + 1).cast("int")).alias("resume_texte"),
        *[F.array(F.concat(F.lit(c), F.col("id") % 13)).alias(c) for c in ("sujets", "projets", "lieux", "personnes")], F.array(F.concat(F.lit("01-0010-0"), F.col("id") % 7)).alias("tags_roget"),
        F.lit(0.1).alias("emotion_valence"), F.lit(0.2).alias("emotion_activation"), F.lit(None).cast("map<int,double>").alias("vecteur"))
    log = [search.Query(i, keywords=[words[i % 6]] if i % 3 == 0 else [], persons=[f"personnes{i % 13}"] if i % 3 == 1 else [], tags=[f"0{i % 9}"] if i % 2 else [], top_k=2,
                        start=datetime(2023, 11, 20) if i % 5 == 0 else None) for i in range(10_000)]
    from engram.operators import grams

    grams.write_postings(search.index_segments(seg), str(tmp_path / "p"))
    got = search.score_pairs(seg, log, datetime(2024, 1, 1), grams.read_postings(spark, str(tmp_path / "p"))).select("query_id", "id").collect()
    rows = [(r.id, r.timestamp, r) for r in seg.collect()]
    want = set()
    for q in log[:300]:
        for i, t, r in rows:
            hay = "\n".join([r.resume_texte, *r.sujets, *r.projets, *r.lieux]).lower()
            ok = (not q.keywords or any(k.lower() in hay for k in q.keywords)) and (not q.persons or any(p in r.personnes[0] for p in q.persons)) and (not q.tags or any(t_ in r.tags_roget[0] for t_ in q.tags))
            if ok and (q.start is None or t >= q.start):
                want.add((q.query_id, i))
    assert len(got) == len(set(map(tuple, got))) and {tuple(r) for r in got if r.query_id < 300} == want


def test_documents_by_trigrams(spark, tmp_path):
    """A search reads the blocks that can hold its words, and finds what a scan finds."""
    from engram.operators import grams

    docs = spark.range(2_000).select("id", F.when(F.col("id") == 77, "Only HERE\nzebra").when(F.col("id") % 9 == 0, None).otherwise(F.concat(F.lit("plain text "), F.col("id"))).alias("text"))
    grams.write_blocks(docs, "id", "text", str(tmp_path / "b"), size=20)
    index = grams.read_blocks(spark, str(tmp_path / "b"))
    total = index.docs.select("_block").distinct().count()
    assert grams.holding(index, ["ZEBRA"]).count() == 1 < total
    assert 1 <= grams.holding(index, ["text 12", "9"]).count() < total
    assert grams.holding(index, []).count() == total and grams.holding(index, ["nowhere"]).count() == 0
    for word in ("zebra", "text 12", "x", "nowhere", "he"):
        got = flt.grep_lines(grams.reading(index, [word]), word).select("id", "line_no", "line").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, flt.grep_lines(docs, word).select("id", "line_no", "line").collect()))
    for wild in ("t*ext 1", "he*re", "*"):
        got = flt.search_text(grams.reading(index, grams.literal_pieces(wild)), wild).select("id", "position").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, flt.search_text(docs, wild).select("id", "position").collect()))
    plan = grams.reading(index, ["zebra"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "_block" in plan.split("PushedFilters", 1)[1].split("]", 1)[0]
    old = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog", "VALEUR", 1)], "id LONG, fait STRING, categorie STRING, importance INT")
    new = spark.createDataFrame([(i, f"fact number {i} of many that are all new", "VALEUR", 1) for i in range(10, 1300)] + [(2, "QUICK brown fox jumps over the", "VALEUR", 1), (3, "fox", "VALEUR", 1), (4, "foxes", "VALEUR", 1)], old.schema)
    assert {r.id for r in mut.add_pillars(old, new).collect()} == {1, 4, *range(10, 1300)}


def test_facts_keep_every_column(spark):
    old = spark.createDataFrame([(7, "d", "s", "old", 9, "{}", 1, 1)], "id LONG, domaine STRING, sujet STRING, information STRING, importance INT, metadata STRING, date_creation INT, derniere_maj INT")
    new = spark.createDataFrame([("d", "s", "new", 9, 5), ("d", "t", "x", 2, 6)], "domaine STRING, sujet STRING, information STRING, importance INT, derniere_maj INT")
    got = {r.sujet: r for r in mut.upsert_facts(old, new).collect()}
    assert (got["s"].id, got["s"].information, got["s"].importance, got["s"].metadata, got["s"].date_creation) == (7, "new", 5, "{}", 1) and got["t"].date_creation == 6


def test_index_equals_full_scoring(spark, tmp_path):
    """Bounds never lose a document, before and after updates, ties and long words included."""
    import random

    from engram.operators import fulltext as fts

    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(40)] + ["alpha", "alphabet", "x" * 40, "x" * 41]
    text = lambda: None if r.random() < 0.05 else " ".join(r.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=r.choice([1, 5, 60])))
    rows = [(i, text(), i % 4, "fr", ".md") for i in range(600)]
    schema = "id LONG, summary STRING, importance INT, domain STRING, extension STRING"
    files = spark.createDataFrame(rows, schema)
    fts.write_index(fts.build_index(files, "id", ["summary"], size=16), str(tmp_path / "i"))
    index = fts.read_index(spark, str(tmp_path / "i"))

    def same(index, files, query, limit, **kw):
        plain = fts.full_text_search(fts.build_postings(files, "id", ["summary"]), fts.build_doc_stats(files, "id", ["summary"]), files, query, limit=limit, **kw)
        shown = lambda df: [(x.id, round(x["rank"], 9)) for x in df.select("id", "rank").collect()]
        got, want = shown(fts.search_index(index, files, query, limit=limit, **kw)), shown(plain)
        assert got == want, (query, limit)

    for query, limit in (("w30", 5), ("w1 w39", 10), ("alpha*", 7), ("w", 20), ("nothing here", 5), ("x" * 40, 3), ("x" * 33, 50), ("w2 alphabet w17", 600)):
        same(index, files, query, limit)
    same(index, files, "w3 w20", 5, min_importance=3)
    # a narrow search judges most blocks by their bounds alone
    weights, mean = fts._weights(index, ["w39"])
    bounds = fts.block_bounds(index, ["w39"], [weights["w39"]], mean)
    assert 0 < bounds.count() < index.totals.first()["n_blocks"]
    changed = spark.createDataFrame([(i, "alpha changed w39" if i % 2 else None, 5, "fr", ".md") for i in [*range(0, 60, 3), 900, 901]], schema)
    gone = files.filter("id % 50 = 7")
    fts.write_index(fts.update_index(index, changed, "id", ["summary"], deleted=gone), str(tmp_path / "j"))
    after = fts.read_index(spark, str(tmp_path / "j"))
    now = files.join(gone, "id", "left_anti").join(changed.select("id"), "id", "left_anti").unionByName(changed)
    fresh = fts.build_index(now, "id", ["summary"], size=16)
    assert sorted(map(tuple, after.prefixes.select("prefix", "df").collect())) == sorted(map(tuple, fresh.prefixes.select("prefix", "df").collect()))
    assert after.totals.drop("n_blocks").first() == fresh.totals.drop("n_blocks").first()
    for query in ("changed", "alpha", "w39 w1"):
        same(after, now, query, 15)


def test_index_updates_move_whole_rows(spark, tmp_path):
    """Stored rows meet the changed documents of their block without being taken apart, and storing leaves no shuffle files."""
    import time

    from engram.operators import fulltext as fts

    docs = spark.createDataFrame([(i, f"alpha w{(i or 0) % 9} w{(i or 0) % 7}" if (i or 1) % 11 else None) for i in [*range(200), None, 3]], "id LONG, t STRING").repartition(3)
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in (x.getName() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles())) if f.startswith("shuffle_")}
    before = shuffles()
    fts.write_index(fts.build_index(docs, "id", ["t"], size=8), str(tmp_path / "i"))
    after = fts.update_index(fts.read_index(spark, str(tmp_path / "i")), docs.filter("id % 5 = 0").withColumn("t", F.lit("new w1 w1")), "id", ["t"], deleted=docs.filter("id % 7 = 0"))
    assert "inline(docs" not in after.blocks._jdf.queryExecution().optimizedPlan().toString()
    fts.write_index(after, str(tmp_path / "j"))
    time.sleep(2)
    assert not shuffles() - before
    now = docs.filter("id IS NULL OR id % 5 <> 0 AND id % 7 <> 0").unionByName(docs.filter("id % 5 = 0").withColumn("t", F.lit("new w1 w1")))
    shown = lambda df: sorted(map(str, df.groupBy("term").agg(F.sort_array(F.flatten(F.collect_list("docs"))).alias("d")).collect()))
    assert shown(fts.read_index(spark, str(tmp_path / "j")).blocks) == shown(fts.build_index(now, "id", ["t"], size=8).blocks)


def test_trigrams_are_listed_where_their_part_is(spark, monkeypatch):
    """Rows move before their trigrams are listed, not each trigram with them."""
    from engram.operators import grams

    df = spark.createDataFrame([(i if i % 13 else None, f"word{i % 7} x", 86_400 * (i % 3) if i % 5 else None) for i in range(60)], "id LONG, t STRING, s LONG").withColumn("at", F.timestamp_seconds("s"))
    plans, kept = [], grams.materialise
    monkeypatch.setattr(grams, "materialise", lambda x: plans.append(x._jdf.queryExecution().executedPlan().toString()) or kept(x))
    got = grams.build_postings(df, "id", {"text": F.col("t")}, F.col("at"), size=8).rows
    assert plans[0].count("Exchange") == 1
    want = {}
    for r in df.collect():
        for key in {("text", f"{r.t}\0\0"[k : k + 3]) for k in range(len(r.t))} | ({("day", f"{r['at']:%Y-%m-%d}")} if r["at"] else set()):
            want.setdefault(key, []).append(r.id)
    found = {}
    for r in got.collect():
        found.setdefault((r.kind, r.term), []).extend(r.ids)
    order = lambda d: {k: sorted(v, key=lambda x: (x is None, x)) for k, v in d.items()}
    assert order(found).keys() == order(want).keys() and all(len([x for x in found[k]]) == len([x for x in want[k] if x is not None]) for k in want)


def test_phrased_corpus_is_stored_small(spark, small):
    """The corpus and its phrased form are columns that Spark knows the size of, not rows of a checkpoint."""
    from engram.plans import queries_graph
    from engram.plans.registry import Data

    phrased = queries_graph._phrased(Data(spark, small))
    assert phrased.inputFiles() and phrased.count()


@pytest.mark.parametrize("blocks,shards", [(10_000, 1), (10_000, 4), (60, 2)])
def test_word_vectors_find_planted_synonyms(spark, blocks, shards):
    """Two words of one use are closer to each other than to words of other uses, with whole and with cut contexts."""
    import random

    from engram.operators import wordvectors

    r = random.Random(1)
    rows = []
    for _ in range(1_500):
        g = r.randrange(12)
        rows.append(([x for _ in range(10) for x in (f"g{g}c{r.randrange(10)}", *([f"syn{g}{r.choice('ab')}"] if r.random() < 0.3 else []))] + [f"once{len(rows)}"],))
    corpus = spark.createDataFrame(rows, "tokens array<string>").repartition(4)
    vectors = wordvectors.train_vectors(corpus, size=24, epochs=6, words_per_block=blocks, shards=shards)
    found = {x.term: x.embedding for x in vectors.collect()}
    assert set(found) == {f"g{g}c{k}" for g in range(12) for k in range(10)} | {f"syn{g}{c}" for g in range(12) for c in "ab"} and {len(v) for v in found.values()} == {24}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    near = sum(cosine(found[f"syn{g}a"], found[f"syn{g}b"]) > max(cosine(found[f"syn{g}a"], found[f"syn{h}b"]) for h in range(12) if h != g) for g in range(12))
    assert near >= 11


def test_training_step_equals_plain_sums():
    """A batch's changes are those of its places one by one, with whole contexts within a paragraph."""
    import numpy as np

    from engram.operators import wordvectors as wv

    draw = np.random.default_rng(3)
    word, lengths, n, size = draw.integers(0, 30, 100).astype("<i4"), np.array([1, 60, 39], "<i4"), 40, 8
    inner, outer = (draw.normal(size=(n, size)).astype("<f4") for _ in range(2))
    times = draw.integers(0, 5, n).astype("<i4")
    piece = wv._Piece(size, 5, 0.025, 7)
    piece.take("in", 0, np.arange(30, dtype="<i4").tobytes(), inner[:30].tobytes(), None)
    piece.take("out", 0, np.arange(n, dtype="<i4").tobytes(), outer.tobytes(), times.tobytes())
    piece.learn(word.tobytes(), lengths.tobytes(), 4)
    reach = np.random.default_rng([7, 4]).integers(1, 6, len(word))
    wrong = np.take(np.random.default_rng([7, 4, 1]).permutation(np.repeat(np.arange(n), times)), np.arange(wv.SHARED), mode="wrap")
    into, out, seen = inner[:30].astype(float), outer.astype(float), np.zeros(30)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for begin, end in ((0, 1), (1, 61), (61, 100)):
        for p in range(begin, end):
            around = [word[q] for q in range(max(begin, p - reach[p]), min(end, p + reach[p] + 1)) if q != p]
            if not around:
                continue
            mean, change = inner[around].astype(float).mean(0), np.zeros(size)
            for target, label, share in [(word[p], 1, 1), *[(w, 0, wv.NEGATIVES / wv.SHARED) for w in wrong if w != word[p]]]:
                g = 0.025 * share * (label - sigmoid(mean @ outer[target]))
                change += g * outer[target]
                out[target] += g * mean
            for w in around:
                into[w] += change
                seen[w] += 1
    assert np.allclose(piece.inner, into, atol=1e-4) and np.allclose(piece.outer, out, atol=1e-4) and (piece.seen["in"] == seen).all()


def test_training_keeps_one_round_on_disk(spark):
    """What stays in the shared folder and among the shuffle files doesn't grow with the epochs."""
    import time
    from pathlib import Path

    from engram.operators import wordvectors
    from engram.session import shared_dir

    shared_dir(spark)
    folder, blocks = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")), spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in (x.getName() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles())) if f.startswith("shuffle_")}
    size = lambda: sum(f.stat().st_size for f in folder.parent.rglob("*") if f.is_file())
    corpus = spark.range(400).selectExpr("transform(sequence(0, 30), i -> concat('w', (id * 7 + i * i) % 3000)) AS tokens")
    grown, left = [], []
    for epochs in (1, 5):
        before, had = size(), shuffles()
        vectors = wordvectors.train_vectors(corpus, size=50, epochs=epochs, shards=4)
        time.sleep(2)
        grown.append(size() - before)
        left.append(len(shuffles() - had))
        assert vectors.count()
    assert grown[1] < 1.3 * grown[0] and left[1] <= left[0]


def test_no_word_vectors(spark):
    from engram.operators import wordvectors

    assert wordvectors.train_vectors(spark.createDataFrame([(["once"],), ([],)], "tokens array<string>"), epochs=1).count() == 0


def test_pillars_meet_stored_facts_by_asked_pieces_only(spark, monkeypatch):
    """Texts of all lengths, across stretches and beyond ASCII; what the stored facts give to the join stays small."""
    import random

    from engram.operators import mutations as mut

    monkeypatch.setattr(mut, "STRETCH", 50)
    r = random.Random(3)
    facts = ["".join(r.choices("abcdé𝄞 ", k=k)) for k in (0, 1, 5, 31, 32, 33, 90, 300, 300)]
    asked = {f[a : a + n].strip() for f in facts for n in (3, 7, 31, 32, 33, 60) for a in (0, 3, 40, 200, len(f) - n) if a >= 0}
    asked |= {"".join(r.choices("abcdé𝄞", k=k)) for k in (3, 4, 20, 32, 33, 70) for _ in range(6)}
    asked |= {f[-2:] + g[:9] for f in facts for g in facts}  # stands across two facts only
    asked = sorted(a.strip() for a in asked)
    shape = "id LONG, fait STRING, categorie STRING, importance INT"
    old = spark.createDataFrame([(i, f.upper() if i % 2 else f, "VALEUR", 1) for i, f in enumerate(facts)] + [(20, None, "VALEUR", 1)], shape)
    new = spark.createDataFrame([(100 + i, a, "VALEUR", 1) for i, a in enumerate(asked)], shape)
    first = {}
    for i, a in enumerate(asked):
        if len(a) >= 3 and not any(a.lower() in f.lower() for f in facts):
            first.setdefault(a.lower(), 100 + i)
    assert {x.id for x in mut.add_pillars(old, new).collect()} == {*range(len(facts)), 20, *first.values()}
    pieces = spark.createDataFrame([("abc",)], "_piece STRING")
    low = spark.createDataFrame([(1, "xyz" * 5_000 + "abc"), (2, "ab")], "_key LONG, _low STRING")
    held = [tuple(x) for x in mut._held_pieces(low, pieces, [3]).collect()]
    assert (1, "abc") in held and len(held) < 5


def test_pieces_found_by_chance_stay_few(spark):
    """Many asked pieces for the bitmap's size: a task isn't flooded with stretches that set bits let through."""
    import random

    from engram.operators import mutations as mut

    r = random.Random(5)
    asked = ["".join(r.choices("abcdefghij", k=9)) for _ in range(1_000)]
    texts = ["".join(r.choices("abcdefghij", k=20_000)) + asked[i] for i in range(10)]
    low = spark.createDataFrame(list(enumerate(texts)), "_key LONG, _low STRING")
    pieces = spark.createDataFrame([(a,) for a in asked], "_piece STRING")
    held = [tuple(x) for x in mut._held_pieces(low, pieces, [9], bits=16).collect()]
    want = {(i, a) for i, t in enumerate(texts) for a in asked if a in t}
    assert want <= set(held) and len(held) < len(want) + 200
    # a piece that needs no comparison afterwards is given on once, not for each text
    short = spark.createDataFrame([("ab",)], "_piece STRING")
    assert mut._held_pieces(low, short, [2], keyed=3).filter("_piece = 'ab'").count() == 1


def test_files_of_a_value_are_written_by_tasks_of_their_own(spark, tmp_path):
    from engram.sources import files

    rows = spark.createDataFrame([(f"text {i}", ["de", "en", "fr", "it", None][i % 5]) for i in range(500)], "text STRING, part STRING")
    dealt = files.file_parts(rows, "part", 4)
    shares = dealt.groupBy("part", F.spark_partition_id().alias("task")).count().collect()
    assert len(shares) == 20 and max(r["count"] for r in shares) < 50
    dealt.write.partitionBy("part").text(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("part=*/*.txt"))) == 20 and spark.read.text(str(tmp_path / "out")).count() == 500


@pytest.mark.parametrize("minimum", [-1.0, 0.9])
def test_neighbour_table_sorts_only_what_can_be_reported(spark, monkeypatch, minimum):
    """Ties, repeated words, a word without a name and a vector of NaN; no whole matrix of scores is sorted by argsort."""
    import numpy as np

    r = np.random.default_rng(4)
    vectors = np.vstack([r.integers(-2, 3, (200, 3)), np.full((1, 3), np.nan), np.zeros((1, 3))])
    rows = [(f"w{i % 190:03d}" if i < 201 else None, v / max(np.linalg.norm(v), 1e-12)) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(t, [float(x) for x in v]) for t, v in rows], "term STRING, embedding ARRAY<DOUBLE>").coalesce(1)
    asked, want = ["w003", "w005", "w120"], set()
    for a in asked:
        near = sorted((-round(float(u @ v), 12), t) for s, u in rows if s == a for t, v in rows if t not in (a, None) and round(float(u @ v), 12) >= minimum)[:4]
        want |= {(a, t, round(-s, 9)) for s, t in near}
    got = emb.neighbour_table(df, spark.createDataFrame([(a,) for a in asked], "term STRING"), n=4, minimum=minimum)
    assert {(x.source, x.term, round(x.score, 9)) for x in got.collect()} == want
    monkeypatch.delattr(np, "argsort")
    unit, words = np.eye(50)[np.arange(3_000) % 50], np.array([f"w{i:04d}" for i in range(3_000)], object)
    source, word, _ = emb._nearest(words[:2], unit[:2], words, unit, 3, minimum)
    assert list(zip(source, word)) == [("w0000", "w0050"), ("w0000", "w0100"), ("w0000", "w0150"), ("w0001", "w0051"), ("w0001", "w0101"), ("w0001", "w0151")]


def test_trees_of_any_depth(spark):
    """Ten thousand levels, broken chains and cycles."""
    n = 10_000
    deep = spark.range(1, n + 1).select("id", F.concat(F.lit("n"), F.col("id") % 7).alias("nom"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id"))
    got = joins.hierarchy(deep).select("niveau", F.length("chemin").alias("l")).orderBy("niveau").collect()
    assert [r.niveau for r in got] == list(range(n)) and got[-1].l == 2 * n + 3 * (n - 1)
    odd = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "lost", 99), (4, "below", 3)], "id LONG, nom STRING, parent_id LONG")
    assert sorted(tuple(r) for r in joins.hierarchy(odd).select("id", "chemin").collect()) == [(1, "a"), (2, "a > b")]
    with pytest.raises(ValueError, match="5, 6"):
        joins.hierarchy(odd.unionByName(spark.createDataFrame([(5, "x", 6), (6, "y", 5)], odd.schema)))
    assert joins.hierarchy(odd.limit(0)).count() == 0


def test_nothing_is_cut_unasked(spark):
    """More tags, subjects, places and letters than the contract keeps go through ingest whole."""
    from engram.functions import records

    raw = spark.createDataFrame([("x" * 2000, ["01-0010-0010"] * 9, ["s"] * 9, ["here"])], "resume_texte STRING, tags_roget ARRAY<STRING>, sujets ARRAY<STRING>, lieux ARRAY<STRING>").withColumns(
        {c: F.lit(None).cast("string") for c in ("gr_id", "confidence_score", "emotion_valence", "emotion_activation")} | {c: F.array().cast("array<string>") for c in ("personnes", "projets")} | {"indexable": F.lit(True)})
    r = records.normalise_annotation(raw).first()
    assert (len(r.resume_texte), len(r.tags_roget), len(r.sujets), r.lieux) == (2000, 9, 9, ["here"])
    c = records.normalise_annotation(raw, most=5, letters=800, places=False).first()
    assert (len(c.resume_texte), len(c.tags_roget), len(c.sujets), c.lieux) == (803, 5, 5, [])
    long = "non, c'est " + "y" * 900
    docs = spark.createDataFrame([(1, long, f"f.txt")], "id LONG, text STRING, file_name STRING")
    assert len(flt.grep_regex(docs, "y+").first().content) == 911 and len(flt.grep_regex(docs, "y+", cut=500).first().content) == 500
    assert len(flt.detect_corrections(docs, "id").first().contexte) == 911


def test_names_are_resolved_once(spark):
    seg = spark.createDataFrame([(1, ["ANN", "Bob", "ann"], ["P", "q"], ["s"]), (2, None, [], None), (3, ["zed"], ["Q", "r", "r"], ["r"])], "id LONG, personnes ARRAY<STRING>, projets ARRAY<STRING>, sujets ARRAY<STRING>")
    persons = spark.createDataFrame([("Anna", ["ann"])], "nom_canonique STRING, variantes ARRAY<STRING>")
    known = spark.createDataFrame([("Q",)], "nom STRING")
    got = {r.id: r for r in joins.canonicalise(seg, joins.alias_dim(persons), known).collect()}
    assert (got[1].personnes, got[1].projets, got[1].sujets, got[1].personne_candidat, got[1].projet_candidat) == (["Anna", "Bob", "Anna"], ["q"], ["s", "P"], "Bob", "P")
    assert (got[2].personnes, got[2].projets, got[2].sujets, got[2].personne_candidat) == ([], [], [], None)
    assert (got[3].personnes, got[3].projets, got[3].sujets, got[3].projet_candidat) == (["zed"], ["Q"], ["r"], "r")


def test_views_read_changed_partitions(spark, tmp_path):
    """A refresh makes the results of new, changed and removed partitions only, odd names included."""
    import shutil

    table, view = str(tmp_path / "t"), str(tmp_path / "v")
    rows = spark.createDataFrame([(f"p {k % 5}+%", k % 2, k) for k in range(50)], "part_name STRING, g INT, x LONG")
    write = lambda df: df.write.mode("append").partitionBy("part_name").parquet(table)
    look = lambda: sorted(map(tuple, tables.refresh_view(spark, table, view, "part_name", ["g"], ["x"]).collect()))
    made = lambda n: {r.part for r in spark.read.parquet(f"{view}/rows/at={n}").select("part").distinct().collect()}
    plain = lambda df: sorted(map(tuple, df.groupBy("g").agg(F.count(F.lit(1)), F.sum("x")).collect()))
    write(rows)
    assert look() == plain(rows) and len(made(0)) == 5
    more = spark.createDataFrame([("p 1+%", 7, 100), ("new", 0, 1)], rows.schema)
    write(more)
    assert look() == plain(rows.unionByName(more)) and made(1) == {"p 1+%", "new"}
    shutil.rmtree(next((tmp_path / "t").glob("part_name=p 3*")))
    assert look() == plain(rows.unionByName(more).filter("part_name <> 'p 3+%'"))
    assert look() == plain(rows.unionByName(more).filter("part_name <> 'p 3+%'"))


def test_short_logs_need_no_postings(spark, monkeypatch):
    """A few searches without an index test each segment or file once, with the results that postings lead to."""
    from engram.operators import grams

    seg = spark.createDataFrame([(i if i < 9 else None, datetime(2024, 1, 1 + i), f"alpha w{i}") for i in range(10)], "id LONG, timestamp TIMESTAMP, resume_texte STRING").withColumns(
        {c: F.array().cast("array<string>") for c in ("sujets", "projets", "lieux", "personnes", "tags_roget")}
    ).withColumns({"emotion_valence": F.lit(0.0), "emotion_activation": F.lit(0.0), "vecteur": F.lit(None).cast("map<int,double>")})
    seg = seg.unionByName(seg.filter("id = 3"))
    queries = [search.Query(1, keywords=["w3", "W4"]), search.Query(2, keywords=["alpha"]), search.Query(3), search.Query(4, keywords=[""]), search.Query(5, start=datetime(2024, 1, 5)), search.Query(6, tags=["no"])]
    docs = spark.createDataFrame([("a", "x\nOne two\none"), ("a", "one"), ("b", None), (None, "one"), ("c", "none")], "file_name STRING, text STRING")
    asked, answered = [search.Query(1, "ONE"), search.Query(2, "on", top_k=1), search.Query(3, "one")], spark.createDataFrame([(3,)], "query_id LONG")
    scored = lambda: sorted(map(repr, search.score_pairs(seg, queries, datetime(2024, 2, 1)).select("query_id", "id", F.round("score", 9)).collect()))
    lines = lambda: sorted((r.query_id, r.file_name, r.resume_texte) for r in search.text_fallback(docs, asked, answered).filter("query_id = 1").collect())
    monkeypatch.setattr(search, "SCANNED", 0)
    by_postings = scored(), lines()
    monkeypatch.undo()

    def refuse(*_, **__):
        raise AssertionError("postings were built for a few searches")

    monkeypatch.setattr(grams, "build_postings", refuse)
    assert (scored(), lines()) == by_postings
    assert lines() == [(1, "a", "One two"), (1, "a", "one"), (1, "c", "none")]


def test_heavy_rows_get_tasks_by_their_number(spark, monkeypatch):
    from engram import session

    monkeypatch.setattr(session, "ROWS_PER_TASK", 10, raising=False)
    few = spark.range(0, 1_000, 1, 2)
    assert session.spread(few).rdd.getNumPartitions() == 104
    assert session.spread(spark.range(0, 1_000, 1, 200)).rdd.getNumPartitions() == 200


def test_prefixes_count_documents_once(spark):
    from engram.operators import fulltext as fts

    texts = ["alpha alphabet alp beta", "alpha alpha", "", None, "x" * 40 + " " + "x" * 41 + " x", "é 𝒜𝒜 𝒜𝒜b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id LONG, t STRING")
    index = fts.build_index(docs, "id", ["t"], size=2)
    want = {}
    for words in docs.select(fts.tokens(F.col("t")).alias("w")).collect():
        for p in {w[:k] for w in words.w or [] for k in range(1, min(len(w), 32) + 1)}:
            want[p] = want.get(p, 0) + 1
    assert {r["prefix"]: r["df"] for r in index.prefixes.collect()} == want
    # words are counted before they are cut: a word of many documents isn't cut again for each
    text = fts._prefix_counts(spark.createDataFrame([(0, [("a", 1), ("ab", 1)])], "doc_id LONG, words ARRAY<STRUCT<term: STRING, tf: LONG>>"))
    assert {r["prefix"]: r["df"] for r in text.collect()} == {"a": 1, "ab": 1}


def test_phrase_words_are_stored_with_their_size(spark, monkeypatch):
    """Few words meet the pairs without sorting them."""
    corpus = spark.createDataFrame([(i, 0, ["alpha", "beta", "gamma"]) for i in range(20)], "doc_id INT, par_no INT, tokens ARRAY<STRING>")
    scored = emb.phrase_scores(corpus)
    assert "SortMergeJoin" not in scored._jdf.queryExecution().sparkPlan().toString()
    assert {(r.a, r.b, r.c_ab) for r in scored.collect()} == {("alpha", "beta", 20), ("beta", "gamma", 20)}
    tokens = spark.createDataFrame([("ab abc a1 the",)], "t STRING").select(emb.corpus_tokens(F.col("t"), ["the"]).alias("w")).first().w
    assert tokens == ["abc"]


def test_queries_that_ask_the_same_are_searched_once(spark, monkeypatch, tmp_path):
    """A log is scored by its different searches, and gives each query what a search of its own gives."""
    from engram.operators import grams, windows

    words = ["alpha", "beta", "gamma"]
    seg = spark.range(90).select(
        "id", F.timestamp_seconds(F.col("id") * 40_000 + 1_700_000_000).alias("timestamp"), F.element_at(F.array(*map(F.lit, words)), (F.col("id") % 3 + 1).cast("int")).alias("resume_texte"),
        *[F.array(F.concat(F.lit(c), F.col("id") % 13)).alias(c) for c in ("sujets", "projets", "lieux", "personnes")], F.array(F.lit("01-0010-0010")).alias("tags_roget"),
        F.lit(0.1).alias("emotion_valence"), F.lit(0.2).alias("emotion_activation"), F.lit(None).cast("map<int,double>").alias("vecteur"))
    # words that occur nowhere, other lengths of the answer, other instants, a query twice, a number twice
    log = [search.Query(i, keywords=[words[i % 3], f"absent{i}"], top_k=1 + i % 4) for i in range(100)]
    log += [search.Query(200 + i, keywords=[f"nowhere{i}"]) for i in range(3)] + [search.Query(300 + i, start=datetime(2023, 11, 20, 0, 0, 0, i % 2)) for i in range(6)]
    log += [search.Query(400, persons=["personnes1"], keywords=["alpha", "zz"]), search.Query(400, persons=["personnes1"], keywords=["alpha", "zz"]), search.Query(401, tags=["0010"]), search.Query(402)]
    grams.write_postings(search.index_segments(seg), str(tmp_path / "p"))
    index, now = grams.read_postings(spark, str(tmp_path / "p")), datetime(2024, 1, 1)
    whole = windows.top_k(search.score_pairs(seg, log, now, index), ["query_id"], [F.desc("score"), F.asc("id")], 5).filter("rank <= top_k")
    key = lambda df: sorted(map(tuple, df.select("query_id", "id", "rank", F.round("score", 9)).collect()))
    want, asked, score = key(whole), [], search.score_pairs

    def counted(seg, queries, *rest):
        asked.append(queries.count())
        return score(seg, queries, *rest)

    monkeypatch.setattr(search, "score_pairs", counted)
    assert key(search.hybrid_search(seg, log, now, index=index)) == want and len(want) > 250
    assert key(search.hybrid_search(seg, log, now)) == want
    assert asked[0] == 3 + 3 + 2 + 1 + 1 + 1


def test_texts_are_made_once_per_row(spark, small):
    """Places aren't put together anew for every keyword, nor a view's columns before its rows are dealt out."""
    from engram.functions import vector
    from engram.plans.registry import Data

    seg = Data(spark, small).wide("segments")
    plan = vector.vectorise(seg).select("vecteur")._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(lower(array_join(lieux" not in plan
    below = seg._jdf.queryExecution().optimizedPlan().toString().split("Repartition")
    assert len(below) == 2 and "reflexion" not in below[1]

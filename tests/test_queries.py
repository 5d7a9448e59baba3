"""Every registered query with a checking SQL gives the same rows; the others run."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

QUERIES, CHECKS = entry.queries(), entry.oracle_sql()
SLOW = {"emb3_word2vec", "emb5_expand_queries", "srch6_expanded_search"}  # covered by test_embeddings on a small corpus


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, small, name):
    result = compare(spark, con, small, name, QUERIES[name], CHECKS.get(name))
    assert result["ok"] is not False, result["why"]


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_query_log_has_whole_texts(spark):
    from types import SimpleNamespace

    from engram.plans.queries_graph import query_log

    rows = spark.createDataFrame([(3, "x" * 200 + " end")], "item_id bigint, text string")
    assert query_log(SimpleNamespace(benchmark=rows)).first().text.endswith("x" * 200 + " end")


def test_emotions_rank_all_segments():
    assert "srch2_emotion_all" in QUERIES and "500" not in CHECKS["srch2_emotion_all"]

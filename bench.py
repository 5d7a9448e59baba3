"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "flt1_candidates", "flt15_search_text", "flt17_grep_lines", "agg1_corpus_stats", "agg4_duplicates", "agg9_digest_entities",
    "win2_token_offsets", "win9_merge_short", "win11_chunk_sizes", "join7_canonicalise", "join11_segment_text", "snk2_upsert_facts",
    "graph1_person_chain", "graph2_emotion_resonance", "graph4_shared_tags", "graph6_counts", "graph7_explore_depth2",
    "srch1_hybrid_search", "srch3_full_text", "vec1_vectorise", "emb1_corpus", "emb2_phrases", "emb3_word2vec",
    "emb4_most_similar", "sdk9_prefix_sizes", "sdk10_sync_plan", "str4_dedup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from engram.plans import all_queries
    from engram.session import build_session

    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # one throw-away query starts the JVM's compiler and the file listing
    queries["agg1_corpus_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    only = sys.argv[1:]
    for name in only or HEADLINE:
        start = time.perf_counter()
        try:
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as error:  # noqa: BLE001
            print(name, str(error)[:500], file=sys.stderr)
            continue
        times[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "n_queries": len(times), "missing": [n for n in HEADLINE if not only and n not in times],
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()

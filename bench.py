"""Headline queries on one machine; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodestone.operators import dense, hybrid  # noqa: E402
from lodestone.operators.two_level import TwoLevelLists  # noqa: E402
from lodestone.plans.catalogue import all_queries  # noqa: E402
from lodestone.plans.tables import corpus  # noqa: E402
from lodestone.session import get_spark  # noqa: E402

HEADLINE = [
    "bm25_topk", "term_statistics", "tokenize_counts", "hash_embedding", "cosine_topk",
    "inverted_list_recall", "hybrid_search", "evidence_verdict", "retrieval_features",
    "roc_points", "auc_both_ways", "bootstrap_auc", "page_chunks", "dedup_first",
    "round_robin_cap", "closure_hops", "upsert_orders", "constraint_violations",
    "citation_extraction", "consecutive_errors", "telemetry_development", "circuit_breaker",
]


def timed(run) -> float:
    started = time.perf_counter()
    run()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark("bench", int(os.environ.get("BENCH_CPUS", "8")))
    registered = all_queries()

    def noop(frame) -> None:
        frame.write.format("noop").mode("overwrite").save()

    noop(registered["hybrid_search"](spark, folder))  # start the workers, warm the JVM
    times = {}
    for name in HEADLINE:
        times[name] = timed(lambda name=name: noop(registered[name](spark, folder)))

    # The published vector search: 50 queries, ten neighbours, 768 dimensions.
    index = hybrid.build_index(corpus(spark, folder), dense.HashingEmbedder())
    vectors = index.select("doc_id", "vec").withColumnRenamed("doc_id", "id")
    asked = vectors.orderBy("id").limit(50).withColumnRenamed("id", "query_id")
    times["exact_768_50_queries"] = timed(lambda: noop(dense.exact_neighbours(vectors, asked, 10)))
    built = {}
    times["inverted_lists_768_build"] = timed(lambda: built.update(lists=TwoLevelLists(vectors)))
    lists = built["lists"]
    measured = lists.calibrate(dense.exact_neighbours, 10)
    times["inverted_lists_768_50_queries"] = timed(lambda: noop(lists.search(asked, 10)))
    found = dense.recall_and_distance(lists.search(asked, 10), dense.exact_neighbours(vectors, asked, 10), 10).first()
    compared, pairs = lists.rows_visited(asked).first()
    n = vectors.count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")), "warm": True,
        "vector_rows": n,
        "exact_ms_per_query": round(times["exact_768_50_queries"] * 1000 / 50, 2),
        "inverted_lists_ms_per_query": round(times["inverted_lists_768_50_queries"] * 1000 / 50, 2),
        "inverted_lists": lists.lists, "lists_visited": lists.probes, "recall_calibrated": round(measured, 4),
        "recall_at_10": round(found["recall"], 4), "share_of_rows_compared": round(compared / pairs, 4),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

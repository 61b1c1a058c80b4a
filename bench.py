"""Times the headline queries and prints one JSON line.

The total is that of the headline queries; heavier ones are timed beside it under "more", and some at a
second, smaller scale under "small", so that growth with the data shows.

Environment: BENCH_SF_DIR (tables), BENCH_SMALL_DIR (tables of the second scale), BENCH_CPUS (local threads),
BENCH_RUNS (runs per query, the median counts), BENCH_QUERIES (comma-separated names, instead of all).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from clausespark.plans import load  # noqa: E402
from clausespark.session import local_session  # noqa: E402

HEADLINE = (
    "clean_text stem_tokens detect_lang numeric_score query_gates knn_topk dense_retrieve lexical_retrieve rrf clause_candidates "
    "doc_route final_order confidence verified_upsert negative_signal fifo_pairs dashboard doc_counts clauses table_cells draft_dedupe "
    "job_ledger eval_summary"
).split()
MORE = "exact_clause row_candidates row_fallback seeded_knn".split()
GROWTH = "lexical_retrieve exact_clause row_candidates clauses knn_topk".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES")
    spark = local_session(cores, "bench")
    queries = load().queries
    spark.read.parquet(f"{folder}/region.parquet").count()
    def timed(name: str, where: str) -> float:
        took = []
        for _ in range(runs):
            t0 = time.perf_counter()
            queries[name](spark, where).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t0)
        print(f"{name} {where}: {took}", file=sys.stderr, flush=True)
        return round(statistics.median(took), 3)

    times = {name: timed(name, folder) for name in (names.split(",") if names else HEADLINE)}
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}
    if not names:
        small = os.environ.get("BENCH_SMALL_DIR", os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.01"))
        out |= {"more": {name: timed(name, folder) for name in MORE}, "small": {name: timed(name, small) for name in GROWTH}}
    print(json.dumps(out), flush=True)


if __name__ == "__main__":
    main()

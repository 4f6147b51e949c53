"""Headline queries at one scale, timed in a warm session; prints one JSON line.

    BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import re
import time

from rememora.plans.registry import REGISTRY
from rememora.session import build_session

HEADLINE = [
    "bm25_topk", "tier2_rescored", "ladder_snapshot", "cooccurrence_edges_capped", "floor_topk",
    "baseline_bm25only", "consolidated_entries", "dedup_fold", "ir_metrics", "knn_topk", "knn_global",
    "latency_percentiles_floor", "sweep_summary", "trace_latency_stats", "access_bump", "stream_buffer",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "rememora-bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("floor_topk", "bm25_topk"):  # start the executor threads and the code generator
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - begin, 3)
    n_queries = spark.read.parquet(f"{folder}/benchmark.parquet").count()
    n_turns = spark.read.parquet(f"{folder}/conversations.parquet").count()
    # the units that single calls are measured in: a batch divided by its size
    units = {name: round(1000 * timings[query] / n, 3) for name, query, n in (
        ("ladder_ms_per_query", "ladder_snapshot", n_queries), ("bm25_ms_per_query", "baseline_bm25only", n_queries),
        ("write_ms_per_turn", "consolidated_entries", n_turns))}
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "units": units, "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()

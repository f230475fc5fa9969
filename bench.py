"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: folder with the Parquet tables (default /root/testdata/sf0.1). BENCH_CPUS: local cores (default 8).
Every query runs once to warm up and is then timed over its whole result, from building the plan to writing every row.
"""

from __future__ import annotations

import json
import os
import sys
import time

from recallgrid.plans import QUERIES
from recallgrid.session import build_session

HEADLINE = (
    "vector_topk", "vector_topk_grid", "vector_topk_filtered", "text_search", "search_fallback", "rerank_overlap",
    "ann_recall", "validate_accept", "stable_id", "dedup_last_wins", "incremental_ingest", "ingest_report", "doc_render",
    "flight_document", "index_append", "point_lookup", "eval_metrics_ids", "eval_summary", "threshold_sweep",
    "latency_percentiles", "price_percentiles", "composite_rank", "booking_create", "booking_cancel", "request_router",
    "trim_history", "transcript", "summarize_history", "session_expiry", "lru_sessions", "json_recover", "stream_ingest",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

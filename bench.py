"""Time the headline queries and print one JSON line.

Each query runs end to end on the driver tables, deriving its directory tables
on the way, and is written to Spark's no-op sink, so that every row and column
is computed. One warm-up run per query, then the median of BENCH_RUNS runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from wherewhen.catalog import registry  # noqa: E402
from wherewhen.session import build_session  # noqa: E402

HEADLINE = [
    "open_now_nearest", "active_at", "status_at", "schedule_rows", "schedule_normalized", "weekly_occupancy",
    "override_join", "menu_join", "key_backfill", "merge_upsert", "dedup_first", "search_cap", "ttl_lookup",
    "stale_skip", "radius_filter", "nearest_k", "neighborhood_counts", "neighborhood_table_assign",
    "map_clusters_z13", "quadtree_leaves", "cheapest_per_category", "interval_merge", "page_text", "page_links",
    "page_candidates", "focused_texts", "place_documents_flat", "response_parse", "menu_prompts", "full_refresh",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session(f"local[{cpus}]", "wherewhen-bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": Path(sf_dir).name, "cpus": int(cpus), "runs": runs,
    }))


if __name__ == "__main__":
    main()

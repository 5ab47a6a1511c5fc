"""Headline-query benchmark.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Runs each headline query to completion with the ``noop`` sink (every row is
computed, nothing is collected to the driver) and prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
Each query runs once to warm up (JIT, Python workers) and is then timed;
the reported time is the best of ``BENCH_REPEAT`` runs (default 2).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "product_summary_full",   # flagship: composite text summary (A1-A14)
    "product_summary",        # rating statistics over all review rows
    "cohort_phrases",         # bigram explode + top-k per product and band
    "keyword_top5",
    "top_option",
    "dedup_full",             # keep-first dedup
    "merge_append",
    "catalog_merge",
    "product_upsert",
    "page_walk",
    "review_enrich",
    "export_reviews",
    "product_list",
    "review_facts",           # E0 (Arrow HTML stage) + card parsing
    "product_facts",
    "page_links",
    "listing_completeness",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    names = sys.argv[1:] or HEADLINE

    from loupe.plans.registry import all_queries
    from loupe.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 8),
                          app="loupe-bench")
    spark.sparkContext.setLogLevel("OFF")
    qs = all_queries()
    times = {}
    for n in names:
        def run():
            qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        run()  # warm-up
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            run()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[n] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from gridwork.plans.catalog import QUERIES
from gridwork.session import local_session

HEADLINES = [
    "harmonize_workflow",
    "fill_down",
    "workflow_rollup",
    "completeness",
    "topn_other",
    "category_names",
    "dedup_keep_first",
    "cell_cleaning",
    "out_parts",
    "pattern_groups",
    "extension_distribution",
    "worklist_plan",
    "sections_chat",
    "sections_html",
    "eol_normalize",
    "truncate_chunk",
    "field_profile",
    "issue_flatten",
    "doc_tree_text",
    "formula_merge",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINES
    spark = local_session(cores, "gridwork-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        # Computes every row and column of the result without keeping it.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    scale = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set tables and cores. Every query
is run to the end into a sink that keeps nothing; its plan building counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millaudit.plans import registry  # noqa: E402
from millaudit.session import local_session  # noqa: E402

HEADLINE = [
    "f24_limit_decisions", "a4_limit_issues_per_report", "f25_f26_review_classes", "j7_validity", "a3_all_passed", "e2_validate_standards",
    "f7_name_pairs", "j1_matched_items", "w1_look_ahead_codes", "f18_inspection_items", "t1_html_cells", "t4_t5_required_items",
    "k1_top_chunks", "k2_k3_k4_rule_chunks", "k5_best_chunks", "j19_limits_by_item", "w6_clustered_rows", "a5_module_table",
    "a19_period_figures",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    registry.load_all()
    spark.read.parquet(f"{folder}/region.parquet").count()
    times = {}
    for name in HEADLINE:
        begin = time.time()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begin, 3)
    requests = registry.QUERIES["j7_validity"](spark, folder).count()
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "standards_per_second": round(requests / times["j7_validity"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
BENCH_QUERIES may name queries, separated by commas, or be "all".
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quayside.catalog import QUERIES  # noqa: E402
from quayside.session import build  # noqa: E402

HEADLINE = [
    "round_cost",
    "round_fold",
    "running_resource_peak",
    "range_filter_and",
    "extraction_request",
    "sample_with_replacement",
    "contiguous_folds",
    "latest_record_per_key",
    "request_status",
    "round_gated_samples",
    "cpu_from_counters",
    "window_features",
    "recording_features",
    "feature_table",
    "chronological_split",
    "provider_partitions",
    "class_parity",
    "completeness",
    "feature_correlation",
    "nearest_neighbours",
    "class_overlap",
    "label_issues",
    "federated_average",
    "local_training_step",
    "cost_dashboard",
    "round_cost_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = build(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # start the JVM's and the Python workers' machinery once
    for warm in ("round_cost", "local_training_step"):
        run(warm)
    timings = {name: round(run(name), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

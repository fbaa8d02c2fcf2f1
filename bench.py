"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. A query's time is the median of three runs after a warm-up."""

from __future__ import annotations

import json
import os
import statistics
import time

from sitelark.catalog import QUERIES
from sitelark.session import local_session

HEADLINE = (
    "site_score", "site_score_dense", "weighted_summary", "overlap_join_inner", "overlap_join_left", "asof_contains", "map_to_transcripts",
    "window_mean_inner", "topk_sites", "base_composition", "zscore_features", "percentiles", "em_step", "irls_step", "roc_auc", "average_precision", "report_l2",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, cpus)
    took: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # every value is computed, nothing is collected
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:] or times), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

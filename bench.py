"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "a09_exposition_text", "b16_flatten_dots", "c03_measurement_window", "d01_asof_nearest", "d04_tolerance_sensitivity",
    "d09_first_interval", "e01_service_grid", "e02_arrival_bins", "e08_series_profile", "e13_run_inventory",
    "e19_availability_summary", "e23_counter_rate", "e31_feature_profile", "e37_classifier_metrics", "f02_rolling_statistics",
    "f08_episodes", "f11_debounce", "f12_onsets", "f14_trailing_quantiles", "f15_outages", "f20_lag_scan_spearman",
    "g04_last_points", "m03_expected_behaviour", "m04_residual_scores", "j01_tumbling_summary",
)


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    from pulsegrid.plans import catalog
    from pulsegrid.session import local_session

    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "pulsegrid-bench")
    spark.read.parquet(f"{path}/events.parquet").groupBy("event_type").count().collect()  # starts the engine
    took = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(path.rstrip("/")).replace("sf", "")}), flush=True)


if __name__ == "__main__":
    main()

"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1); BENCH_CPUS: local threads (default 8).
Every query is run to its end into a sink that keeps nothing, once to warm up and once for the time.
"""

import json
import os
import time

QUERIES = (
    "a1_volume_histogram", "a5_point_of_control", "a6_value_area", "a8_weighted_moments", "a9_synthetic_delta", "a15_decayed_poc", "a18_calendar_resample", "a24_quantile_buckets",
    "w2_atr_wilder", "w4_percentile_rank", "w5_rolling_slope", "w7_quiet_score", "w14_pattern_accumulation", "w28_behavioral_frame", "w33_centered_rank",
    "j4_asof_coarse_to_base", "j7_bar_bin_overlap", "j8_window_self_join", "m1_triple_barrier", "c12_walk_forward_trades", "c14_structural_walk", "v1_purged_splits", "v3_factor_evaluation",
    "v6_cross_sectional_panel", "m11_pooled_p", "t8_overfitting_probability", "g6_honest_report", "k4_watchlist_scanner",
)


def main() -> None:
    from volumetra.plans import catalog
    from volumetra.session import session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    for name in QUERIES:
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()

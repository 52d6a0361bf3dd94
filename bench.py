"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR picks the data, BENCH_CPUS the number of cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "alert_report", "w13_alert_state", "w14_w15_accepted_batches", "a35_batch_counters", "feature_table",
    "w02_code_residual", "a03_a04_spoofing_epochs", "w06_w09_tracking_arcs", "w11_causal_deviation", "w23_reacquisition_rate",
    "w24_tracked_set_overlap", "j01_nearest_asof", "j02_interval_labels", "j04_correlation", "j07_nearest_sites",
    "j13_positional_join", "j18_radius_sums", "w18_incident_chain", "a26_o06_incidents", "w20_priority_list",
    "a10_a11_baseline_profile", "a13_a14_drift_report", "a18_a19_ranking_quality", "a28_global_moran", "a30_local_moran",
    "m02_m07_forest_scores", "m10_additivity", "t02_s15_stream_alert_state", "t01_t04_t05_stream_intake",
)


def main() -> None:
    from plumbline.plans import catalog
    from plumbline.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    # One small query starts the JVM's code paths and the Python workers.
    catalog.QUERIES["w13_alert_state"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        if only and not any(part in name for part in only):
            continue
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

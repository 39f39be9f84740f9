"""Wall time of the headline queries: one JSON line on stdout.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores,
``BENCH_QUERIES`` an optional comma-separated subset. Each query runs once to warm up
and once timed, into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from catalogue import QUERIES  # noqa: E402

HEADLINE = (
    "scan_parquet jsonl_partitioned_write topic_window quality_violations null_ratios range_checks quarantine_enum "
    "split_stratified split_plain reference_sample data_hash metric_f1_macro metric_roc_auc metric_regression "
    "gate_decision promote_events registry_previous register_versions version_lineage psi_numeric psi_categorical "
    "drift_report drift_all_models drift_level drift_windows fallback_ratio counter_increase histogram_quantile "
    "latency_percentiles alert_hold canary_verdict failure_streaks fraud_rules score_with_fallback doc_frequency "
    "tfidf_terms log1p_standardize category_medians train_linear train_run_summary stream_fallback_ratio "
    "stream_drift_windows stream_alert_hold stream_monitor_staleness"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("modelkeel-bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.unix.domain.socket.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        for attempt in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
            if name.startswith("stream_"):
                break
    line = {
        "metric": "total_wall_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }
    spark.stop()
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()

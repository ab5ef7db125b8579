"""Benchmark the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (timed runs per query after one warm-up, default 3; the median is reported).
Every query runs to completion through the ``noop`` sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowlens.plans import registry  # noqa: E402
from flowlens.session import get_session  # noqa: E402

# Headline set: label + hourly roll-up, preprocessing fit + transform, feature families,
# evaluation tables, forest fit + batch scoring, streaming scoring throughput.
HEADLINE = {
    "AL6_hourly_traffic": 3,
    "AL9_monitoring_report": 3,
    "PP7_preprocess_pipeline": 3,
    "FE_all_families": 3,
    "FE3_percentile_rank": 3,
    "EV4_class_report": 3,
    "EV5_binary_auc": 3,
    "EV7_roc_points": 3,
    "SP1_stratified_split": 3,
    "DR7_baseline_deviation": 3,
    "SC1_batch_scoring": 1,
    "ST1_stream_scoring": 1,
}


def run_once(spark, fn, sf_dir) -> float:
    t0 = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_session()
    registry.load_all()
    times: dict[str, float] = {}
    for name, n in HEADLINE.items():
        fn = registry.QUERIES[name]
        run_once(spark, fn, sf_dir)  # warm-up (JIT, file listing, python workers)
        samples = [run_once(spark, fn, sf_dir) for _ in range(max(1, min(n, runs)))]
        times[name] = round(statistics.median(samples), 3)
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").count()
    st1 = times["ST1_stream_scoring"]
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "stream_rows_per_sec": round(rows / st1, 1) if st1 else None}))


if __name__ == "__main__":
    main()

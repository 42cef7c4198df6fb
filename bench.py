"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from driver_checks import queries  # noqa: E402
from voxtable.session import build_session  # noqa: E402

HEADLINE = [
    "d3_roi_arrays", "d6_category_counts", "d9_sparse_incidence", "d13_lesion_summary", "d17_lung_distribution",
    "e1_distance", "d20_axial_distribution", "d26_pleural_contact", "f12_classify", "i1_case_analysis", "e2_components",
    "e3_clean_labels", "e9_segment_lungs", "b11_byte_scale", "d34_class_dice", "g1_slice_split", "e11_run_lengths",
    "e13_suppression", "h2_early_stop",
]


def seconds(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    chosen = {name: query for name, query in queries().items() if name in HEADLINE}
    # Workers and code caches start on a query that is not timed.
    seconds(lambda: chosen["e1_distance"](spark, folder))
    times = {}
    for name in HEADLINE:
        times[name] = round(statistics.median(seconds(lambda: chosen[name](spark, folder)) for _ in range(runs)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale),
    }))


if __name__ == "__main__":
    main()

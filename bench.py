"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_RUNS the timed runs
per query (the median is reported, after one warm-up run).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import registered  # noqa: E402

HEADLINE = (
    "seat_delivery_report",
    "bid_creative_reach",
    "id_source_report",
    "conversion_id_counts",
    "device_match_report",
    "conversion_report",
    "utm_conversion_report",
    "site_conversion_utm_report",
    "delivery_overlap_with_totals",
    "reach_exclusive",
    "resolve_person_cascade",
    "event_root_nested",
    "attribute_conversions",
    "campaign_report",
    "first_touch_report",
    "match_pixels_to_line_items",
    "export_single_header_csv",
)


def session(cores: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("adlytics-bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(rows: DataFrame) -> None:
    """Compute every column of every row without bringing any to the driver."""
    rows.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = session(cores)
    available = registered()
    chosen = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in chosen:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            run(available[name](spark, folder))
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: warm-up {taken[0]:.2f} s, then {seconds[name]:.2f} s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder).removeprefix("sf"),
                "cores": int(cores),
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()

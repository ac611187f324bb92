"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default HEADLINE; "all" for every query).
"""

from __future__ import annotations

import json
import os
import sys
import time

from headwise.plans.catalog import load_all
from headwise.session import build_session

HEADLINE = (
    "late_share",
    "a1_collapse",
    "a2_rollup_daily",
    "a3_rollup_monthly",
    "a4_serving_stats",
    "a5_dataset_summary",
    "a8_route_hour_totals",
    "a11_transform_stats",
    "a16_day_coverage",
    "a20_diff_summary",
    "d1_decode_payloads",
    "d6_stop_updates",
    "w1_best_per_poll",
    "w2_representative_trips",
    "w4_widened",
    "w5_dump_retention",
    "w6_best_and_worst",
    "j7_scheduled_events",
    "j8_coverage_match",
    "j14_table_diff",
    "j15_reconcile",
    "j18_nearest_stops",
    "j19_search_stops",
    "s10_stop_documents",
    "s11_route_documents",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    catalog = load_all()
    names = list(catalog) if wanted == "all" else [n for n in wanted.split(",") if n] or list(HEADLINE)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's file and shuffle machinery outside the timings.
    catalog["a6_growth"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        catalog[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {timings[name]}", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(timings.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": timings, "sf": sf}))


if __name__ == "__main__":
    main()

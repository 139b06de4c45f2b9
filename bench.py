"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the local threads, BENCH_RUNS the timed runs per query.
Each figure is the median of the timed runs after one warm-up; results go to the no-op sink, so every row is made.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "j1_newest_readings",
    "a1_mean_by_pillar",
    "a2_pending_by_company",
    "j5_audits_by_auditor",
    "j7_companies_without_site",
    "j9_reconciled_auditors",
    "j8_audited_metrics",
    "a4_top_companies_above_average",
    "v1_reading_overview",
    "j6_audit_detail",
    "j4_name_join_collapsed",
    "f3_date_range",
    "a10_median_by_pillar",
    "a14_shape_by_pillar",
    "a19_sector_metric_means",
    "a20_company_pillar_means",
    "a24_sector_status_counts",
    "a25_histogram",
    "a27_box_by_sector",
    "sector_pillar_summary",
    "dashboard_summary",
    "h1_levene",
    "h2_welch",
    "h3_mann_whitney",
    "m2_quartile_grades",
    "m3_hold_out",
    "m5_m12_nearest_neighbour_regression",
    "i13_loaded_readings",
    "i17_audit_links",
    "c6_readings_without_site",
    "rule_report",
    "d4_insert_readings",
    "d7_update_status",
    "r6_reopened_readings",
    "r4_logged_transitions",
)


def main() -> None:
    from greenledger.plans import catalog
    from greenledger.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalog.callables(), {}
    for name in sys.argv[1:] or HEADLINES:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name:40s} {seconds[name]:.3f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

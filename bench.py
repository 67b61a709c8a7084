"""Times the headline queries: one JSON line for the driver.

Each query runs once to compile and warm up, then RUNS times; the figure is the median.
Results go to the no-op sink, so all rows and columns are computed and none collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

HEADLINE = (
    "event_probability", "extremes_13_fields", "case_metrics", "spearman_p_cell", "kendall_z_cell", "window_climatology",
    "threshold_p90", "daily_range", "valid_time_6h", "regrid_nearest", "completeness_check", "embedding_stack",
)
RUNS = 3


def main() -> None:
    from skillgrid.plans.catalogue import QUERIES
    from skillgrid.session import build_session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        took = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took[1:]), 4)
    print(json.dumps({"metric": "headline_query_seconds_total", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries on one scale factor; prints one JSON line.

Every query reads the given tables anew, so its time covers the whole path from the scan.
"""

from __future__ import annotations

import json
import os
import time

from starslice import workload
from starslice.runtime import local_session

HEADLINE = [
    "sum_by_entity_year", "leaderboard", "metric_all_years", "metric_zscore", "metric_attribute_share", "competition_rank_unbounded",
    "quantile_breaks_unbounded", "record_changes", "h2h_stats", "choropleth_classes", "fact_rows", "unpivot_series", "crosscheck",
    "latest_wins", "html_cells", "text_sections", "alias_resolve", "point_in_polygon", "line_groups", "stream_rollup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8, "bench")
    queries = workload.queries()
    queries["sum_by_year"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up, not reported
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

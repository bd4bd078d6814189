"""Headline queries on local cores; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import time

from tidemark.plans import CATALOG
from tidemark.session import local_session

#: One query of each kind of work: scans, grouped series, calendars, profiles,
#: backtests, reconciliation, scoring, streams and the whole fan-out.
HEADLINE = (
    "aggregate_sum",
    "aggregate_median",
    "grouped_series",
    "observed_window",
    "align_calendar",
    "quality_report",
    "validate_panel",
    "column_statistics",
    "key_search",
    "demand_pattern",
    "model_scores",
    "select_models",
    "lag_correlations",
    "reconcile",
    "scorecard",
    "decisions",
    "usage_totals",
    "stream_daily_totals",
    "fan_out",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_ONLY", "").split()
    spark = local_session(cores)
    # The first job of a JVM pays for starting it; it is not a query's time.
    spark.read.parquet(f"{folder}/region.parquet").count()
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        started = time.perf_counter()
        CATALOG[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

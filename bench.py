"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from monthmill.plans.catalog import QUERIES
from monthmill.session import local_session

HEADLINE = [
    "p03_calendar_spine", "j03_metric_merge", "j04_as_of_selection", "w08_rolling_statistics", "g14_demand_class",
    "f05_ses", "f10_croston", "b01_rolling_origin", "b03_series_run", "b03_series_run_parts", "b11_statistical_winner", "b13_weight_search",
    "g12_residual_quantiles", "f28_forecast_table", "g21_resolution", "g26_pareto_cover", "j16_membership_routing",
    "l02_learning_events", "g35_live_metrics", "f25_cold_start_forecast", "f17_pooled_ridge", "q15_classification_proposal",
    "x03_running_totals",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # one untimed query starts the executors and fills the file cache
    QUERIES["j01_fact_dimensions"](spark, root).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()

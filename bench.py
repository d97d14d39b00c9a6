"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) is the table directory and
``BENCH_CPUS`` (default 8) the number of local cores. Each query is built, planned
and run to the end twice: ``queries`` holds the second time, ``first_run`` the one
that also compiles its generated code.
"""

from __future__ import annotations

import json
import os
import time

from usagepulse.plans.queries import all_queries
from usagepulse.session import local_session

HEADLINE = [
    "activity_fact",
    "comprehensive_metrics",
    "comprehensive_metrics_year",
    "comprehensive_metrics_events",
    "feature_combinations",
    "feature_metrics_spending",
    "feature_metrics_savings",
    "retention_overall",
    "retention_events",
    "feature_metrics_all",
    "trend_series",
    "trend_dau",
    "trend_wau",
    "trend_mau",
    "overview_trend_day",
    "overview_trend_week",
    "overview_trend_smoothed",
    "churn_count",
    "absolute_metrics",
    "dormant_analysis",
    "dormant_trend",
    "kpi_monthly",
    "kpi_by_segment",
    "kpi_alerts",
    "insights",
    "recommendations",
    "survey_completion",
    "reaction_counts",
    "feedback_list",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()

    def seconds(name: str) -> float:
        begin = time.perf_counter()
        registered[name](spark, root).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - begin, 3)

    seconds("comprehensive_metrics")
    first_run = {name: seconds(name) for name in HEADLINE}
    timings = {name: seconds(name) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "first_run": first_run,
                "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

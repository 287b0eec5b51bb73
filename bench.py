"""Time the headline queries: one untimed run each, then the median of three."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "overview", "top_events", "daily_active_users", "weekly_active_users", "monthly_active_buyers", "stickiness",
    "funnel", "ordered_funnel_48h", "ordered_funnel_commerce", "retention_daily", "retention_monthly", "cohort_matrix",
    "top_pages", "realtime_snapshot", "common_events", "total_events", "rollup_page_views", "rollup_sessions",
    "rollup_daily", "rollup_hourly", "merged_rollup_estimates", "user_profile", "session_stats", "bounce_rate",
    "breakdown_by_segment", "sessionized_events", "anomalies", "forecast", "churn_risk", "period_report",
    "recent_per_project", "dedupe_deliveries", "validation_verdicts", "key_to_project", "anonymized_events",
    "erased_events", "masked_text", "typed_commerce_events")


def main() -> None:
    from pulsegrain.plans.catalog import load
    from pulsegrain.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, **{
        "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    entries, seconds = load(), {}

    def once(name: str) -> float:
        start = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(3)), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

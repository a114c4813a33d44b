"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the local cores, BENCH_QUERIES an
optional comma-separated list (``all`` for every registered query).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from regionhour import build_session  # noqa: E402
from regionhour.plans import registry  # noqa: E402

HEADLINE = [
    "counts_by_region", "region_hour_crosstab", "describe", "duration_box", "monthly_trend", "text_anomalies",
    "alarms_with_weather", "counts_by_temperature", "box_by_state", "correlation_matrix",
    "flatten_forecast", "forecast_file_quality", "weather_day_issues", "city_quality_status",
    "region_hour_flags", "horizon_labels", "feature_table", "base_rate_forecast", "current_alarms", "alarms_today_stats",
    "extract_report_text", "clean_report_text", "classify_report", "tokenize_daily", "escalation_score",
    "extract_links", "unique_report_urls", "classify_fetch", "resolve_with_cache", "status_breakdown", "top_domains",
    "stream_hourly_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE

    spark.range(1).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

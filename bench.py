"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import catalog  # noqa: E402
from meterwork.session import build_session, use_settings  # noqa: E402

# Raw log to marts, marts at lineitem size, and the order-dependent operators.
HEADLINE = [
    "s01_w01_claude_cost_by_model",
    "d02_w04_claude_tools",
    "s02_w05_w06_d04_codex_usage",
    "s05_u03_d01_gemini_lines",
    "s15_p10_d03_copilot",
    "a02_cost_by_model_orders",
    "a03_session_cube_orders",
    "a04_daily_orders",
    "a14_projects_orders",
    "a08_session_summary",
    "a09_totals_by_agent",
    "a11_u02_server_audit",
    "a17_merged_daily",
    "w09_a21_a27_blocks_by_user",
    "p35_text_volume_by_source",
    "r05_stream_blocks",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = use_settings(
        build_session(
            f"local[{cpus}]",
            app="bench",
            **{
                "spark.sql.shuffle.partitions": cpus,
                "spark.ui.enabled": "false",
                "spark.ui.showConsoleProgress": "false",
                "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            },
        )
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/events.parquet").count()
    times = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs):
            started = time.perf_counter()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        times[name] = round(statistics.median(taken), 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()

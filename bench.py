"""Time the catalogue: one JSON line with seconds per query.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_QUERIES (comma
separated) a choice of queries. Each query is run to completion without collecting its rows:
once cold, then BENCH_RUNS times, of which the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from clickloom.plans.queries import CATALOGUE
from clickloom.session import build_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
STREAM_RUNS = 1
HEADLINE = [
    "sales_trend_day",
    "sales_trend_hour",
    "daily_kpis",
    "category_sales",
    "active_countries",
    "traffic_breakdown",
    "top_users",
    "recent_events",
    "live_feed",
    "live_top_products",
    "product_search",
    "click_events",
    "sessions_first",
    "events_dedup",
    "quarantine",
    "user_product_interactions",
    "product_popularity",
    "user_scores",
    "recommend_top",
    "recommend_user",
    "recommend_all",
    "recommend_unseen",
    "stream_user_scores",
    "stream_score_increments",
    "stream_click_log",
    "stream_dedup",
]


def seconds(name: str, spark) -> float:
    started = time.perf_counter()
    CATALOGUE[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{CPUS}]",
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    cold, warm = {}, {}
    for name in names:
        cold[name] = round(seconds(name, spark), 3)
        runs = STREAM_RUNS if name.startswith("stream_") else RUNS
        warm[name] = round(statistics.median(seconds(name, spark) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "median warm seconds, all headline queries",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": Path(FOLDER).name.removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

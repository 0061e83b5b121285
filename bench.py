"""Headline queries, timed end to end; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickloom.catalog.queries import queries  # noqa: E402
from tickloom.session import build_session  # noqa: E402

HEADLINES = (
    "build_bars_hourly", "moving_averages", "rsi", "bollinger", "ichimoku", "price_cluster",
    "support_strength", "ema", "macd", "adx", "daily_ema", "daily_adx_macd", "feature_table",
    "daily_feature_table", "build_bars_daily", "strategy_decisions",
    "rule_votes_wide", "rule_votes_long", "final_decision", "latest_decision", "decisions_as_of",
    "append_dedup_last", "extract_execution", "review_table", "exec_valid", "parse_log",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    found = queries()
    found["rsi"](spark, sf_dir).count()   # starts the JVM side and stores the bar table
    times = {}
    for name in HEADLINES:
        start = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

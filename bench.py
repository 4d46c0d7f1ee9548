"""Time the headline queries and print one JSON line.

Settings come from the environment: BENCH_SF_DIR (tables), BENCH_CPUS (local
cores), BENCH_RUNS (timed runs per query after one warm-up; the median counts).
Results go to a sink that computes every column and stores nothing.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "canonical_messages",
    "canonical_documents",
    "canonical_events",
    "run_summary",
    "clean_text",
    "dedup_keep_first",
    "capped_sample",
    "language_agreement",
    "daily_volume",
    "weekly_volume",
    "length_describe",
    "vocabulary",
    "term_counts",
    "topic_keywords",
    "bm25",
    "hybrid_search",
    "technique_matches",
    "indicators",
    "persona_profiles",
    "code_switches",
    "activity_hours",
    "edges",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from chatseam.plans import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("chatseam-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total of median query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

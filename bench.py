"""Times the headline queries and prints one JSON line.

One warm-up, then the median of RUNS full evaluations of each query. BENCH_SF_DIR names
the folder of the tables and BENCH_CPUS the number of cores.
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gradeworks.catalog.registry import all_queries  # noqa: E402

RUNS = 3
HEADLINE = [
    "best_of_k",
    "part_gating",
    "best_of_k_accuracy",
    "early_stop",
    "dedup_last",
    "accuracy_t",
    "accuracy_cube",
    "leaderboard_pivot",
    "overall_score",
    "error_shares",
    "solved_by_day_model",
    "extract_code",
    "syntax_triage",
    "grade_t",
    "grade_direct",
    "clean_dispatch",
    "build_corpus",
    "assemble_nested",
    "backfill_join",
    "conversation_prompt",
    "chat_prompt_p2",
    "findings_summary",
]


def run_once(query, spark: SparkSession, folder: str) -> float:
    start = time.perf_counter()
    query.run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        run_once(registered[name], spark, folder)
        times = [run_once(registered[name], spark, folder) for _ in range(RUNS)]
        seconds[name] = round(statistics.median(times), 4)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder).removeprefix("sf"),
                "cpus": cpus,
                "runs": RUNS,
            }
        )
    )


if __name__ == "__main__":
    main()

"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and then three times; the median counts. A run covers building
the plan and computing every output row.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "Q01_customer_features",
    "Q02_churn_rate",
    "Q03_churn_sweep",
    "Q04_spend_features",
    "Q05_retention",
    "Q06_cumulative_revenue",
    "Q07_overview",
    "Q10_experiment_readout",
    "Q11_experiment_design",
    "A02_category_diversity",
    "A06_revenue_by_category",
    "M01_stratified_split",
    "E01_roc_auc",
    "E06_model_comparison",
)
# Trained once per session, so timed on the first run only.
MODELS = ("Q08_churn_models", "Q09_spend_models")


def seconds(run, spark: SparkSession, folder: str) -> float:
    begin = time.perf_counter()
    run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    import checks

    times = {}
    for name in HEADLINE:
        run = checks.QUERIES[name]
        seconds(run, spark, folder)
        times[name] = round(statistics.median(seconds(run, spark, folder) for _ in range(3)), 3)
    for name in MODELS:
        times[name] = round(seconds(checks.QUERIES[name], spark, folder), 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Times the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

import json
import os
import sys
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
HEADLINES = [
    "best_price", "best_price_diversified", "candidate_pairs", "candidate_triples", "coverage_verdicts", "maximin_two_leg", "scan_status", "validation_status",
    "price_changes", "episodes", "source_reliability", "alert_fsm", "market_reconcile_remap", "event_match", "wire_flatten", "guaranteed_over_under",
    "detection_run", "event_fold", "event_register", "event_merge_applied", "coverage_verdicts_periods", "maximin_stakes",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from quoteloom.plans import catalogue

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalogue.queries(), {}
    for name in [HEADLINES[0], *HEADLINES]:  # the first run only warms up
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir}))


if __name__ == "__main__":
    main()

"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from forgetide.plans import QUERIES  # noqa: E402
from forgetide.plans.routing import land  # noqa: E402
from forgetide.session import configure  # noqa: E402

HEADLINES = ["A1_distinct_members", "W1_arrivers", "W2_leavers", "W3_running_tally", "W4_forward_fill",
             "A8_wide_report", "T8_annotate", "S8_keyed_upsert", "G2_conflict_rule", "P22_uniform_activity",
             "E1_push_events", "E12_other_events", "A12_first_participation", "J1_push_to_commit_author",
             "A9_commit_metrics", "W6_mainline", "W9_one_large_project", "R5_pull_merges"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or ["land_events", *HEADLINES]
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            if name == "land_events":  # the write that all event tables read
                land(configure(spark), sf_dir)
            else:
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name} {seconds[name]} (first {times[0]:.2f})", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total of median warm times", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

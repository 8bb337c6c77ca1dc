"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from twinledger.checks import QUERIES

HEADLINE = [
    "reconcile_ruleset", "reconcile_unified", "reconcile_ids", "base_diff", "full_outer_classify", "diff_summary",
    "find_duplicate_ids", "collapse_duplicates", "execute_rules", "execute_matched_pair_rules", "matches_operator",
    "windowed_reconcile", "adaptive_slices", "extract_data", "validate_records", "infer_schema", "relevance_search",
    "redact_secrets", "collapse_execution_history", "run_manifest", "write_diffs", "bom_cycle_split",
]

SHORT_S = 4
"""Queries below this run three times, and the median counts."""


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start the executor threads
    seconds: dict[str, float] = {}

    def timed(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spark.catalog.clearCache()
        return time.perf_counter() - started

    timed(HEADLINE[0])  # compiles and loads what the first query would else be charged for
    for name in HEADLINE:
        runs = [timed(name)]
        if runs[0] < SHORT_S:
            runs += [timed(name), timed(name)]
        seconds[name] = round(median(runs), 3)
    print(json.dumps({
        "metric": "total seconds over headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

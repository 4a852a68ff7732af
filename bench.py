"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (input folder), BENCH_CPUS (cores), BENCH_QUERIES
(comma-separated names, optional).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "scan",
    "scan_response",
    "scan_strict",
    "scan_dedup",
    "stream_scan",
    "route_messages",
    "anonymize",
    "anonymize_strict",
    "pii_entities",
    "pii_redact_spans",
    "secret_findings",
    "injection_score",
    "toxicity_lexicon",
    "toxicity_score",
    "toxicity_ml",
    "session_rollup",
    "violation_rollup",
    "quarantine",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(",")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("msgscreen.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from msgscreen.plans.registered import QUERIES

    # One small run starts the JVM's compilers, so that the first query does not pay for all.
    QUERIES["scan"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    n_messages = QUERIES["msg_source"](spark, sf_dir).count()
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else None,
                "messages": n_messages,
                "scan_ms_per_message": round(1000 * seconds["scan"] / n_messages, 4) if "scan" in seconds else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

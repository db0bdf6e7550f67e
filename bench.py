"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of local cores. Each query
is run cold (first run in the session) and then warm twice; ``queries`` holds the
median of the three, ``value`` its sum. Every run builds the plan anew and
computes all result rows and columns.
"""

import json
import os
import sys
import tempfile
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from checks import fixtures, queries

HEADLINE = [
    "scan_creds_core",
    "scan_creds_enterprise",
    "scan_keys_enterprise",
    "scan_creds_public",
    "scan_keys_public",
    "scan_creds_documents",
    "scan_keys_documents",
    "scan_creds_new_files",
    "keyword_match_enterprise",
    "search_keywords_enterprise",
    "collect_training_creds_enterprise",
    "build_ngram_table",
    "dictionary_match",
    "run_report",
]


def timed(spark, name, sf_dir):
    start = time.perf_counter()
    queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    memory = os.environ.get("BENCH_MEMORY", "8g")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("credsieve-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="credsieve-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    files = fixtures.code_files(spark, sf_dir)
    size = files.agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("b")).first()
    cold = {name: timed(spark, name, sf_dir) for name in HEADLINE}
    warm = [{name: timed(spark, name, sf_dir) for name in HEADLINE} for _ in range(2)]
    middle = {name: median([cold[name], *(run[name] for run in warm)]) for name in HEADLINE}
    speed = {
        name: {
            "files_per_sec": round(size.n / middle[name]),
            "mb_per_sec": round(size.b / 1e6 / middle[name], 2),
        }
        for name in ("scan_creds_core", "scan_creds_enterprise", "scan_keys_enterprise")
    }
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(middle.values()), 3),
                "unit": "sec",
                "queries": middle,
                "cold": cold,
                "warm": warm,
                "speed": speed,
                "files": size.n,
                "bytes": size.b,
                "cpus": int(cpus),
                "memory": memory,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

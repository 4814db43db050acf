"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of local cores and
``BENCH_QUERIES`` a comma-separated choice of queries.  The source corpus is written
before the clock starts and timed by itself; each query runs to completion into a no-op sink.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from workload import corpus
from workload.registry import queries

HEADLINE = [
    "classes",
    "methods",
    "routes",
    "decorated_statements",
    "imports",
    "properties",
    "relationships",
    "endpoints",
    "type_fields",
    "folder_tree",
    "erd_text",
    "type_closure",
    "document_lines",
    "documents_text",
    "toc",
    "write_documents",
]
#: A key is timed so many times, unless the first time is over SLOW seconds; the median counts.
RUNS, SLOW = 3, 20.0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    shared = tempfile.mkdtemp(prefix="bench-")  # one machine: all of Spark reaches it
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("srcatlas-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", shared)
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    start = time.time()
    n_files = corpus.files(spark, sf_dir).count()
    prepare = round(time.time() - start, 3)
    seconds: dict[str, float] = {}
    known = queries()
    for name in chosen.split(",") if chosen else HEADLINE:
        times: list[float] = []
        while len(times) < RUNS and (not times or times[0] <= SLOW):
            start = time.time()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(name, seconds[name], f"of {len(times)}", file=sys.stderr, flush=True)
    spark.stop()
    shutil.rmtree(shared, ignore_errors=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "files": n_files,
                "prepare_sec": prepare,
            }
        )
    )


if __name__ == "__main__":
    main()

"""Time every registered query: one warm-up run of all, then the median of three.

Prints one JSON line. BENCH_SF_DIR and BENCH_CPUS name the data and the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from cardmill.plans.registry import QUERIES
from cardmill.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def run(query, spark) -> float:
    start = time.perf_counter()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = build_session(f"local[{CPUS}]", shuffle_partitions=int(CPUS), driver_memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for query in QUERIES.values():
        run(query, spark)
    for name, query in QUERIES.items():
        seconds[name] = round(median(run(query, spark) for _ in range(RUNS)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

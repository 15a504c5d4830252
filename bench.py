"""Time the registered queries: one JSON line with seconds per query.

Settings: BENCH_SF_DIR (table folder), BENCH_CPUS (cores), BENCH_QUERIES (comma-separated
names, default all), BENCH_REPEAT (timed runs per query, the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from castwise.catalog import QUERIES  # noqa: E402
from castwise.session import local_session  # noqa: E402


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    # the noop sink computes every row and column and keeps none of them
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(min(8, os.cpu_count() or 1)))
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)

    spark = local_session(cpus, app="castwise-bench")
    run(spark, "category_performance", folder)  # start-up is not part of any query
    seconds = {}
    for name in names:
        seconds[name] = round(statistics.median(run(spark, name, folder) for _ in range(repeat)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()

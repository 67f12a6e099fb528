"""Times every registered query on one machine and prints one JSON line.

``BENCH_SF_DIR`` is the folder of the tables, ``BENCH_CPUS`` the number of
cores, ``BENCH_RUNS`` the warm runs per query (their median counts). Results go
to Spark's no-op sink, so every row and column is computed and none is kept.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from marquee.plans import QUERIES
from marquee.session import build_session


def run_once(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    frame = QUERIES[name](spark, folder)
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    names = sys.argv[1:] or list(QUERIES)
    # Streams and shared tables keep their files here, until the end of the run.
    shared = tempfile.TemporaryDirectory(prefix="bench-")
    spark = build_session(
        "bench",
        spark__checkpoint__dir=shared.name,
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for name in names:
        cold[name] = round(run_once(spark, name, folder), 4)
        # A stream starts from nothing each time, state stores included.
        repeats = 1 if name.startswith("stream_") else runs
        times = [run_once(spark, name, folder) for _ in range(repeats)]
        warm[name] = round(statistics.median(times), 4)
    spark.stop()
    shared.cleanup()
    print(
        json.dumps(
            {
                "metric": "sum of warm median seconds over all queries",
                "value": round(sum(warm.values()), 4),
                "unit": "sec",
                "queries": warm,
                "first_run": cold,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()

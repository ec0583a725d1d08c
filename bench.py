"""Wall time of the headline queries: one warm-up, then the median of three runs.

Rows are computed in full and thrown away (``noop`` sink).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from flowguard.plans.queries import QUERIES
from flowguard.session import local_session

HEADLINE = [
    "scan_packets", "filter_tcp", "count_window", "packet_rate", "label_encode", "ddos_events",
    "botnet_events", "ids_classify", "xss_events", "webshell_events", "tfidf", "host_runs", "host_events",
    "ftp_sessions", "elf_features", "elf_clean", "file_events", "stream_count_window",
]
RUNS = 3


def timed(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "flowguard-bench")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        timed(spark, name, sf_dir)
        seconds[name] = round(statistics.median(timed(spark, name, sf_dir) for _ in range(RUNS)), 3)
    spark.stop()
    result = {
        "metric": "total wall time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()

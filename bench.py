"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and then ``$BENCH_RUNS`` times (default 1); the reported time is the median of a full
execution into a no-op sink, building the plan included.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusloom.plans.catalog import QUERIES  # noqa: E402
from corpusloom.session import local_session  # noqa: E402

HEADLINE = [
    "scan_code_files",
    "dispatch_extractors",
    "symbol_dedup",
    "index_stats",
    "lint_brackets",
    "smart_repair",
    "typo_dedup",
    "import_edges",
    "embed_text",
    "build_embedding_index",
    "vector_search",
    "pattern_query",
    "render_context",
    "meaningful_change",
    "greedy_budget",
    "memory_append",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus)
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        seconds = []
        for i in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                seconds.append(time.perf_counter() - started)
        times[name] = round(statistics.median(seconds), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    result = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()

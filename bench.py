"""Benchmark the headline queries.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_REPEAT (default 3; the median is reported).
Each query runs in full into Spark's no-op sink (nothing is collected to the
driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sieve.plans.catalog import QUERIES  # noqa: E402
from sieve.session import build_session  # noqa: E402

HEADLINE = [
    "screen",            # one review: scan, CNF filter, rank join, gate
    "screen_many",       # four reviews from one scan (year-equi-join)
    "keyword_groups",    # keyword groups over whole document texts
    "fallback_abstract", # page text, long paragraphs, cut at 'abstract'
    "extract_abstract",  # routed extraction incl. the Python parser route
    "enrich_papers",     # metadata joins
    "ingest_records",    # XML dump write + text-split parse
    "all_papers",        # whole review run: screen, ids, ranks, enrichment
    "prisma_flow",       # whole review run + PRISMA counters
]


def run_once(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    df = QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 8))
    # warm the JVM and the Python workers once
    run_once(spark, "screen", sf_dir)
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = [run_once(spark, name, sf_dir) for _ in range(repeat)]
        times[name] = round(statistics.median(runs), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "cpus": cpus,
        "repeat": repeat,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()

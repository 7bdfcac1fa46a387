"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables and ``BENCH_CPUS`` the number of cores. Every query is run
once to warm the JVM up and then timed over ``BENCH_RUNS`` runs, of which the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pagewell import build_session
from pagewell.catalog import ENTRIES

HEADLINE = [
    "extract_text",
    "extract_links",
    "links_unvisited",
    "frontier_take",
    "revisit_interval",
    "change_detect",
    "crawl_closure",
    "tokenize",
    "build_postings",
    "sink_index_append",
    "search_terms",
    "search_boolean",
    "search_phrase",
    "search_fuzzy",
    "search_prefix_wildcard",
    "best_fragment",
    "search_snippets",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "pagewell-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        begin = time.perf_counter()
        ENTRIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    took = {}
    for name in names:
        once(name)
        took[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

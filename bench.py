"""Wall time of the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import sys
import time

from kodagraf.plans import catalog
from kodagraf.runtime import local_session
from kodagraf.sources import tables

# Index build, lookup and search, graph, map, budget, bundle, stream.
HEADLINE = """
extract_units call_edges all_edges
lookup_exact search_tiers search_fuzzy
bfs_depth expand_dependencies cycles_bounded components pagerank
repo_map architecture_layers
budget_allocate tiered_prune
context_bundle query_symbols
debounce_changes
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    t0 = time.perf_counter()
    repo = tables.parts_repo(spark, sf_dir)  # the stored index, as written once before queries
    index_sec = time.perf_counter() - t0
    names = sys.argv[1:] or HEADLINE
    catalog.QUERIES["lookup_by_id"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in names:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t0, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "index_build_sec": round(index_sec, 3),
                "units": repo.units.count(),
                "edges": repo.edges.count(),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline queries: prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Every query runs once to warm
up on the smallest tables beside it and once timed; the result is counted by the engine, not
collected.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from strandgraph.plans import catalog

HEADLINE = [
    "stats_by_kind", "node_lookup", "callers_d1", "usages", "edges_between", "bfs_out", "callers_d3", "impact_d3",
    "ancestors", "file_edges", "node_metrics", "dead_code", "blast_radius", "dominant_file", "search_fts_bm25",
    "search_cascade", "search_like", "search_fuzzy", "resolve_exact", "resolve_qualified", "resolve_method_call",
    "synth_override", "synth_structural_implements", "enclosing_interval", "cluster_ranges", "debounce_sessions",
    "ppr_25", "sync_diff",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalog.queries(), {}
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in ("callers_d1", "bfs_out", "search_fts_bm25"):
            queries[name](spark, small).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

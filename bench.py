"""Time the headline queries on the tables of $BENCH_SF_DIR and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seqweave.plans import catalog
from seqweave.session import build_session

HEADLINE = [
    "successor_baseline", "order_edges", "window_nodes", "cross_half_decode", "call_tables", "rotate_orient",
    "window_walk", "region_window", "upstream_paths", "backbone", "plastic_runs", "circular_blocks", "pair_geometry",
    "fork_rules", "backoff_predictor", "fitted_smoothing", "bits_per_site", "cmh_matrix", "permutation_test",
    "path_agreement_odds", "presence_similarity", "nearest_exemplars", "vector_decode", "matched_controls",
    "calibrated_units", "locate_family", "search_names", "clean_texts", "distinct_texts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    only = sys.argv[1:]
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").split("sf")[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()

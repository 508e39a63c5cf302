"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = HERE + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = (
    "cochange_pairs", "file_graph_edges", "see_also_topk", "feature_neighbours", "membership_churn", "citing_range", "innermost_symbol", "connected_components",
    "ancestors_closure", "bm25f_search", "identifier_mining", "content_hash", "activity_day", "prefix_budget", "run_totals", "usage_filtered_counts", "state_machine",
)


def main() -> None:
    from veinstone.plans import catalog
    from veinstone.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries = catalog.queries()
    queries["cochange_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers
    took = {}
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

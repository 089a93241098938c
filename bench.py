"""Times the headline queries on one machine; prints one JSON line.

Each query runs once to warm up and then three times; the median counts. Results go to the noop sink, so all rows
are made and none is collected.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from waymark.plans import catalog
from waymark.session import ensure_checkpoint_dir, local_session

HEADLINES = ("area_summary", "area_rollup_sets", "best_mode_pick", "shortage_diagnosis", "stop_edges_lead", "edge_summary_textset", "departure_slot_asof", "slot_profile_stats", "selection_cascade", "validity_latest", "grid_range_join", "knn1_bounded", "pip_grid", "sssp_multi_source", "path_flow_counts")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="waymark-bench")
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    took = {}
    for name in HEADLINES:
        runs = []
        for k in range(4):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if k:
                runs.append(time.perf_counter() - began)
        took[name] = round(median(runs), 3)
    print(json.dumps({"metric": "waymark headline queries, median of 3 warm runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries, timed one after the other; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from inkframe import catalog
from inkframe.session import build_session

HEADLINE = [
    "flagship_consensus_report", "a1_consensus", "a4_weighted_vote", "a5_stable_prefix", "q6_memory_candidates", "a7_recall", "g1_connected_components", "g2_dedupe_boxes", "j7_assign_nearest",
    "j8_overlap_pairs", "w1_cluster_1d", "w6_reading_order", "w7_spacing_anomalies", "w16_otsu", "r1_to_runs", "r5_components", "a13_ink_metrics", "m3_replay", "u1_worklist", "q5_propagate",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    catalog.load()
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["a16_histogram"](spark, folder).write.format("noop").mode("overwrite").save()  # start the engine
    times = {}
    for name in names:
        t0 = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
